"""Language-model scores from a weighted backoff automaton.

Counts of one, two and three tokens of the training rows, each order smoothed with a Dirichlet prior towards the one below, make an
automaton. Its states are the root, the words, and the pairs that training rows hold; an arc of a state is a token seen after it and leads to the
state of the last two tokens; a failure arc leads from a pair to its second word, and from a word to the root, which has an arc
for every token. One traversal from left to right carries the state and adds up log10 probabilities. Long texts are traversed in
pieces at the same time: a piece starts two tokens early, since the state never depends on more.

Counts cover all training rows: shards ask buckets of the hash space for the counts of the words, pairs and triples
they hold, so no table of counts is ever in one place; a shard's automaton holds the arcs its own texts can use. Words are told apart by
64-bit hashes, pairs and triples by 42 bits and those of their bucket's number.

Null texts count as empty: one token, the end. Repeated rows are counted and scored as often as they are there; a null id
belongs to the training rows. Other columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.exchange import Exchange, pack, pack_counts, parts, unpack_counts
from tessera.llm.textops import SPACE_WORDS, Words, mix

_START, _END = np.uint64(0x1234567887654321), np.uint64(0x0FEDCBA987654321)
#: Weight of the word probabilities against a word's own counts, and of those after a word against a pair's own counts.
PRIORS = (200.0, 20.0)
#: Tokens of a text that are traversed one after the other.
PIECE = 256


class Tokens:
    """The tokens of a shard (words, then an end in each row) as hashes, the pairs and triples they end, and the row bounds."""

    def __init__(self, table: pa.Table, folds: int, held_out: int):
        words = Words(table.column("text"), SPACE_WORDS, lower=True)
        n = words.counts()
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        self.token = np.full(self.first[-1], _END, np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[self.first[1:] - 1] = False
        self.token[inner] = words.hash
        del words
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first[:-1]] = _START
        self.pair = mix(before * np.uint64(3) + self.token)  # of the token before, or the start, and each token
        self.held_out = np.array([x is not None and zlib.crc32(str(x).encode()) % folds == held_out for x in table.column("id").to_pylist()], bool)
        self.later = np.ones(len(self.token), bool)  # not the first of its row: it ends a triple
        self.later[self.first[:-1]] = False

    def triples(self) -> np.ndarray:
        at = np.flatnonzero(self.later)
        return mix(self.pair[at - 1] * np.uint64(5) + self.token[at])


def _counted(keys: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each is there without those marked."""
    distinct, counts = np.unique(keys, return_counts=True)
    some, times = np.unique(keys[left_out], return_counts=True)
    counts[np.searchsorted(distinct, some)] -= times
    return distinct, counts


def pack_keys(keys: np.ndarray, least: int, drop: int) -> tuple:
    """Sorted keys of a bucket as differences, without their lowest `drop` bits; few bytes each, as the bucket's range is known."""
    short = keys - np.uint64(least) >> np.uint64(drop)
    step = np.diff(short, prepend=np.uint64(0))
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return width, step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(packed: tuple) -> np.ndarray:
    width, data = packed
    step = np.zeros((len(data) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.cumsum(step.reshape(-1).view("<u8"), dtype=np.uint64)


class BackoffAutomaton:
    """States, arcs and failure arcs over the tokens of some texts.

    words: count of each word; total, distinct: of all training tokens; starts: number of training rows. Each pair is (word, or -1 for the start;
    token) with its count, each triple (pair that it begins with, pair that it ends with) with its count: only those that occur in the texts.
    """

    def __init__(self, words: np.ndarray, total: int, distinct: int, starts: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray], priors: tuple[float, float]):
        n, (before, token, count), (begin, end, times) = len(words), pairs, triples
        base = (words + 0.1) / (total + 0.1 * (distinct + 1))
        # states: the root, the start, the words, the pairs
        self.root, self.start, word, pair = 0, 1, 2, 2 + n
        context = np.concatenate([[starts], words])
        # the root's arcs: every token
        self.root_weight, self.root_target = np.log10(base), np.where(words > 0, word + np.arange(n), self.root)
        # arcs of words and of the start, numbered as pairs are
        second = (count + priors[0] * base[token]) / (context[before + 1] + priors[0])
        self.word_source = np.where(count > 0, self.start + 1 + before, -1)
        self.word_weight, self.word_target = np.log10(second), pair + np.arange(len(count))
        # arcs of pairs, numbered as triples are
        third = (times + priors[1] * second[end]) / (count[begin] + priors[1])
        self.pair_source = np.where(times > 0, pair + begin, -1)
        self.pair_weight, self.pair_target = np.log10(third), pair + end
        # failure arcs
        self.failure = np.concatenate([[self.root, self.root], np.full(n, self.root), word + token])
        self.failure_weight = np.concatenate([[0.0], np.log10(priors[0] / (context + priors[0])), np.log10(priors[1] / (count + priors[1]))])
        self.pair = pair

    def traverse(self, first: np.ndarray, token: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> np.ndarray:
        """log10 probability of each token of texts: text i has tokens first[i]:first[i + 1]; pair, triple: what each token ends (-1: no triple).

        Pieces of texts move one token at a time, all together; each carries its state.
        """
        out = np.zeros(len(token))
        size = np.diff(first)
        n = -(-size // PIECE)
        begin = np.repeat(first[:-1], n) + PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + PIECE, np.repeat(first[1:], n))
        at = np.maximum(begin - 2, np.repeat(first[:-1], n))
        state = np.where(at == np.repeat(first[:-1], n), self.start, self.root)
        while len(at):
            weight, target = np.zeros(len(at)), np.empty(len(at), np.int64)
            left = np.arange(len(at))
            for source, arc_weight, arc_target, label in ((self.pair_source, self.pair_weight, self.pair_target, triple), (self.word_source, self.word_weight, self.word_target, pair)):
                arc = label[at[left]]
                found = arc >= 0
                found[found] = source[arc[found]] == state[left[found]]
                hit, arc = left[found], arc[found]
                weight[hit] += arc_weight[arc]
                target[hit] = arc_target[arc]
                left = left[~found]
                # a state of this order fails to the one below
                fails = state[left] >= (self.pair if source is self.pair_source else 1)
                down = left[fails]
                weight[down] += self.failure_weight[state[down]]
                state[down] = self.failure[state[down]]
            weight[left] += self.root_weight[token[at[left]]]
            target[left] = self.root_target[token[at[left]]]
            real = at >= begin  # not those read to find the state
            out[at[real]] = weight[real]
            at = at + 1
            on = at < end
            at, begin, end, state = at[on], begin[on], end[on], target[on]
        return out


def score(documents: DataFrame, *, folds: int = 10, held_out: int = 0, priors: tuple[float, float] = PRIORS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """op8: a row for each document with its scores; rows whose crc32(id) mod folds is held_out are not learned from."""
    shards = Exchange(documents, key, text)
    least = [(i << 64) // shards.n for i in range(shards.n)]
    drop = max(0, 64 - (shards.n - 1).bit_length() - 42)

    def kinds(t: Tokens):
        """Keys of the words (and the start), the pairs and the triples of a shard, with what marks those of held-out rows."""
        held = np.repeat(t.held_out, np.diff(t.first))
        starts = np.full(len(t.held_out) + 1, _START, np.uint64)  # one for each row, and one that is always there
        yield np.concatenate([t.token, starts]), np.concatenate([held, t.held_out, [True]])
        yield t.pair, held
        yield t.triples(), held[t.later]

    def question(shard: int, table: pa.Table):
        parts = [[] for _ in range(shards.n)]
        for k, (keys, held) in enumerate(kinds(Tokens(table, folds, held_out))):
            found, counts = _counted(keys, held)
            cut = shards.cuts(found)
            for b, part in enumerate(parts):
                own = found[cut[b] : cut[b + 1]]
                part += [pack_keys(own, least[b], drop) if k else own, pack_counts(counts[cut[b] : cut[b + 1]])]
        return [(b, pack(*part)) for b, part in enumerate(parts)]

    def reply(got):
        out = [[] for _ in got]
        total = distinct = 0
        for k in (0, 2, 4):
            keys = [q[k] if k == 0 else unpack_keys(q[k]) for _, q in got]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, np.concatenate([unpack_counts(q[k + 1]) for _, q in got])).astype(np.int64)
            if k == 0:
                total, distinct = int(sums.sum()), int((sums > 0).sum())
            for part, whole in zip(out, np.split(sums[place], np.cumsum([len(x) for x in keys])[:-1]), strict=True):
                part.append(pack_counts(whole))
        return [(s, pack(total, distinct, *part)) for (s, _), part in zip(got, out, strict=True)]

    def use(shard: int, table: pa.Table, got):
        known = []  # distinct keys of each kind in the shard, and their counts
        for k, (keys, _) in enumerate(kinds(Tokens(table, folds, held_out))):
            known.append((np.unique(keys), np.concatenate([unpack_counts(a[k + 2]) for _, a in got]).astype(np.int64)))
        starts = int(known[0][1][np.searchsorted(known[0][0], _START)])
        total = sum(a[0] for _, a in got) - starts
        distinct = sum(a[1] for _, a in got) - (starts > 0)
        return pa.concat_tables([scored(part, known, starts, total, distinct) for part in parts(table)] or [scored(table, known, starts, total, distinct)])

    def scored(table: pa.Table, known, starts: int, total: int, distinct: int):
        """The scores of some rows of a shard, by the automaton of the arcs that these rows can use."""
        t = Tokens(table, folds, held_out)

        def numbered(keys: np.ndarray, k: int):
            """The first place of each distinct key, the number of each key among these, and the counts."""
            own, at, place = np.unique(keys, return_index=True, return_inverse=True)
            return at, place, known[k][1][np.searchsorted(known[k][0], own)]

        _, word, counts = numbered(t.token, 0)
        before = np.concatenate([[-1], word[:-1]]) if len(word) else word
        before[t.first[:-1]] = -1
        at, pair, times = numbered(t.pair, 1)
        pairs = before[at], word[at], times
        later = np.flatnonzero(t.later)
        at, third, times = numbered(t.triples(), 2)
        triple = np.full(len(word), -1)
        triple[later] = third
        automaton = BackoffAutomaton(counts, total, distinct, starts, pairs, (pair[later[at] - 1], pair[later[at]], times), priors)
        added = lambda x: np.add.reduceat(x, t.first[:-1]) if len(t.held_out) else x
        return pa.table(
            {
                "doc_id": table.column("id"),
                "held_out": pa.array(t.held_out),
                "n_tokens": pa.array(np.diff(t.first), pa.int64()),
                "n_known": pa.array(added((counts[word] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(t.held_out), total), pa.int64()),
                "base_score": pa.array(added(automaton.root_weight[word])),
                "score": pa.array(added(automaton.traverse(t.first, word, pair, triple))),
            }
        )

    return shards.back(shards.answer(shards.ask(question), reply), use, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
