"""Benchmark decontamination by an FM-index of each training shard.

Benchmark windows are searched backward in the Burrows-Wheeler transform of a shard through wavelet-matrix ranks, all
windows at once; occurrences are located by walking to sampled suffix positions, and the spans they cover are merged.

A filter stands before the index: words that no window holds, and neighbours that no window holds side by side, cut the text
into runs; runs shorter than the shortest window cannot hold one and are not indexed. This loses nothing, and where little text is
like the benchmark, the index is small.

Null texts have no words. Items without words have no window; a null item id is never listed, though its windows count
as hits. Ids of any type are listed as strings. Repeated documents each get their row; repeated items count once. Other columns pass through, but for those
named as the results, which are replaced. Empty documents give an empty result; an empty benchmark hits nothing.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import written
from tessera.llm.textops import ALNUM_WORDS, Words, sliced

WINDOW = 13
#: Benchmark items of one pass over the documents; more items mean more passes, each with a broadcast of this bound.
BLOCK = 50_000
#: Bytes of text that are searched at once (a shard of the index), or one text.
PART = 1 << 23
_EVERY = 8  # suffix samples


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of queries."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (sequence >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(place)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            low, place = np.where(one, zeros + ones[low], low - ones[low]), np.where(one, zeros + ones[place], place - ones[place])
        return place - low

    def symbol(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[place + 1] - ones[place]
            out = out << 1 | one
            place = np.where(one == 1, zeros + ones[place], place - ones[place])
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text whose 0s are separators, each taken as a symbol of its own."""
    n = len(text)
    rank = np.empty(n, np.int64)
    gap = text == 0
    rank[gap] = np.arange(gap.sum())
    rank[~gap] = gap.sum() + text[~gap]
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + n + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0], fresh[1:] = False, key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """An index of integer symbols 1..symbols-1, with 0 between sequences; the text ends with a 0."""

    def __init__(self, text: np.ndarray, symbols: int, run_starts: np.ndarray):
        order = suffix_order(text)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(bwt, symbols)
        sampled = np.zeros(len(text), bool)
        sampled[::_EVERY] = True
        sampled[run_starts] = True  # a walk never crosses a separator
        sampled[text == 0] = True
        self.sampled = sampled[order]
        self.samples = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of patterns (right-aligned in a matrix)."""
        width = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.before[-1], np.int64)
        for j in range(width - 1, -1, -1):
            on = np.flatnonzero((width - j <= lengths) & (low < high))
            if len(on):
                c = patterns[on, j]
                low[on] = self.before[c] + self.tree.rank(c, low[on])
                high[on] = self.before[c] + self.tree.rank(c, high[on])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        out, steps, rows, open_ = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.samples[rows[done]] + steps
            open_, rows = open_[~done], rows[~done]
            c = self.tree.symbol(rows)
            rows = self.before[c] + self.tree.rank(c, rows)
            steps += 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a block of benchmark items."""

    window: int = WINDOW
    words: list[bytes] = field(default_factory=list)  # word i has symbol i + 1
    patterns: np.ndarray = None
    lengths: np.ndarray = None
    items: list[list] = field(default_factory=list)

    @classmethod
    def of(cls, ids: list, texts: list, window: int = WINDOW) -> Phrases:
        words = Words(pa.array(texts, pa.string()), ALNUM_WORDS, lower=True)
        hashes, first, symbol = np.unique(words.hash, return_index=True, return_inverse=True)
        out = cls(window)
        out.hashes = hashes
        out.words = [words.bytes[words.start[i] : words.end[i]].tobytes() for i in first]
        seen: dict[tuple, set] = {}
        for k, item in enumerate(ids):
            own = (symbol[words.rows[k] : words.rows[k + 1]] + 1).tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                seen.setdefault(tuple(own[i : i + window]), set()).add(item)
        out.lengths = np.array([len(w) for w in seen], np.int64)
        out.patterns = np.zeros((len(seen), window), np.int64)
        for row, w in zip(out.patterns, seen, strict=True):
            row[window - len(w) :] = w
        out.items = [sorted(x for x in s if x is not None) for s in seen.values()]
        base = len(out.words) + 1
        out.pairs = np.unique(np.array([a * base + b for w in seen for a, b in zip(w, w[1:], strict=False)], np.int64))
        return out


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def hits(column, phrases: Phrases) -> tuple[Words, np.ndarray, list[list]]:
    """The words of a shard, which of them are hit, and the items that occur in each row."""
    words = Words(column, ALNUM_WORDS, lower=True)
    n, rows = len(words.hash), words.rows
    hit, items = np.zeros(n, bool), [[] for _ in range(len(rows) - 1)]
    if not n or not len(phrases.lengths):
        return words, hit, items
    at = np.minimum(np.searchsorted(phrases.hashes, words.hash), len(phrases.hashes) - 1)
    symbol = np.where(phrases.hashes[at] == words.hash, at + 1, 0)
    joined = np.zeros(n, bool)  # word i goes on from word i - 1
    joined[1:] = (symbol[1:] > 0) & (symbol[:-1] > 0) & _member(phrases.pairs, symbol[:-1] * (len(phrases.words) + 1) + symbol[1:])
    joined[rows[:-1][rows[:-1] < n]] = False
    start = np.flatnonzero((symbol > 0) & ~joined)
    end = np.flatnonzero((symbol > 0) & ~np.append(joined[1:], False)) + 1
    long = end - start >= phrases.lengths.min()
    start, end = start[long], end[long]
    if not len(start):
        return words, hit, items
    size = end - start
    place = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(place[-1], np.int64)
    inner = np.arange(size.sum()) + np.repeat(place[:-1] - (np.cumsum(size) - size), size)
    source = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    kept = symbol[source]
    # equal hashes, but other words: such runs hold no window
    other = [phrases.words[s - 1] != words.bytes[a:b].tobytes() for s, a, b in zip(kept.tolist(), words.start[source].tolist(), words.end[source].tolist(), strict=True)]
    kept[np.array(other)] = 0
    text[inner] = kept
    back = np.full(place[-1], -1)
    back[inner] = source
    index = FMIndex(text, len(phrases.words) + 1, place[:-1])
    low, high = index.search(phrases.patterns, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    found = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
    first = back[index.locate(found)]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + phrases.lengths[which], -1)
    hit = np.cumsum(edges[:-1]) > 0
    row = np.searchsorted(rows, first, "right") - 1
    for r, w in zip(*np.unique(np.stack([row, which]), axis=1).tolist(), strict=True):
        items[r] += phrases.items[w]
    return words, hit, [sorted(set(x)) for x in items]


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def _pass(kept: DataFrame, text: str, phrases, names: tuple[str, str, str]) -> DataFrame:
    """Adds the number of words, spans and items under the names given; phrases: a broadcast."""
    own = kept.columns
    at = own.index(text)
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in sliced(batches, 2048, PART, at):
            words, hit, items = hits(batch.column(at), phrases.value)
            n = len(hit)
            begins = hit.copy()
            begins[1:] &= ~hit[:-1]
            begins[words.rows[:-1][words.rows[:-1] < n]] |= hit[words.rows[:-1][words.rows[:-1] < n]]
            a = np.flatnonzero(begins)
            ends = hit & ~np.append(hit[1:] & ~begins[1:], False)[:n]
            b = np.flatnonzero(ends) + 1
            cut = np.searchsorted(a, words.rows)
            local = np.repeat(words.rows[:-1], np.diff(cut))
            spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(a - local), pa.array(b - local)], fields=list(struct)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.counts(), pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], [*own, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(name, f.dataType) for name, f in zip(names, _RESULT.fields, strict=True))]))


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, block: int):
    """The phrases of one block of items after the other; of an empty benchmark one empty block."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0).distinct()
    ids, texts, any_ = [], [], False
    for row in items.orderBy("i", "t").toLocalIterator():
        if len(ids) == block:
            yield Phrases.of(ids, texts, window)
            ids, texts, any_ = [], [], True
        ids.append(row.i)
        texts.append(row.t)
    if ids or not any_:
        yield Phrases.of(ids, texts, window)


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", *, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Adds n_words, spans (merged word ranges [start, end) that windows cover) and items (ids that occur, as strings) to each row.

    Columns of those names are replaced. Benchmark rows are taken in blocks of `block` items, one on the driver at a time (and the
    next, so that the last is known). Where there are several, the result of each pass is written to the shared folder,
    and its broadcast is freed before the next.
    """
    out = documents.drop(*set(documents.columns) & set(_RESULT.names))
    spare = next(x for x in map("found{}_".format, itertools.count()) if not any(c.startswith(x) for c in out.columns))
    own, names, merge = out.columns, tuple(spare + x for x in _RESULT.names), False
    blocks = _blocks(benchmark, item_id, item_text, window, block)
    phrases = next(blocks)
    while phrases is not None:
        shared = documents.sparkSession.sparkContext.broadcast(phrases)
        after = _pass(out, text, shared, names if merge else tuple(_RESULT.names))
        if merge:
            after = after.select(*own, "n_words", merged(F.concat("spans", names[1])).alias("spans"), F.array_sort(F.array_union("items", names[2])).alias("items"))
        phrases = next(blocks, None)
        if phrases is not None:
            after = written(after)
            shared.destroy()
        out, merge = after, True
    return out


def merged(spans):
    """Sorted spans with overlapping ones made one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated (at least a twentieth of the words are hit) to the result of find()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with the columns they came with."""
    names = documents.columns
    renamed = documents.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes
    found = judged(find(renamed, benchmark, text=f"c{names.index('text')}")).where(~F.col("contaminated"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op4: counts and the digest of the occurring items of each document."""
    found = judged(find(documents.select("doc_id", "text"), benchmark))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
