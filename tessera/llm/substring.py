"""Substring deduplication by relative Lempel-Ziv parsing.

Stretches of text are factored greedily against reference blocks: a factor is the longest run of words that also starts elsewhere in the
block. Factors of at least `window` words are duplicate spans, and only the windows over the end of a factor are looked up
in the block's index besides. Every word that a repeated window covers is removed.

A block need not hold the whole corpus. Of each window's short word sequences the one with the least hash is its anchor; equal
windows have equal anchors, so the block of an anchor's hash meets all occurrences of its windows. Step one asks which
anchors occur more than once; step two sends the words around those to their blocks, each distinct stretch once a shard with a count;
blocks parse and send back a bit for each window. Windows of very frequent anchors travel singly to the block of
their own hash, so a passage that a large share of the texts hold is spread over blocks, and each shard sends one copy.

Nulls have no words, texts shorter than a window lose nothing. Repeated rows are repeated texts. Windows are judged on the
input, not on what is left. Other columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import Exchange, pack, pack_counts, strings, unpack_counts
from tessera.llm.textops import SPACE_WORDS, Words, kgram_hashes, mix, window_starts

WINDOW, ANCHOR = 35, 12
#: Anchors that more than so many shards' sums tell of send their windows singly.
FREQUENT = 2000
#: Parts of a block that are indexed one after the other.
PARTS = 16
_SPREAD = np.uint64(0x5851F42D4C957F2D)


class Windows:
    """The windows of a shard's texts: where they start, their hashes, and the run of windows of each anchor."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.words = words = Words(table.column("text"), SPACE_WORDS)
        self.window = window
        self.start = window_starts(words.rows, window)
        grams = kgram_hashes(words.hash, anchor)
        if not len(self.start):
            self.hash = self.key = np.zeros(0, np.uint64)
            self.low = self.high = self.run = np.zeros(0, np.int64)
            return
        self.hash = kgram_hashes(words.hash, window)[self.start]
        # leftmost least hash of the window's sequences: upper bits of the hash, then the place
        least = (grams >> np.uint64(28) << np.uint64(28)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 28) - 1))
        span, done = window - anchor + 1, 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        place = (least[self.start] & np.uint64((1 << 28) - 1)).astype(np.int64)
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (self.start[1:] != self.start[:-1] + 1)
        self.low = np.flatnonzero(fresh)  # first and last window of each anchor's run
        self.high = np.append(self.low[1:], len(place)) - 1
        self.key = mix(grams[place[self.low]] + _SPREAD)  # least hashes are mixed again, to spread over the buckets

    def stretches(self) -> np.ndarray:
        """A hash of the words of each run: its windows at both ends cover them all."""
        return _stretch(self.hash[self.low], self.hash[self.high], self.high - self.low)


def _stretch(first: np.ndarray, last: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(3) + mix(last + more.astype(np.uint64)))


class ReferenceBlock:
    """An index of the stretches of words of a block: their suffixes in order, and matches looked up in it."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, window: int):
        """symbols: of all stretches, one after the other; first: where each begins, and the end."""
        self.first, self.window, self.n = first, window, len(symbols)
        n, m = len(symbols), len(first) - 1
        text = np.empty(n + m, np.int64)
        self.place = np.arange(n) + np.repeat(np.arange(m), np.diff(first))
        gap = np.ones(n + m, bool)
        gap[self.place] = False
        text[gap] = np.arange(m)  # every end is a symbol of its own
        text[self.place] = symbols + m
        # ranks of the sequences of 1, 2, 4, ... words from each place, up to the longest stretch
        self.ranks, width = [np.unique(text, return_inverse=True)[1]], 1
        while width < int(np.diff(first).max(initial=1)):
            second = np.zeros(n + m, np.int64)
            second[:-width] = self.ranks[-1][width:] + 1
            self.ranks.append(np.unique(self.ranks[-1] * (n + m + 2) + second, return_inverse=True)[1])
            width *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.rank = np.empty(n + m, np.int64)
        self.rank[self.order] = np.arange(n + m)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal symbols from places a and b on."""
        common, size = np.zeros(len(a), np.int64), len(self.rank)
        for level in range(len(self.ranks) - 1, -1, -1):
            x, y = a + common, b + common
            same = (x < size) & (y < size)
            same[same] = self.ranks[level][x[same]] == self.ranks[level][y[same]]
            common[same] += 1 << level
        return common

    def match(self, at: np.ndarray) -> np.ndarray:
        """The longest stretch from each word on that also starts elsewhere in the block: next to it in the order of suffixes."""
        place = self.place[at]
        rank, longest = self.rank[place], np.zeros(len(at), np.int64)
        for step in (-1, 1):
            on = np.flatnonzero((rank + step >= 0) & (rank + step < len(self.order)))
            longest[on] = np.maximum(longest[on], self._common(place[on], self.order[rank[on] + step]))
        return longest

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the greedy factors of all stretches; a word that is nowhere else is a factor of one."""
        at, end = self.first[:-1].copy(), self.first[1:]
        starts, lengths = [], []
        while len(at):
            length = np.maximum(self.match(at), 1)
            starts.append(at)
            lengths.append(length)
            at = at + length
            on = at < end
            at, end = at[on], end[on]
        return (np.concatenate(starts), np.concatenate(lengths)) if starts else (np.zeros(0, np.int64),) * 2

    def repeated(self) -> np.ndarray:
        """Whether the window that starts at each word occurs elsewhere in the block.

        Windows inside a factor do. No other window is looked up but those over a factor's end: they start less than a window before it.
        """
        start, length = self.parse()
        inside = self._spread(start, length - self.window + 1)
        end = start + length
        begin = np.repeat(self.first[:-1], np.diff(self.first))[start]  # of each factor's stretch
        low = np.maximum(end - self.window + 1, begin)
        over = self._spread(low, end - low)
        fits = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n) >= self.window
        asked = np.flatnonzero(over & fits & ~inside)
        inside[asked] = self.match(asked) >= self.window
        return inside

    def _spread(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Marks so many words from each start on; none if not positive."""
        on = length > 0
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, start[on], 1)
        np.add.at(edge, (start + length)[on], -1)
        return np.cumsum(edge[:-1]) > 0


def mark(documents: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: kept is the text of the words that stay, joined by one space."""
    shards = Exchange(documents, key, text)

    def first_question(shard: int, table: pa.Table):
        keys, counts = np.unique(Windows(table, window, anchor).key, return_counts=True)
        cut = shards.cuts(keys)
        return [(b, pack(keys[x:y], pack_counts(counts[x:y]))) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]

    def first_reply(got):
        keys, place = np.unique(np.concatenate([q[0] for _, q in got]), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack_counts(q[1]) for _, q in got]), len(keys))
        level = (total > 1).astype(np.uint8) + (total > frequent)
        parts = np.split(level[place], np.cumsum([len(q[0]) for _, q in got])[:-1])
        return [(s, pack(q[0][p > 0], p[p > 0])) for (s, q), p in zip(got, parts, strict=True) if p.any()]

    def second_question(shard: int, table: pa.Table, got):
        out = []
        if got:
            w = Windows(table, window, anchor)
            keys, level = np.concatenate([a[0] for _, a in got]), np.concatenate([a[1] for _, a in got])
            at = np.minimum(np.searchsorted(keys, w.key), len(keys) - 1)
            own = np.where(keys[at] == w.key, level[at], 0)
            usual = np.flatnonzero(own == 1)
            single = np.concatenate([np.zeros(0, np.int64), *(np.arange(x, y + 1) for x, y in zip(w.low[own == 2].tolist(), w.high[own == 2].tolist(), strict=True))])
            low, high = np.concatenate([w.low[usual], single]), np.concatenate([w.high[usual], single])
            route = np.concatenate([w.key[usual], w.hash[single]])
            name = _stretch(w.hash[low], w.hash[high], high - low)
            _, first, times = np.unique(name, return_index=True, return_counts=True)
            order = np.argsort(route[first], kind="stable")
            first, times = first[order], times[order]
            cut = shards.cuts(route[first])
            for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    some = first[x:y]
                    texts = [w.words.text(i, j) for i, j in zip(w.start[low[some]].tolist(), (w.start[high[some]] + window - 1).tolist(), strict=True)]
                    out.append((b, pack(name[some], np.minimum(times[x:y], 2).astype(np.uint8), b"".join(texts), np.array([len(t) for t in texts], np.int32), (mix(route[some]) % np.uint64(PARTS)).astype(np.uint8))))
        return shards.routed([(shard, shards.ids[b], data) for b, data in out])

    def second_reply(got):
        # equal windows have equal routes: a block is indexed in parts, one at a time
        whole = []
        for s, (names, times, joined, size, part) in got:
            offs = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(joined)])
            whole.append((s, names, times, texts, part))
        out = []
        for k in range(PARTS):
            mine = [(s, names[on], times[on], texts.take(pa.array(on))) for s, names, times, texts, part in whole if len(on := np.flatnonzero(part == k))]
            if mine:
                out += block_reply(mine)
        return out

    def block_reply(got):
        names = np.concatenate([q[1] for q in got])
        distinct, first, place = np.unique(names, return_index=True, return_inverse=True)
        copies = np.bincount(place, np.concatenate([q[2] for q in got]), len(distinct)) > 1
        data = pa.concat_arrays([q[3] for q in got]).take(pa.array(first))
        words = Words(data, SPACE_WORDS)
        symbols = np.unique(words.hash, return_inverse=True)[1]
        block = ReferenceBlock(symbols, words.rows.astype(np.int64), window)
        repeated = block.repeated() | np.repeat(copies, np.diff(words.rows))
        n = np.diff(words.rows) - window + 1  # windows of each distinct stretch
        out = []
        for q, mine in zip(got, np.split(place, np.cumsum([len(q[1]) for q in got])[:-1]), strict=True):
            take = np.arange(n[mine].sum()) + np.repeat(words.rows[mine] - (np.cumsum(n[mine]) - n[mine]), n[mine])
            bits = repeated[take]
            if bits.any():
                out.append((q[0], pack(q[1], n[mine].astype(np.int32), np.packbits(bits))))
        return out

    def use(shard: int, table: pa.Table, got):
        w = Windows(table, window, anchor)
        words = w.words
        rows, n = words.rows, len(words.hash)
        gone = np.zeros(n + 1, np.int64)
        if got and len(w.start):
            names = np.concatenate([a[0] for _, a in got])
            size = np.concatenate([a[1] for _, a in got]).astype(np.int64)
            bits = np.concatenate([np.unpackbits(a[2], count=int(a[1].sum())) for _, a in got])
            begin = np.cumsum(size) - size
            order = np.argsort(names, kind="stable")
            names, size, begin = names[order], size[order], begin[order]

            def lookup(asked, low):
                at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                hit = np.flatnonzero(names[at] == asked)
                at, m = at[hit], size[at[hit]]
                lane = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                again = bits[np.repeat(begin[at], m) + lane] > 0
                return (np.repeat(low[hit], m) + lane)[again]

            dup = [lookup(w.stretches(), w.low)]
            if (size == 1).any():
                dup.append(lookup(_stretch(w.hash, w.hash, np.zeros(len(w.hash), np.int64)), np.arange(len(w.hash))))
            start = np.unique(np.concatenate(dup))
            gone[w.start[start]] += 1
            gone[w.start[start] + window] -= 1
        removed = np.cumsum(gone[:-1]) > 0
        kept = np.flatnonzero(~removed)
        row = np.searchsorted(rows, kept, "right") - 1
        more = np.zeros(len(kept), bool)  # another kept word follows in the row
        more[:-1] = row[1:] == row[:-1]
        data, on = words.bytes.copy(), np.zeros(len(words.bytes) + 1, np.int8)
        on[words.start[kept]] += 1
        on[words.end[kept]] -= 1
        on = np.cumsum(on[:-1], dtype=np.int8) > 0
        after = words.end[kept[more]]
        data[after], on[after] = 32, True
        lengths = np.zeros(len(rows) - 1, np.int64)
        np.add.at(lengths, row, words.end[kept] - words.start[kept] + more)
        offs = np.concatenate([[0], np.cumsum(lengths)])
        text = strings(offs, data[on])
        total = np.concatenate([[0], np.cumsum(removed)])
        return pa.table({"doc_id": table.column("id"), "n_words": pa.array(np.diff(rows), pa.int64()), "n_removed": pa.array(total[rows[1:]] - total[rows[:-1]], pa.int64()), "kept": text})

    anchors = shards.answer(shards.ask(first_question), first_reply)
    spans = shards.answer(shards.back(anchors, second_question, "_shard int, _bucket int, data binary"), second_reply)
    return shards.back(spans, use, "doc_id long, n_words long, n_removed long, kept string")


def digests(documents: DataFrame) -> DataFrame:
    """op5: per document the numbers of words and removed words, and a digest of what is kept."""
    return mark(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
