"""Exact similarity join of sets, by T-occurrence search over inverted lists.

Elements of a set stand in one global order, frequent ones last. Two sets of similarity t share an element among their first
few (prefix filter); their sizes, the places of that element and a parity sketch bound their overlap from above (length,
position and sketch filters). What passes is searched: the lists of a query's elements are merged except for the longest,
and what the merge leaves possible is probed in those (DivideSkip); sets with the overlap required are links.

It runs in two rounds. Stars: sets with an equal key of min-hashes are compared with the first such set only, which joins nearly all
near copies at a cost linear in their number. Lists: all other pairs that pass the filters. The caller's `state` of
the sets says which pairs the second round may leave out (those in one component, or those that decide nothing), and sets
that equal an earlier one, which has the same partners, take no part in it at all. A bucket's lists are compared in parts of
bounded size.

A shard holds equal sets once; equal elements of a shard cross the network once where only a minimum matters. A set
travels to each shard that needs it once, and in the second round only after its sketch (two bits an element) has
been compared there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import PART, Exchange, pack, parts
from tessera.llm.store import written
from tessera.llm.textops import mix, sliced

#: Keys of a set in the first round, and min-hashes of each key.
STARS, DEPTH = 4, 4
#: An element is frequent if more than one in so many sets hold it; at most SPREAD x mean size are.
SPREAD = 20_000
#: Sets of at most so many elements send a sketch of 32 or of 64 bits, larger ones of 128.
LEVELS = (24, 80)
#: Postings of a bucket that are compared at once.
POSTINGS = 400_000
#: The state of a set that equals an earlier one.
LEFT_OUT = -1
#: Postings that are merged at once.
GROUP = 1 << 20
_LINK = "shard int, item long, id long, other_shard int, other_item long, other_id long, same boolean"


class Rarity:
    """The global order: elements that many sets hold, sorted, and the rank of each by how many; all others come first."""

    def __init__(self, keys: np.ndarray = (), ranks: np.ndarray = ()):
        self.keys, self.ranks = np.asarray(keys, np.uint64), np.asarray(ranks, np.int64)
        self.bits = max(1, len(self.keys).bit_length() + 1)  # a slot of the hash space holds half an element
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def level(self, value: np.ndarray) -> np.ndarray:
        """Rank + 1 of the elements that are frequent, 0 of others."""
        out = np.zeros(len(value), np.uint64)
        if not len(self.keys):
            return out
        slot = (value >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        on = np.flatnonzero(at < end)
        at, end = at[on], end[on]
        while len(on):
            hit = self.keys[at] == value[on]
            out[on[hit]] = self.ranks[at[hit]] + 1
            at = at + 1
            more = ~hit & (at < end)
            on, at, end = on[more], at[more], end[more]
        return out


class Sets:
    """Sets of 64-bit elements: those of set i are values[first[i]:first[i + 1]], in the global order."""

    def __init__(self, item: np.ndarray, value: np.ndarray, items: int, rarity: Rarity | None = None):
        level = (rarity or Rarity()).level(value)
        # one number of item, level and the upper bits of the value orders all but ties, which are rare
        low = 64 - max(1, int(items).bit_length()) - max(1, int(level.max(initial=0)).bit_length())
        key = (item.astype(np.uint64) << np.uint64(64 - max(1, int(items).bit_length()))) | level << np.uint64(low) | value >> np.uint64(64 - low)
        order = np.argsort(key)
        key = key[order]
        item, value = item[order], value[order]
        if ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
            again = np.lexsort((value, key))
            item, value = item[again], value[again]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (value[1:] != value[:-1])
        self.item, self.values = item[fresh], value[fresh]
        self.size = np.bincount(self.item, minlength=items).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.full = np.flatnonzero(self.size)

    def _reduce(self, ufunc, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), np.uint64)
        if len(self.full):
            out[self.full] = ufunc.reduceat(x, self.first[self.full])
        return out

    def names(self) -> np.ndarray:
        """A hash of each whole set."""
        return mix(self._reduce(np.add, mix(self.values)) + self.size.astype(np.uint64))

    def sketches(self) -> np.ndarray:
        """Bit j of 128 is the parity of the number of elements that hash to j: two words of each set."""
        h = mix(self.values + np.uint64(99)) >> np.uint64(32)
        bit, high = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6) & np.uint64(1)) == 1
        return np.stack([self._reduce(np.bitwise_xor, np.where(high == k, bit, np.uint64(0))) for k in (False, True)])

    def wide_sketches(self, words: int) -> np.ndarray:
        """Parity sketches of so many words (a power of two), a row for each set."""
        h = mix(self.values + np.uint64(77))
        place = self.item * words + (h >> np.uint64(40) & np.uint64(words - 1)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        start = _starts(place[order])
        out = np.zeros(len(self.size) * words, np.uint64)
        if len(start):
            out[place[order][start]] = np.bitwise_xor.reduceat((np.uint64(1) << (h & np.uint64(63)))[order], start)
        return out.reshape(-1, words)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and elements of some sets."""
        n = self.size[which]
        return n, self.values[np.arange(n.sum()) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)]


class Bags:
    """The elements of items as they come, repeats among them, by rising item: enough for keys and copies, without a sort."""

    def __init__(self, item: np.ndarray, value: np.ndarray, items: int):
        self.first = np.searchsorted(item, np.arange(items + 1))
        self.value, self.size = value, np.diff(self.first)
        self.full = np.flatnonzero(self.size)

    def _reduce(self, ufunc, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), np.uint64)
        if len(self.full):
            out[self.full] = ufunc.reduceat(x, self.first[self.full])
        return out

    def names(self) -> np.ndarray:
        """A hash of each item's elements in their order."""
        place = np.arange(len(self.value)) - np.repeat(self.first[:-1], self.size)
        return mix(self._reduce(np.add, mix(self.value + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + self.size.astype(np.uint64))

    def star_keys(self, j: int) -> np.ndarray:
        """Key j of each item: a hash of several of its min-hashes."""
        key = np.full(len(self.size), j, np.uint64)
        for i in range(j * DEPTH, (j + 1) * DEPTH):
            key = mix(key * np.uint64(3) + self._reduce(np.minimum, self.value * _ODD[i]))
        return key


_SPREAD = np.uint64(0x5851F42D4C957F2D)
_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, STARS * DEPTH, dtype=np.uint64, endpoint=False) | np.uint64(1)


class Inverted:
    """Inverted lists of some sets."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        self.sizes = sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values, kind="stable")
        keys = values[order]
        self.posts = owner[order]  # ascending within a list
        self.start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[self.start]
        self.end = np.append(self.start[1:], len(keys))
        self.codes = np.repeat(np.arange(len(self.keys)), self.end - self.start) * len(sizes) + self.posts  # list and set, ascending

    def search(self, sizes: np.ndarray, values: np.ndarray, percent: int):
        """(queries, sets, whether equal) of similarity percent / 100 or more, by DivideSkip; queries are searched in groups of bounded work.

        sizes: elements of each query; values: these, one query after the other.
        """
        if not len(self.keys) or not len(values):
            return
        at = np.searchsorted(self.keys, values)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == values
        query, at = np.repeat(np.arange(len(sizes)), sizes)[known], at[known]
        n = self.end[at] - self.start[at]
        # the shortest lists of a query first; what may be set apart for probing comes last
        order = np.argsort(query * (len(self.posts) + 1) + n, kind="stable")
        query, at, n = query[order], at[order], n[order]
        begin = np.searchsorted(query, np.arange(len(sizes) + 1))
        lists = np.diff(begin)
        least = -(-percent * sizes // 100)  # what any partner shares at least
        longest = np.zeros(len(sizes), np.int64)
        longest[lists > 0] = n[begin[1:][lists > 0] - 1]
        long = np.bincount(query, n > 64, len(sizes)).astype(np.int64)
        apart = np.minimum(np.minimum((least / (0.01 * np.log2(np.maximum(longest, 2)) + 1)).astype(np.int64), least - 1), long)
        near = np.arange(len(query)) < (begin[1:] - apart)[query]
        hopeless = lists < least
        work = np.concatenate([[0], np.cumsum(np.bincount(query, n * near, len(sizes)))])
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(work, work[i] + GROUP, "right")) - 1)
            some = slice(begin[i], begin[j])
            yield self._group(query[some], at[some], near[some] & ~hopeless[query[some]], n[some], sizes, begin, apart, least, percent)
            i = j

    def _group(self, query, at, near, n, sizes, begin, apart, least, percent):
        """Merges the short lists of some queries and probes the long ones for what the merge leaves possible."""
        sets = len(self.sizes)
        m, s = n[near], self.start[at[near]]
        merged = np.repeat(query[near] * sets, m) + self.posts[np.arange(m.sum()) + np.repeat(s - (np.cumsum(m) - m), m)]
        merged.sort()
        first = _starts(merged)
        total = np.diff(np.append(first, len(merged)))
        q, found = np.divmod(merged[first], sets)
        a, b = sizes[q], self.sizes[found]
        ok = (total >= least[q] - apart[q]) & (total + apart[q] >= required(percent, a, b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        q, found, total = q[ok], found[ok], total[ok]
        for k in range(int(apart[q].max(initial=0))):  # the k-th list that each query sets apart
            on = np.flatnonzero(apart[q] > k)
            key = at[begin[q[on] + 1] - 1 - k - begin[query[0]]]
            code = key * sets + found[on]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            total[on] += self.codes[place] == code
        ok = 100 * total >= percent * (sizes[q] + self.sizes[found] - total)
        return q[ok], found[ok], ((total == sizes[q]) & (total == self.sizes[found]))[ok]


def required(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def first_of(names: np.ndarray) -> np.ndarray:
    """For each item the first of its name."""
    _, first, place = np.unique(names, return_index=True, return_inverse=True)
    return first[place]


def joined(arrays: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


class Join:
    """The join over the items of a table's shards.

    items(table, rarity, which) gives the sets of a shard (of the items `which` only, where it isn't None), and the id of
    each item's row; bags(table): (item, element, number of items) by rising item, and those ids; percent: the similarity.
    Items are in order of their row's id; the first of equal sets stands for all of them in its shard. lists() leaves the others out, so a
    caller gives them what it told the first, or has stars() link them to it (`link_equal`).
    """

    def __init__(self, shards: Exchange, items: Callable, bags: Callable, percent: int, rarity: Rarity | None = None, *, link_equal: bool = False):
        self.link_equal = link_equal
        self.shards, self.items, self.bags, self.percent = shards, items, bags, percent
        self.rarity = shards.rows.sparkSession.sparkContext.broadcast(rarity or Rarity())

    def starred(self, table: pa.Table):
        """Ids of the items, those that stand for themselves and others, which does for each, sizes and star keys of all."""
        ids, sizes, names, keys = [], [], [], []
        for part in parts(table):
            item, value, n, own_ids = self.bags(part)
            bags = Bags(item, value, n)
            ids.append(own_ids)
            sizes.append(bags.size)
            names.append(bags.names())
            keys.append(np.stack([bags.star_keys(j) for j in range(STARS)]))
        first, sizes = first_of(joined(names, np.uint64)), joined(sizes)
        return joined(ids), np.flatnonzero((first == np.arange(len(first))) & (sizes > 0)), first, sizes, np.concatenate(keys, 1) if keys else np.zeros((STARS, 0), np.uint64)

    def sets(self, table: pa.Table):
        """Sizes and ids of the items, those that stand for themselves and others, and which does for each."""
        return self.prefixes(table, prefixes=False)[:4]

    def prefixes(self, table: pa.Table, prefixes: bool = True):
        """As sets(), and value, item and place of the prefix elements of those, by value, and the sketch of each item."""
        ids, sizes, names, sketches, found, count = [], [], [], [], [], 0
        for part in parts(table):
            sets, own_ids = self.items(part, self.rarity.value, None)
            ids.append(own_ids)
            sizes.append(sets.size)
            names.append(sets.names())
            if prefixes:
                sketches.append(sets.sketches())
                n = np.where(sets.size > 0, sets.size - -(-self.percent * sets.size // 100) + 1, 0)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                item = np.repeat(np.arange(len(n)), n)
                # in this order low hashes come first: mixed again, they spread over the buckets
                found.append((mix(sets.values[sets.first[item] + place] + _SPREAD), item + count, place))
            count += len(own_ids)
        first, sizes = first_of(joined(names, np.uint64)), joined(sizes)
        own = (first == np.arange(len(first))) & (sizes > 0)
        value, item, place = (joined([x[k] for x in found], np.int64 if k else np.uint64) for k in range(3))
        order = np.flatnonzero(own[item])
        order = order[np.argsort(value[order], kind="stable")]
        return sizes, joined(ids), np.flatnonzero(own), first, value[order], item[order], place[order], np.concatenate(sketches, 1) if sketches else np.zeros((2, 0), np.uint64)

    def subset(self, table: pa.Table, item: np.ndarray):
        """Sets and ids of the distinct ones of some items, these, and the place of each item among them."""
        which, at = np.unique(item, return_inverse=True)
        sets, ids = self.items(table, self.rarity.value, which)
        return sets, ids[which], which, at

    def equal(self, table: pa.Table, own: np.ndarray, keys: np.ndarray):
        """Those of `own` whose star keys are all those of another one, and the first whose set equals each one's: in another order or with repeats."""
        key = np.zeros(len(own), np.uint64)
        for row in keys[:, own]:
            key = mix(key * np.uint64(3) + row)
        _, place, times = np.unique(key, return_inverse=True, return_counts=True)
        alike = own[times[place] > 1]
        names = [self.subset(table, some)[0].names() for some in _pieces(table, alike)] if len(alike) else []
        return alike, alike[first_of(joined(names, np.uint64))]

    def stars(self) -> DataFrame:
        """Links between sets and the first set of equal key, and between equal sequences of a shard (with link_equal, equal sets)."""
        shards, starred, subset, percent = self.shards, self.starred, self.subset, self.percent
        equal = self.equal if self.link_equal else None

        def question(shard, table):
            ids, own, _, _, keys = starred(table)
            keys, first, times = np.unique(keys[:, own].ravel(), return_index=True, return_counts=True)  # the first item of a key is the least
            item = own[first % max(len(own), 1)]
            cut = shards.cuts(keys)
            return [(b, pack(keys[x:y], _small(item[x:y]), _near(ids[item[x:y]]), times[x:y] > 1)) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]

        def reply(got):
            key, item, many = (np.concatenate([q[k] for _, q in got]) for k in (0, 1, 3))
            ids = np.concatenate([_from_near(q[2]) for _, q in got])
            shard = np.repeat([s for s, _ in got], [len(q[0]) for _, q in got])
            order = np.lexsort((item, shard, ids, key))
            key, item, shard, many = key[order], item[order], shard[order], many[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(start, len(key)))
            head = np.repeat(start, n)
            lead = np.arange(len(key)) == head
            keep = ~lead | many  # a key of one item decides nothing
            head, to, key = head[keep], shard[keep], key[keep]
            return [(int(s), pack(item[head[shard[head] == s]], to[shard[head] == s], key[shard[head] == s])) for s in np.unique(shard[head])]

        def send(shard, table, got):
            """The first sets, to the shards that hold others of their keys."""
            out = []
            if got:
                item, to, key = (np.concatenate([a[k] for _, a in got]).astype(np.uint64 if k == 2 else np.int64) for k in range(3))
                sets, ids, item, at = subset(table, item)
                for s in np.unique(to):
                    on = to == s
                    which, place = np.unique(at[on], return_inverse=True)
                    out.append((int(s), shard, pack(item[which], ids[which], *sets.take(which), key[on], place)))
            return shards.routed(out)

        def verify(shard, table, got):
            links = _links()
            ids, own, first, sizes, own_keys = starred(table)
            if equal:
                alike, same = equal(table, own, own_keys)
                first[alike] = same
                first = first[first]  # copies follow what stands for them
            copies = np.flatnonzero((first != np.arange(len(first))) & (sizes > 0))
            for column, x in zip(links, (np.full(len(copies), shard), copies, ids[copies], np.full(len(copies), shard), first[copies], ids[first[copies]], np.ones(len(copies), bool)), strict=True):
                column.append(x)
            if got:
                source, item, other_id, sizes, values = _received(shards, got)
                keys = np.concatenate([a[4] for _, a in got])
                asked = own[np.isin(own_keys[:, own], keys).any(0)]
                _search(links, table, subset, asked, shard, Inverted(sizes, values), source, item, other_id, percent)
            return _table(links)

        return shards.back(shards.back(shards.answer(shards.ask(question), reply), send, "_shard int, _bucket int, data binary"), verify, _LINK)

    def lists(self, states: DataFrame | None, may_differ: Callable[[np.ndarray, np.ndarray], np.ndarray], matters: Callable[[np.ndarray, np.ndarray], np.ndarray], default: Callable) -> DataFrame:
        """Links between sets that share a prefix element and pass the filters.

        states: (_shard, _bucket, data) with packed (items, states); default(shard, items) gives the state of items that have none.
        may_differ(state, other state) says which pairs matter, matters(least state, greatest state) which lists can hold such pairs.
        """
        shards, prefixes, subset, percent = self.shards, self.prefixes, self.subset, self.percent

        def question(shard, table, got):
            sizes, ids, _, _, value, item, place, sketch = prefixes(table)
            state, level = default(shard, np.arange(len(ids))), _level(sizes)
            for _, (which, told) in got:
                state[which] = told
            odd = state != default(shard, np.arange(len(ids)))
            on = np.flatnonzero(state[item] != LEFT_OUT)
            order = on[np.argsort(value[on])]
            value, item, place = value[order], item[order], place[order]
            cut = shards.cuts(value)
            out = []
            for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    i = item[x:y]
                    told = np.flatnonzero(odd[i])
                    by_level = [sketch[:, i[level[i] == k]] for k in range(3)]
                    short = _fold(by_level[0][0] ^ by_level[0][1]).astype(np.uint32), by_level[1][0] ^ by_level[1][1], by_level[2]
                    out.append((shard, shards.ids[b], pack(shards.short(value[x:y], b), _small(i), _small(place[x:y]), _small(sizes[i]), short, _small(told), _small(state[i[told]]))))
            return shards.routed(out)

        def reply(got):
            asked = [(s, _Postings(q)) for s, q in got]
            top = np.cumsum([0, *(int(p.item.max()) + 1 for _, p in asked)])  # each item of each shard gets a number
            owner, names = np.array([s for s, _ in asked]), int(top[-1])
            every = sum(len(p.value) for _, p in asked)
            cuts = np.linspace(0, max(int(p.value[-1]) for _, p in asked) + 1, -(-every // POSTINGS) + 1).astype(np.int64)
            pairs = []  # each one number
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                pairs += compared([(s, k, p.between(low, high)) for k, (s, p) in enumerate(asked)], top, names)
                if sum(map(len, pairs)) > 1_000_000:
                    pairs = [np.unique(np.concatenate(pairs))]
            if not pairs:
                return []
            x, y = np.divmod(np.unique(np.concatenate(pairs)), names)
            place, other = np.searchsorted(top, x, "right") - 1, np.searchsorted(top, y, "right") - 1
            cut = np.append(_starts(place), len(x)).tolist()
            return [(int(owner[place[i]]), pack(_small(x[i:j] - top[place[i]]), _small(owner[other[i:j]]), _small(y[i:j] - top[other[i:j]]))) for i, j in zip(cut[:-1], cut[1:], strict=True)]

        def compared(some, top, names):
            """Pairs of the items of some lists that pass the filters, those of a list by rising size."""
            value = np.concatenate([p.value for _, _, p in some])
            size, place = (np.concatenate([getattr(p, n) for _, _, p in some]).astype(np.int64) for n in ("size", "place"))
            number = np.concatenate([p.item.astype(np.int64) + top[k] for _, k, p in some])
            state = np.concatenate([p.states(default(s, p.item.astype(np.int64))) for s, _, p in some])
            order = np.lexsort((size, value))  # rising sizes within a list: partners that are too large come last
            start = _starts(value[order])
            if not len(start):
                return []
            ordered = state[order]
            use = matters(np.minimum.reduceat(ordered, start), np.maximum.reduceat(ordered, start))  # lists of one, among others, decide nothing
            n = np.diff(np.append(start, len(value)))
            order = order[np.repeat(use & (n > 1), n)]
            sketch = np.concatenate([p.sketches() for _, _, p in some], 1)[:, order]
            number, place, size, state, value = (x[order] for x in (number, place, size, state, value))
            level, word = _level(size), sketch[0] ^ sketch[1]
            half = _fold(word)
            start = _starts(value)
            n = np.diff(np.append(start, len(value)))
            end = np.repeat(start + n, n)
            pairs = []
            at, step = np.arange(len(value)), 1  # element i against element i + step of its list
            while True:
                at = at[at + step < end[at]]
                if not len(at):
                    return pairs
                x, y = at, at + step
                a, b = size[x], size[y]
                t = required(percent, a, b)
                ok = (a - place[x] >= t) & (100 * a >= percent * b)  # what fails here fails with all that follow
                at, y, b, t = at[ok], y[ok], b[ok], t[ok]
                ok = (b - place[y] >= t) & may_differ(state[at], state[y])
                x, y, b, t = at[ok], y[ok], b[ok], t[ok]
                a = size[x]
                low = np.minimum(level[x], level[y])  # sketches are compared as the shorter one is
                ok = np.bitwise_count(np.where(low > 0, word[x] ^ word[y], half[x] ^ half[y])) <= a + b - 2 * t
                x, y, a, b, t, low = x[ok], y[ok], a[ok], b[ok], t[ok], low[ok]
                apart = np.bitwise_count(sketch[0, x] ^ sketch[0, y]).astype(np.int64) + np.bitwise_count(sketch[1, x] ^ sketch[1, y])
                ok = (low < 2) | (apart <= a + b - 2 * t)
                if ok.any():
                    pairs.append(number[x[ok]] * names + number[y[ok]])
                    if sum(map(len, pairs)) > 1_000_000:
                        pairs = [np.unique(np.concatenate(pairs))]
                step += 1

        def outline(shard, table, got):
            """Sketches of the sets, two bits an element or more, to the shards of their candidates."""
            out = []
            if got:
                item, to, other = (np.concatenate([a[k] for _, a in got]).astype(np.int64) for k in range(3))
                sets, _, item, at = subset(table, item)
                words = _sketch_words(sets.size)
                wide = {w: sets.wide_sketches(w) for w in np.unique(words).tolist()}
                for s in np.unique(to):
                    which, place = np.unique(at[to == s], return_inverse=True)
                    out.append((int(s), shard, pack(_small(item[which]), _small(sets.size[which]), np.concatenate([wide[w][i] for i, w in zip(which.tolist(), words[which].tolist(), strict=True)]), _small(other[to == s]), _small(place))))
            return shards.routed(out)

        def compare(shard, table, got):
            """The candidates whose sketches leave the required overlap possible, back to the shards of the sets."""
            out = []
            if got:
                mine = np.concatenate([a[3] for _, a in got]).astype(np.int64)
                sets, _, mine, at = subset(table, mine)
                cut, wide = 0, {}
                for b, (item, size, sketch, other, place) in got:
                    own, place, size = at[cut : cut + len(other)], place.astype(np.int64), size.astype(np.int64)
                    cut += len(other)
                    words = _sketch_words(size)
                    begin = np.cumsum(words) - words
                    a, b_ = size[place], sets.size[own]
                    most, apart = a + b_ - 2 * required(percent, a, b_), np.zeros(len(place), np.int64)
                    for w in np.unique(words).tolist():
                        if w not in wide:
                            wide[w] = sets.wide_sketches(w)
                        on = np.flatnonzero(words[place] == w)
                        for i in range(0, len(on), 4096):
                            some = on[i : i + 4096]
                            theirs = sketch[begin[place[some]][:, None] + np.arange(w)]
                            apart[some] = np.bitwise_count(theirs ^ wide[w][own[some]]).sum(1)
                    ok = apart <= most
                    if ok.any():
                        out.append((shards.ids[b], shard, pack(item[place[ok]], np.full(ok.sum(), shard), mine[own[ok]])))
            return shards.routed(out)

        def send(shard, table, got):
            out = []
            if got:
                item, to, other = (np.concatenate([a[k] for _, a in got]).astype(np.int64) for k in range(3))
                sets, ids, item, at = subset(table, item)
                for s in np.unique(to):
                    which, place = np.unique(at[to == s], return_inverse=True)
                    out.append((int(s), shard, pack(item[which], ids[which], *sets.take(which), other[to == s], place)))
            return shards.routed(out)

        def verify(shard, table, got):
            links = _links()
            if got:
                source, item, other_id, sizes, values = _received(shards, got)
                asked = np.unique(np.concatenate([a[4] for _, a in got]).astype(np.int64))
                _search(links, table, subset, asked, shard, Inverted(sizes, values), source, item, other_id, percent)
            return _table(links)

        asked = shards.back(states if states is not None else shards.nothing(), question, "_shard int, _bucket int, data binary")
        found = shards.answer(asked, reply)
        for step in (outline, compare, send):
            found = shards.back(found, step, "_shard int, _bucket int, data binary")
        return shards.back(found, verify, _LINK)


class _Postings:
    """A shard's postings of a bucket, by value, as they came; or those of a range of values."""

    def __init__(self, question: tuple):
        self.value, self.item, self.place, self.size, self.short, self.told, self.told_states = question
        level = _level(self.size)
        self.begin = [np.concatenate([[0], np.cumsum(level == k)]) for k in range(3)]  # where each posting's sketch is among those of its level
        self.low, self.high = 0, len(self.value)

    def between(self, low: int, high: int) -> _Postings:
        """Those of values from low up to (not including) high."""
        out = object.__new__(_Postings)
        x, y = np.searchsorted(self.value, [low, high]).tolist()
        out.value, out.item, out.place, out.size = self.value[x:y], self.item[x:y], self.place[x:y], self.size[x:y]
        out.short = tuple(part[..., begin[x] : begin[y]] for part, begin in zip(self.short, self.begin, strict=True))
        i, j = np.searchsorted(self.told, [x, y])
        out.told, out.told_states = self.told[i:j].astype(np.int64) - x, self.told_states[i:j]
        return out

    def states(self, default: np.ndarray) -> np.ndarray:
        default[self.told] = self.told_states
        return default

    def sketches(self) -> np.ndarray:
        level, out = _level(self.size), np.zeros((2, len(self.value)), np.uint64)
        for k in range(2):
            out[0, level == k] = self.short[k]
        out[:, level == 2] = self.short[2]
        return out


def _sketch_words(size: np.ndarray) -> np.ndarray:
    """Words of a sketch of at least two bits an element: a power of two, four at least."""
    return (1 << np.ceil(np.log2(np.maximum(size / 32, 4))).astype(np.int64)).astype(np.int64)


def _level(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, size)


def _fold(word: np.ndarray) -> np.ndarray:
    """A sketch of 32 bits from one of 64."""
    return (word ^ word >> np.uint64(32)) & np.uint64(0xFFFFFFFF)


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _near(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Numbers as differences to the least of them."""
    least = int(x.min(initial=0))
    return least, _small((x - least).view(np.uint64))


def _from_near(near: tuple[int, np.ndarray]) -> np.ndarray:
    return near[1].astype(np.uint64).view(np.int64) + near[0]


def _starts(v: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)


def _links() -> list[list]:
    return [[] for _ in range(7)]


def _received(shards: Exchange, got):
    source = np.repeat([shards.ids[b] for b, _ in got], [len(a[0]) for _, a in got])
    item, ids, sizes, values = (np.concatenate([a[k] for _, a in got]) for k in range(4))
    return source, item, ids, sizes, values


def _pieces(table: pa.Table, items: np.ndarray) -> list[np.ndarray]:
    """Items of a shard in pieces, so that the words of about PART bytes of text are in memory."""
    return np.array_split(items, max(1, min(len(items), -(-table.nbytes // PART))))


def _search(links, table, subset, asked, shard, index: Inverted, source, item, other_id, percent) -> None:
    for names in _pieces(table, asked):
        sets, ids, names, _ = subset(table, names)
        for q, found, same in index.search(sets.size, sets.values, percent):
            i = names[q]
            other = (source[found] != shard) | (item[found] != i)
            q, i, found, same = q[other], i[other], found[other], same[other]
            # equal to an earlier one
            same &= (other_id[found] < ids[q]) | (other_id[found] == ids[q]) & ((source[found] < shard) | (source[found] == shard) & (item[found] < i))
            for column, x in zip(links, (np.full(len(found), shard), i, ids[q], source[found], item[found], other_id[found], same), strict=True):
                column.append(x)


def _table(links: list[list]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in _LINK.split(", ")]
    return pa.table({n: pa.array(np.concatenate(c) if c else [], k) for n, c, k in zip(names, links, kinds, strict=True)})


def frequent_elements(df: DataFrame, elements: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, int]], *, spread: int = SPREAD) -> Rarity:
    """Elements that many sets hold, and a rank by how many (coarse, so that it is alike in every run).

    elements(batch) gives (set number, element, number of sets); an element that a set repeats counts as often. A batch tells of the elements that more than one in
    `spread` of its sets hold, so the driver gets at most spread x mean size x batches small rows, summed by Spark first; of the sums,
    at most spread x mean size pass. The order only speeds up the join: any order gives the same links.
    """
    def run(batches):
        for batch in sliced(batches, 4096, 4 * PART):
            found = [elements(part) for part in sliced([batch], 512, PART)]
            n = sum(x[2] for x in found)
            keys, counts = np.unique(joined([x[1] for x in found], np.uint64), return_counts=True)
            often = counts > max(3, n / spread)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], n).astype(np.int64)), pa.array(np.append(np.zeros(often.sum(), bool), True))], ["key", "count", "total"])

    sums = df.mapInArrow(run, "key long, count long, total boolean").groupBy("key", "total").agg(F.sum("count").alias("n"))
    sums = written(sums, large=False)
    total = F.max(F.when(F.col("total"), F.col("n")))
    bound = sums.agg(total.alias("all"))
    rows = sums.where(~F.col("total")).crossJoin(F.broadcast(bound)).where(F.col("n") * spread * 2 > F.col("all")).select("key", F.floor(F.log2("n") * 2).cast("long").alias("rank")).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Rarity(keys[order], rows.column("rank").to_numpy()[order])
