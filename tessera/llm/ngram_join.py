"""Near-duplicate documents by an exact join of their n-gram sets.

Nulls and texts without words have no n-grams and link with nothing, not even with each other. A text of fewer than n words
is one n-gram. Repeated rows are linked copies. A null id never becomes a component's id unless all its rows lack one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import NO_ID, Exchange, row_ids, short_strings
from tessera.llm.setjoin import LEFT_OUT, Join, Sets, frequent_elements
from tessera.llm.store import components, written
from tessera.llm.textops import SPACE_WORDS, Words, kgram_hashes, mix, window_starts

_GID = 1 << 32  # items of a shard


def ngrams(column, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, hash) of the n-grams of each row, and the number of rows."""
    words = Words(column, SPACE_WORDS, lower=True)
    start = window_starts(words.rows, n)
    count = words.counts()
    item, value = [np.searchsorted(words.rows, start, "right") - 1], [kgram_hashes(words.hash, n)[start]]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            item.append(short)
            value.append(mix(kgram_hashes(words.hash, m)[words.rows[short]] + np.uint64(m)))
    return np.concatenate(item), np.concatenate(value), len(count)


def duplicates(documents: DataFrame, *, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", rest: list[str] | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, first) for each row, with `texts` its text, and a struct `rest` of other columns.

    component_id is the least id reachable by links; first marks one row of each component (of those of its least id), and each row without words.
    """
    def batch_ngrams(batch):
        return ngrams(batch.column(0), n)

    def items(table: pa.Table, rarity, which):
        item, value, rows = ngrams(table.column("text") if which is None else table.column("text").take(pa.array(which)), n)
        return Sets(item, value, rows, rarity), row_ids(table)

    def bags(table: pa.Table):
        item, value, rows = ngrams(table.column("text"), n)
        order = np.argsort(item, kind="stable")
        return item[order], value[order], rows, row_ids(table)

    rarity = frequent_elements(documents.select(text), batch_ngrams)
    shards = Exchange(documents, key, text, rest=rest)
    join = Join(shards, items, bags, percent, rarity)
    # a node is (id, shard, item), so that the least node of a component has its least id
    here, there = F.struct("id", "shard", "item"), F.struct(F.col("other_id").alias("id"), F.col("other_shard").alias("shard"), F.col("other_item").alias("item"))
    nodes = lambda links: links.select(here.alias("a"), there.alias("b"))
    place = lambda rows, value: rows.select(F.col("node.shard").alias("_shard"), F.col("node.item").alias("item"), value.cast("long").alias("value"))
    first = written(join.stars())
    joined = written(components(nodes(first)), large=False)
    states = place(joined, F.col("root.shard").cast("long") * _GID + F.col("root.item")).union(first.where("same").select(F.col("shard").alias("_shard"), "item", F.lit(LEFT_OUT).cast("long").alias("value")))
    states = states.groupBy("_shard", "item").agg(F.min("value").alias("value"))
    more = written(join.lists(shards.tell(states), lambda a, b: a != b, lambda low, high: low < high, lambda shard, items: shard * _GID + items))
    joined = written(components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(nodes(more))), large=False)
    # a negative item tells which node is the first of its component
    firsts = place(joined.where(F.col("node") == F.col("root")), F.lit(0)).withColumn("item", -1 - F.col("item"))
    answer = shards.tell(place(joined, F.col("root.id")).union(firsts))
    sets_of = join.sets

    def use(shard: int, table: pa.Table, got) -> pa.Table:
        sizes, ids, _, first_of = sets_of(table)
        out, first = ids.copy(), first_of == np.arange(len(ids))
        for _, (item, value) in got:
            told = item >= 0
            out[item[told]] = value[told]
            first[item[told]] = False
        for _, (item, _) in got:
            first[-1 - item[item < 0]] = True
        alone = sizes == 0
        out = np.where(alone, ids, out[first_of])
        # copies in the shard carry the id of the first, which is the least of them
        more = ({"text": short_strings(table.column("text"))} if texts else {}) | ({"rest": table.column("rest")} if rest else {})
        return pa.table({"doc_id": table.column("id"), "n_shingles": pa.array(sizes), "component_id": pa.array(out, mask=out == NO_ID), "first": pa.array(first | alone), **more})

    return shards.back(answer, use, shards.with_rest("doc_id long, n_shingles long, component_id long, first boolean" + ", text string" * texts))


def report(documents: DataFrame) -> DataFrame:
    """op2: per document the size of its set and its component."""
    return duplicates(documents).select("doc_id", "n_shingles", "component_id")


def first_of_each(documents: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each group of near duplicates, one of those with the least id, and every row without words, as they came."""
    names = documents.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    found = duplicates(documents, n=n, percent=percent, rest=rest or None, texts=True).where("first")
    value = {c: F.col("rest")[c] for c in rest} | {"doc_id": F.col("doc_id").cast(documents.schema["doc_id"].dataType), "text": F.col("text")}
    return found.select(*[value[c].alias(c) for c in names])
