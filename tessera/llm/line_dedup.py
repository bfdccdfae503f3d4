"""Line deduplication by an exact similarity join of the token sets of lines.

A line's set: its distinct lower-cased (A-Z) words "[^\\x20\\x09-\\x0D]+". A line goes if an earlier line, of the same or another
document, has a set of Jaccard similarity of at least 0.8 with its own; earlier means a lesser id, then a lesser line number
(rows without an id come last). Lines are judged on the input: a line goes even if what it matches goes too. Lines without words always stay.
A text whose lines all go becomes empty. Null texts stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import Exchange, row_ids, strings
from tessera.llm.setjoin import LEFT_OUT, Join, Sets, frequent_elements
from tessera.llm.textops import SPACE_WORDS, Words, column_bytes

PERCENT = 80


class Lines:
    """The lines of a text column: byte range of each, and the first line of each row."""

    def __init__(self, column):
        self.bytes, offs = column_bytes(column)
        breaks = np.flatnonzero(self.bytes == 10)
        counts = np.bincount(np.searchsorted(offs, breaks, "right") - 1, minlength=len(offs) - 1) + 1
        self.rows = np.concatenate([[0], np.cumsum(counts)])
        self.start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
        self.end = np.append(self.start[1:] - 1, 0)
        self.end[self.rows[1:] - 1] = offs[1:]
        self.row = np.repeat(np.arange(len(offs) - 1), counts)

    def words(self, which: np.ndarray | None = None) -> Words:
        """The words of all lines, or of some."""
        n = len(self.start)
        offs = np.append(self.start, len(self.bytes)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(self.bytes))])
        return Words(column if which is None else column.take(pa.array(which)), SPACE_WORDS, lower=True)


def tokens(column) -> tuple[np.ndarray, np.ndarray, int]:
    """(line, word hash) of the words of each line, and the number of lines."""
    words = Lines(column).words()
    return words.row_of(), words.hash, len(words.rows) - 1


def _items(table: pa.Table, rarity, which):
    lines = Lines(table.column("text"))
    words = lines.words(which)
    return Sets(words.row_of(), words.hash, len(words.rows) - 1, rarity), row_ids(table)[lines.row]


def _bags(table: pa.Table):
    lines = Lines(table.column("text"))
    words = lines.words()
    return words.row_of(), words.hash, len(words.rows) - 1, row_ids(table)[lines.row]


def removals(documents: DataFrame, *, percent: int = PERCENT, key: str = "doc_id", text: str = "text", rest: list[str] | None = None) -> DataFrame:
    """(doc_id, kept, n_lines, n_removed) for each row, and a struct `rest` of other columns; kept is the text without its removed lines."""
    rarity = frequent_elements(documents.select(text), lambda batch: tokens(batch.column(0)))
    shards = Exchange(documents, key, text, rest=rest)
    join = Join(shards, _items, _bags, percent, rarity, link_equal=True)
    # of two linked lines the later one goes (state 1), and has no part in the second round if it equals the other
    here, there = F.struct("id", "shard", "item"), F.struct(F.col("other_id").alias("id"), F.col("other_shard").alias("shard"), F.col("other_item").alias("item"))

    def later(links: DataFrame) -> DataFrame:
        rows = links.select(F.when(here > there, here).otherwise(there).alias("x"), F.when(F.col("same") & (here > there), LEFT_OUT).otherwise(1).alias("value"))
        return rows.groupBy(F.col("x.shard").alias("_shard"), F.col("x.item").alias("item")).agg(F.min("value").alias("value"))

    first = shards.tell(later(join.stars()))
    more = shards.tell(later(join.lists(first, lambda a, b: (a == 0) | (b == 0), lambda low, high: low == 0, lambda shard, items: np.zeros(len(items), np.int64))))

    def use(shard: int, table: pa.Table, got) -> pa.Table:
        lines = Lines(table.column("text"))
        gone = np.zeros(len(lines.start), bool)
        for _, (item, _) in got:
            gone[item] = True
        keep = ~gone
        # a kept line's bytes, and a break before it unless it is the first kept one of its row
        kept = np.flatnonzero(keep)
        row = lines.row[kept]
        again = np.zeros(len(kept), bool)
        again[1:] = row[1:] == row[:-1]
        size = lines.end[kept] - lines.start[kept] + again
        data = np.append(lines.bytes, np.uint8(10))
        source = np.arange(size.sum()) + np.repeat(lines.start[kept] - again - (np.cumsum(size) - size), size)
        breaks = (np.cumsum(size) - size)[again]
        source[breaks] = len(data) - 1
        sums = np.zeros(len(lines.rows) - 1, np.int64)
        np.add.at(sums, row, size)
        offs = np.concatenate([[0], np.cumsum(sums)])
        out = strings(offs, data[source])
        total = np.concatenate([[0], np.cumsum(gone)])
        if table.column("text").null_count:
            valid = table.column("text").is_valid().combine_chunks()
            ends = np.cumsum([0, *map(len, out.chunks)]).tolist()
            out = pa.chunked_array([pa.compute.if_else(valid.slice(x, len(c)), c, None) for x, c in zip(ends, out.chunks, strict=False)], pa.string())
        more = {"rest": table.column("rest")} if rest else {}
        return pa.table({"doc_id": table.column("id"), "kept": out, "n_lines": pa.array(np.diff(lines.rows), pa.int64()), "n_removed": pa.array(total[lines.rows[1:]] - total[lines.rows[:-1]], pa.int64()), **more})

    return shards.back(first.union(more), use, shards.with_rest("doc_id long, kept string, n_lines long, n_removed long"))


def report(documents: DataFrame) -> DataFrame:
    """op7: per document the numbers of lines and removed lines, and a digest of the text that is kept."""
    return removals(documents).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The documents without their removed lines (n_chars follows the text, where there is such a column).

    Of rows equal in id and text the first, in no certain order, keeps its lines.
    """
    names = documents.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    found = removals(documents, percent=percent, rest=rest or None)
    value = {c: F.col("rest")[c] for c in rest} | {"doc_id": F.col("doc_id").cast(documents.schema["doc_id"].dataType), "text": F.col("kept")}
    if "n_chars" in rest:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(value["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return found.select(*[value[c].alias(c) for c in names])
