"""Questions from shards of a table to buckets of keys, and answers back.

A table is dealt once into shards (by a hash of whole rows' keys, so no value gathers in one shard); its rows travel as compressed
blobs of Arrow data, one for each shard and buffer of a task. A shard sums up its rows first and asks each bucket one packed
question; a bucket owns a range of the 64-bit hash space and answers each shard, so keys have to be spread evenly over it (mix
them, if they are minima of hashes). Keys that many rows share thus cross the network once a shard at most, however hot they are. The
shards are one exchange that every later step reads again (Spark reuses it within a plan).

There are as many shards as shuffle partitions, or more where the plan's size says that a shard would exceed SHARD_BYTES.

Rows of a shard are put in a fixed order (id, then text) wherever they are read, so a row's number means the same
in every step. Rows equal in both are interchangeable.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

_ROUTED = "_shard int, _bucket int, data binary"
#: Bytes of rows that a task holds before it sends them as blobs.
BUFFER = 1 << 25
#: Bytes of a shard's text whose words are in memory at once.
PART = 1 << 22
#: Bytes of input of a shard, as the plan's statistics tell them, and the most shards that these ask for (messages grow with the square).
SHARD_BYTES, MOST_SHARDS = 1 << 28, 1 << 16


def pack(*parts) -> bytes:
    return pickle.dumps(parts, 5)


def unpack(data: bytes) -> tuple:
    return pickle.loads(data)


def pack_counts(counts: np.ndarray) -> tuple:
    """Counts as bytes, the large ones apart."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8), counts[large].astype(np.int64)


def unpack_counts(packed: tuple) -> np.ndarray:
    out = packed[0].astype(np.int64)
    out[packed[0] == 255] = packed[1]
    return out


def _murmur(x: int) -> int:
    """Spark's hash of an int."""
    m = 0xFFFFFFFF
    k = x * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    k = k * 0x1B873593 & m
    h = 42 ^ k
    h = (h << 13 | h >> 19) & m
    h = (h * 5 + 0xE6546B64) & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@functools.lru_cache(8)
def even_ids(n: int) -> tuple[int, ...]:
    """n ids of which a hash partitioning into n deals one to each partition."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(_murmur(x) % n, x)
        x += 1
    return tuple(found[i] for i in range(n))


def dealt_to(place: Column, n: int) -> Column:
    """The id of partition `place` (0..n-1): repartition(n, ids) deals each place to a partition of its own."""
    return F.element_at(F.expr(f"array({','.join(map(str, even_ids(n)))})"), place + 1)


class Exchange:
    """The shards of a table; key: the id, text: the text; both may be null. rest: other columns that travel along, as a struct."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = None, rest: list[str] | None = None):
        spark = df.sparkSession
        more = [F.struct(*rest).alias("rest")] if rest else []
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *more)
        self.n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-_plan_bytes(rows) // SHARD_BYTES)))
        self.ids = even_ids(self.n)
        self.rest = rows.schema["rest"].dataType if rest else None
        self.schema = _large(to_arrow_schema(rows.schema))
        place: Column = F.pmod(F.xxhash64("id", "text"), F.lit(self.n)).cast("int")
        self.rows = rows.withColumn("_shard", dealt_to(place, self.n)).mapInArrow(_blobs, "_shard int, blob binary").repartition(self.n, "_shard")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # executors need the numbers only

    def with_rest(self, schema: str) -> StructType:
        """A result schema that ends with the struct of the rest, where there is one."""
        fields = StructType.fromDDL(schema).fields
        return StructType([*fields, StructField("rest", self.rest)] if self.rest else fields)

    def bounds(self) -> np.ndarray:
        """Where the key range of each bucket but the first begins."""
        return np.array([(i << 64) // self.n for i in range(1, self.n)], np.uint64)

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket's share of sorted keys begins, and the end."""
        return np.concatenate([[0], np.searchsorted(keys, self.bounds()), [len(keys)]]).astype(int)

    def short(self, keys: np.ndarray, bucket: int) -> np.ndarray:
        """Keys of a bucket in 32 bits, told apart as well as a bucket's share of the hash space allows; their order stays."""
        return (keys - np.uint64((bucket << 64) // self.n) >> np.uint64(max(0, 33 - self.n.bit_length()))).astype(np.uint32)

    @staticmethod
    def routed(found: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.table({"_shard": pa.array([x[0] for x in found], pa.int32()), "_bucket": pa.array([x[1] for x in found], pa.int32()), "data": pa.array([x[2] for x in found], pa.binary())})

    def nothing(self) -> DataFrame:
        """No answers."""
        return self.rows.sparkSession.createDataFrame([], _ROUTED)

    def tell(self, rows: DataFrame) -> DataFrame:
        """Rows (_shard, item, value) as an answer to each shard: packed items and values."""
        routed = self.routed

        def run(table: pa.Table) -> pa.Table:
            shard = table.column("_shard")[0].as_py()
            return routed([(shard, shard, pack(table.column("item").to_numpy(), table.column("value").to_numpy()))])

        return rows.select(F.col("_shard").cast("int"), F.col("item").cast("long"), F.col("value").cast("long")).repartition(self.n, "_shard").groupBy("_shard").applyInArrow(run, _ROUTED)

    def ask(self, question: Callable[[int, pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
        """question(shard, rows) gives (bucket number, data); each bucket number is 0..n-1."""
        routed, ids, schema = self.routed, self.ids, self.schema

        def run(table: pa.Table) -> pa.Table:
            shard = table.column("_shard")[0].as_py()
            return routed([(shard, ids[b], data) for b, data in question(shard, opened(table, schema))])

        return self.rows.groupBy("_shard").applyInArrow(run, _ROUTED)

    def answer(self, questions: DataFrame, reply: Callable[[list[tuple[int, tuple]]], list[tuple[int, bytes]]]) -> DataFrame:
        """reply gets (shard, unpacked question) of one bucket, by shard, and gives (shard, data)."""
        routed = self.routed

        def run(table: pa.Table) -> pa.Table:
            bucket = table.column("_bucket")[0].as_py()
            got = sorted(zip(table.column("_shard").to_pylist(), table.column("data").to_pylist(), strict=True))
            return routed([(s, bucket, data) for s, data in reply([(s, unpack(d)) for s, d in got])])

        return questions.repartition(self.n, "_bucket").groupBy("_bucket").applyInArrow(run, _ROUTED)

    def back(self, answers: DataFrame, use: Callable[[int, pa.Table, list[tuple[int, tuple]]], pa.Table], schema: str | StructType) -> DataFrame:
        """`answers` are dealt to the shards they are for.

        use(shard, rows, (bucket number, unpacked answer) in order of buckets) gives rows of the schema."""
        number, rows = {x: i for i, x in enumerate(self.ids)}, self.schema

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            shard = (left if left.num_rows else right).column("_shard")[0].as_py()
            got = sorted((number[b], d) for b, d in zip(right.column("_bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
            return use(shard, opened(left, rows), [(b, unpack(d)) for b, d in got])

        return self.rows.groupBy("_shard").cogroup(answers.repartition(self.n, "_shard").groupBy("_shard")).applyInArrow(run, schema)


#: Stands for a null id among numbers.
NO_ID = 2**63 - 1


def row_ids(table: pa.Table) -> np.ndarray:
    return np.asarray(pc.fill_null(table.column("id"), NO_ID)).astype(np.int64)


def _plan_bytes(df: DataFrame) -> int:
    """The size of a plan's rows as Spark estimates it; 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def _large(schema: pa.Schema) -> pa.Schema:
    """Texts with 64-bit offsets."""
    return schema.set(schema.get_field_index("text"), pa.field("text", pa.large_string()))


def _blobs(batches):
    """Rows (id, text, rest, _shard) as blobs (_shard, blob) of one shard each."""

    def blobs(held):
        rows = pa.Table.from_batches(held)
        shard = rows.column("_shard").to_numpy()
        rows = rows.drop_columns(["_shard"])
        rows = rows.cast(_large(rows.schema))
        order = np.argsort(shard, kind="stable")
        rows, shard = rows.take(pa.array(order)).combine_chunks(), shard[order]
        cut = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)).tolist()
        found = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
                out.write_table(rows.slice(x, y - x))
            found.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]], pa.int32()), pa.array(found, pa.binary())], ["_shard", "blob"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > BUFFER:
            yield blobs(held)
            held, size = [], 0
    if held:
        yield blobs(held)


def opened(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of a shard's blobs, in order."""
    found = [pa.ipc.open_stream(x.as_buffer()).read_all().cast(schema) for x in table.column("blob")]
    return ordered(pa.concat_tables(found) if found else schema.empty_table())


def parts(table: pa.Table):
    """The rows of a shard in parts of about PART bytes of text, or one row: so that the words of one part at a time are in memory."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(table.column("text")), 0)).astype(np.int64))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PART, int(ends[-1]) if len(ends) else 0, PART)) + 1, [len(ends)]]))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield table.slice(x, y - x).combine_chunks()


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.ChunkedArray:
    """Texts from their bytes and offsets, in chunks that 32-bit offsets reach."""
    n = len(offsets) - 1
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return short_strings(whole)


def short_strings(column) -> pa.ChunkedArray:
    """A column of texts in chunks that 32-bit offsets reach."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    cut = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1 << 30, int(ends[-1]) if len(ends) else 0, 1 << 30)), [len(ends)]])).tolist()
    return pa.chunked_array([x for i, j in zip(cut[:-1], cut[1:], strict=True) for x in _chunks(column.slice(i, j - i).cast(pa.large_string()).cast(pa.string()))], pa.string())


def _chunks(column) -> list:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def ordered(table: pa.Table) -> pa.Table:
    """Rows in order of id (nulls last), then text."""
    if table.num_rows < 2:
        return table.combine_chunks()
    ids = table.column("id")
    order = np.lexsort((np.asarray(pc.fill_null(ids, 0)), ~np.asarray(pc.is_valid(ids))))
    table = table.take(pa.array(order))
    ids = np.asarray(pc.fill_null(table.column("id"), 0))
    valid = np.asarray(pc.is_valid(table.column("id")))
    if ((ids[1:] == ids[:-1]) & (valid[1:] == valid[:-1])).any():
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))
    return table.combine_chunks()
