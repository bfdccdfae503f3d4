"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt into shards by their hash. In a shard, greedy searches from its medoid propose neighbours
for each vector, and relaxed pruning keeps a neighbour only if no kept one is much nearer to it, so that edges stay diverse; nodes
that no path from the medoid reaches get a bridge. Graphs are written once. A beam search over each shard's graph answers every query; queries
come in blocks, and the blocks of a shard are dealt to several tasks, so that neither graphs nor queries are ever all in one place. The
nearest of all shards are kept, by exact cosines.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Equal vectors are
one node of a graph: only the k + 1 smallest ids of each can ever be among k nearest, by the order of ties. Vectors of
unlike length are never compared. Repeated rows count once. Other columns take no part, whatever their names; an empty table, or one
without queries, gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.exchange import dealt_to, even_ids
from tessera.llm.store import written

#: Vectors of a shard, about; edges of a node; width of the beam; slack of pruning.
SHARD, DEGREE, BEAM, SLACK = 8192, 24, 80, 1.2
#: Queries of a block, and blocks that one task searches in a shard.
BLOCK, BLOCKS = 4096, 32


class Graph:
    """A directed graph over unit vectors; nearness is the inner product."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, slack: float = SLACK, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        self.degree, self.beam, n = degree, beam, len(x)
        rng = np.random.default_rng(seed)
        self.entry = int(np.argmax(self.x @ self.x.mean(0))) if n else 0
        self.edges = rng.integers(0, max(n, 1), (n, degree)).astype(np.int32)
        for a in (1.0, slack):
            self._improve(rng.permutation(n), a)
        self._bridge()

    def _bridge(self) -> None:
        """One more edge a node: from reached nodes to those that no path from the entry reaches, one after the other."""
        n = len(self.x)
        reached, bridge, last = np.zeros(n, bool), np.arange(n, dtype=np.int32), self.entry

        def reach(front):
            while len(front):
                reached[front] = True
                front = np.unique(self.edges[front])
                front = front[~reached[front]]

        if n:
            reach(np.array([self.entry]))
        for node in np.flatnonzero(~reached).tolist():
            if not reached[node]:
                bridge[last] = last = node
                reach(np.array([node]))
        self.edges = np.concatenate([self.edges, bridge[:, None]], 1)

    def _improve(self, order: np.ndarray, slack: float) -> None:
        i, step = 0, 32
        while i < len(order):
            some = order[i : i + step]
            i, step = i + step, min(512, step * 2)
            seen = self.search(self.x[some], self.beam)[0]
            self.edges[some] = self._pruned(some, np.concatenate([seen, self.edges[some]], 1), slack)
            # edges back
            target = self.edges[some].ravel()
            source = np.repeat(some, self.degree)
            keep = target != source
            pairs = np.unique(np.stack([target[keep], source[keep]]), axis=1)
            nodes, first, count = np.unique(pairs[0], return_index=True, return_counts=True)
            width = int(count.max(initial=0))
            if width:
                more = np.repeat(nodes[:, None], width, 1)
                lane = np.arange(pairs.shape[1]) - np.repeat(first, count)
                more[np.repeat(np.arange(len(nodes)), count), lane] = pairs[1]
                for j in range(0, len(nodes), 512):
                    on = nodes[j : j + 512]
                    self.edges[on] = self._pruned(on, np.concatenate([self.edges[on], more[j : j + 512]], 1), slack)

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray, slack: float) -> np.ndarray:
        """For each node the candidates kept by relaxed pruning, nearest first; free places repeat the node itself."""
        c = np.sort(candidates, 1)
        dead = c == nodes[:, None]
        dead[:, 1:] |= c[:, 1:] == c[:, :-1]
        d = 2 - 2 * np.einsum("nd,ncd->nc", self.x[nodes], self.x[c])
        d[dead] = np.inf
        order = np.argsort(d, 1, kind="stable")[:, : 2 * self.beam]
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        out = np.repeat(nodes[:, None], self.degree, 1).astype(np.int32)
        alive = np.isfinite(d)
        count = np.zeros(len(nodes), int)
        v = self.x[c]
        for _ in range(self.degree):
            best = np.argmax(alive, 1)
            on = np.flatnonzero(alive[np.arange(len(nodes)), best])
            if not len(on):
                break
            b = best[on]
            out[on, count[on]] = c[on, b]
            count[on] += 1
            alive[on, b] = False
            between = 2 - 2 * np.einsum("nd,ncd->nc", v[on, b], v[on])
            alive[on] &= slack * between > d[on]
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, products) of a beam search for each query, nearest first; free places hold node -1... none here: the entry."""
        n, m = len(self.x), len(q)
        ids = np.full((m, beam), n, np.int64)  # n: a free place
        sims = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.entry, q @ self.x[self.entry], False
        on = np.arange(m)
        while len(on):
            best = np.argmin(done[on], 1)
            at = ids[on, best]
            done[on, best] = True
            new = self.edges[at].astype(np.int64)
            s = np.einsum("nd,ned->ne", q[on], self.x[new])
            known = (new[:, :, None] == ids[on][:, None, :]).any(2)
            s[known] = -np.inf
            every, scores = np.concatenate([ids[on], new], 1), np.concatenate([sims[on], s], 1)
            flags = np.concatenate([done[on], known], 1)
            order = np.argsort(-scores, 1, kind="stable")[:, : beam + self.edges.shape[1]]
            every, scores, flags = (np.take_along_axis(v, order, 1) for v in (every, scores, flags))
            twin = np.zeros_like(flags)
            twin[:, 1:] = (every[:, 1:] == every[:, :-1]) & np.isfinite(scores[:, 1:])
            if twin.any():
                scores = np.where(twin, -np.inf, scores)
                order = np.argsort(-scores, 1, kind="stable")
                every, scores, flags = (np.take_along_axis(v, order, 1) for v in (every, scores, flags))
            gone = ~np.isfinite(scores)
            ids[on], sims[on], done[on] = np.where(gone, n, every)[:, :beam], scores[:, :beam], (flags | gone)[:, :beam]
            on = on[~done[on].all(1)]
        return np.where(ids == n, self.entry, ids), sims


class Shard:
    """The vectors of one length in a shard, their graph, and the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        by = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=len(first))
        self.names = np.full((len(first), int(count.max(initial=0))), -1, np.int64)  # rising ids of each vector
        self.has = np.arange(self.names.shape[1]) < count[:, None]
        self.names[self.has] = ids[by]
        self.vectors = vectors[first]
        self.norm = np.sqrt((self.vectors * self.vectors).sum(1))
        self.graph = Graph((self.vectors / self.norm[:, None]).astype(np.float32))

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine) of the k nearest to each query."""
        qnorm = np.sqrt((queries * queries).sum(1))
        unit = (queries / qnorm[:, None]).astype(np.float32)
        out: list[list] = [[], [], []]
        for j in range(0, len(queries), 512):
            near, sims = self.graph.search(unit[j : j + 512], beam)
            for i, nodes, valid in zip(range(j, j + len(near)), near, np.isfinite(sims), strict=True):
                node = nodes[valid]
                cosine = (self.vectors[node] * queries[i]).sum(1) / (self.norm[node] * qnorm[i])
                who, ok = self.names[node], self.has[node] & (self.names[node] != query_ids[i])
                score = np.repeat(cosine[:, None], who.shape[1], 1)[ok]
                who = who[ok]
                top = np.lexsort((who, -score))[:k]
                out[0].append(np.full(len(top), query_ids[i]))
                out[1].append(who[top])
                out[2].append(score[top])
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def _matrices(table: pa.Table):
    """(length, ids, matrix) of the vectors of each length."""
    length = table.column("_d").to_numpy()
    for d in np.unique(length).tolist():
        some = table.filter(pa.array(length == d))
        v = some.column("_v").combine_chunks()
        v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
        yield d, some.column("_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, d)


def usable(vector: str) -> Column:
    """True for vectors that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows to each row that is a query, itself left out.

    Queries go to every shard as they are asked for, in blocks; each shard sends back k rows a query.
    """
    rows = df.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), is_query.alias("_q")).dropDuplicates(["_id", "_v"])
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_q"), 1)).alias("q")).first()
    shards, blocks = max(1, -(-counted["n"] // shard)), max(1, -(-counted["q"] // BLOCK))
    tasks = -(-blocks // BLOCKS)  # of a shard
    # a partial limit runs before the shuffle, so a vector that many rows share is cut down where it is read
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_v").orderBy("_id"))).where(F.col("_n") <= k + 1)
    few = few.select("_id", "_v", F.size("_v").alias("_d"), dealt_to(F.pmod(F.xxhash64("_v"), F.lit(shards)).cast("int"), shards).alias("_s")).repartition(shards, "_s")
    number = {x: i for i, x in enumerate(even_ids(shards))}

    def build(table: pa.Table) -> pa.Table:
        found = {d: Shard(ids, vectors) for d, ids, vectors in _matrices(table)}
        return pa.table({"_s": pa.array([number[table.column("_s")[0].as_py()]], pa.int32()), "graph": pa.array([pickle.dumps(found, 5)], pa.binary())})

    def block(table: pa.Table) -> pa.Table:
        return pa.table({"_b": pa.array([table.column("_b")[0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps({d: (ids, v) for d, ids, v in _matrices(table)}, 5)], pa.binary())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0), np.zeros(0), np.zeros(0))]
        if left.num_rows:
            found = pickle.loads(left.column("graph")[0].as_py())
            for queries in right.column("queries"):
                for d, (ids, v) in pickle.loads(queries.as_py()).items():
                    if d in found:
                        out.append(found[d].answer(ids, v, k, beam))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(i.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    graphs = written(few.groupBy("_s").applyInArrow(build, "_s int, graph binary"))
    asked = rows.where(F.coalesce("_q", F.lit(False))).select("_id", "_v", F.size("_v").alias("_d"), F.pmod(F.xxhash64("_id", "_v"), F.lit(blocks)).cast("int").alias("_b"))
    asked = written(asked.groupBy("_b").applyInArrow(block, "_b int, queries binary"))
    # task t of shard s searches the blocks that leave t when divided by the number of tasks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = graphs.withColumn("_t", every(tasks)).select(dealt_to(F.col("_s") * tasks + F.col("_t"), shards * tasks).alias("_k"), "graph")
    asked = asked.withColumn("_s", every(shards)).select(dealt_to(F.col("_s") * tasks + F.col("_b") % tasks, shards * tasks).alias("_k"), "queries")
    dealt = lambda rows: rows.repartition(shards * tasks, "_k").groupBy("_k")
    found = dealt(graphs).cogroup(dealt(asked)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame) -> DataFrame:
    """op3: queries are rows whose vec_id is divisible by 50."""
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
