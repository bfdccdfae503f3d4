"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of its neighbours; transitions tie labels of
adjoining lines. Forward-backward gives each line's marginal of "good"; the length-weighted mean of a document's
marginals, calibrated on the training rows, is its score. Labels exist per document only, so training alternates
between fitting the field and relabelling the lines of bad documents by the field's own marginals.

Null texts count as empty; an empty text is one empty line and gets a score like any other. Scores depend on the text alone:
repeated rows get equal scores, other columns pass through untouched, but for one of the output's name, which is replaced. An empty
table gives an empty result; without labels of both kinds every score is the share of good ones among the labels, or 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import labelled
from tessera.llm.textops import SPACE_WORDS, Words, column_bytes, sliced, word_hashes

#: At most so many labelled documents of each label are fitted.
SAMPLE = 3000
#: Bytes of text whose features are in memory at once, or one text.
PART = 1 << 21
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 sentence mark, 6 other symbol
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_CLASS[33:48], _CLASS[58:65], _CLASS[91:97], _CLASS[123:127] = 6, 6, 6, 6
_CLASS[[*b".,;:?'-\"()"]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
N_OWN = 14


def line_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of a text column (its neighbours' among them), line weights, first line of each row."""
    data, offs = column_bytes(column)
    n = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    inner = np.searchsorted(offs, breaks, "right") - 1  # the row of each break
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    counts = np.bincount(inner, minlength=n) + 1
    rows = np.concatenate([[0], np.cumsum(counts)])
    # rows own their starts in order: a break at a row's end opens an empty line that starts where the next row does
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    last = rows[1:] - 1
    end[last] = offs[1:]
    size = np.maximum(end - start, 0)
    kinds = _CLASS[data]
    sums = [np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)]) for k in range(1, 7)]
    up, low, dig, sp, mark, sym = (s[end] - s[start] for s in sums)
    words = Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([start, end[-1:]]).astype(np.int64)), pa.py_buffer(data)]) if len(start) else pa.array([], pa.binary()), SPACE_WORDS)
    wn = words.counts()
    line = words.row_of()
    order = np.lexsort((words.hash, line))
    sl, sh = line[order], words.hash[order]
    fresh = np.ones(len(sl), bool)
    fresh[1:] = (sl[1:] != sl[:-1]) | (sh[1:] != sh[:-1])
    distinct = np.bincount(sl[fresh], minlength=len(start))
    again = np.zeros(len(line), bool)
    again[1:] = (line[1:] == line[:-1]) & (words.hash[1:] == words.hash[:-1])
    repeats = np.bincount(line[again], minlength=len(start))
    tail = kinds[words.end - 1] if len(line) else np.zeros(0, np.uint8)
    symbol_end = np.bincount(line[tail == 6], minlength=len(start))
    lone = np.bincount(line[(words.end - words.start == 1) & (tail == 6)], minlength=len(start))
    own = np.maximum(wn, 1)
    chars = np.maximum(size, 1)
    letters = np.maximum(up + low, 1)
    whole = word_hashes(data, start[size > 0], end[size > 0])
    lines = np.zeros(len(start), np.uint64)
    lines[size > 0] = whole
    row = np.repeat(np.arange(n), counts)
    order = np.lexsort((lines, row))
    copy = np.zeros(len(start), bool)
    copy[order[1:]] = (row[order][1:] == row[order][:-1]) & (lines[order][1:] == lines[order][:-1])
    x = np.stack(
        [
            np.log1p(size) / 5, np.log1p(wn) / 4, up / letters, sym / chars * 4, dig / chars * 4, mark / own,
            symbol_end / own, lone / own, distinct / own, repeats / own, np.minimum(letters / own, 20) / 10, copy,
            size == 0, (mark > 0) & (up > 0),
        ],
        axis=1,
    ).astype(np.float32)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[rows[:-1]] = 0
    after[last] = 0
    edge = np.zeros((len(x), 2), np.float32)
    edge[rows[:-1], 0] = 1
    edge[last, 1] = 1
    return np.concatenate([x, before, after, edge], axis=1), size + 1.0, rows


def _steps(rows: np.ndarray):
    """Rows by falling length, and how many of them are longer than t, for t = 0, 1, ..."""
    n = np.diff(rows)
    order = np.argsort(-n, kind="stable")
    return rows[:-1][order], len(n) - np.searchsorted(np.sort(n), np.arange(n.max(initial=0)), "right")


def marginals(score: np.ndarray, trans: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of transitions; score: of "good" against "bad" (0)."""
    first, alive = _steps(rows)
    e = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=1)
    m = np.exp(trans)
    fwd, back = np.empty((len(score), 2)), np.empty((len(score), 2))
    for t, k in enumerate(alive):
        at = first[:k] + t
        f = e[at] if t == 0 else (fwd[at - 1] @ m) * e[at]
        fwd[at] = f / f.sum(1, keepdims=True)
    for t in range(len(alive) - 1, -1, -1):
        at = first[: alive[t]] + t
        back[at] = 1.0
        if t + 1 < len(alive):
            on = first[: alive[t + 1]] + t
            b = (back[on + 1] * e[on + 1]) @ m.T
            back[on] = b / b.sum(1, keepdims=True)
    p = fwd * back
    p /= p.sum(1, keepdims=True)
    inner = np.ones(len(score), bool)
    inner[rows[:-1]] = False
    at = np.flatnonzero(inner)
    joint = fwd[at - 1][:, :, None] * m[None] * (e[at] * back[at])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return p[:, 1], joint


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: tuple[float, float, float]

    def lines(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return marginals((x - self.mean) / self.scale @ self.weights + self.bias, self.trans, rows)[0]

    def aggregate(self, p: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(p * weight, rows[:-1]) / np.add.reduceat(weight, rows[:-1])

    def documents(self, x, weight, rows) -> np.ndarray:
        q = np.clip(self.aggregate(self.lines(x, rows), weight, rows), 1e-4, 1 - 1e-4)
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-(a + b * q + c * np.log(q / (1 - q)))))


def _descend(gradient, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return theta


def fit(x: np.ndarray, weight: np.ndarray, rows: np.ndarray, labels: np.ndarray, *, rounds: int = 3, steps: int = 60, l2: float = 1e-3) -> Field:
    """Fits the field to document labels (1 good); without labels of both kinds the score is their share."""
    d = x.shape[1]
    mean, scale = x.mean(0) if len(x) else np.zeros(d), np.maximum(x.std(0), 0.05) if len(x) else np.ones(d)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Field(mean, scale, np.zeros(d), 0.0, np.zeros((2, 2)), (odds, 0.0, 0.0))
    z = (x - mean) / scale
    n = np.diff(rows)
    good_row = np.repeat(labels == 1, n)
    balance = np.where(good_row, 0.5 / good_row.sum(), 0.5 / (~good_row).sum())
    y = good_row.astype(float)
    theta = np.zeros(d + 1 + 4)
    inner = np.ones(len(x), bool)
    inner[rows[:-1]] = False
    at = np.flatnonzero(inner)
    for _ in range(rounds):
        seen = np.stack([(1 - y[at - 1]) * (1 - y[at]), (1 - y[at - 1]) * y[at], y[at - 1] * (1 - y[at]), y[at - 1] * y[at]], 1).reshape(-1, 2, 2)

        def gradient(th, y=y, seen=seen):
            p, joint = marginals(z @ th[:d] + th[d], th[d + 1 :].reshape(2, 2), rows)
            r = (p - y) * balance
            g = np.concatenate([r @ z, [r.sum()], ((joint - seen) * balance[at][:, None, None]).sum(0).ravel()])
            return g + l2 * th

        theta = _descend(gradient, theta, steps, 0.15)
        p, _ = marginals(z @ theta[:d] + theta[d], theta[d + 1 :].reshape(2, 2), rows)
        # lines of bad documents follow the field, but the worst line stays bad
        worst = np.repeat(np.minimum.reduceat(p, rows[:-1]), n)
        y = np.where(good_row, 1.0, ((p > 0.5) & (p > worst)).astype(float))
    field = Field(mean, scale, theta[:d], float(theta[d]), theta[d + 1 :].reshape(2, 2), (0.0, 0.0, 1.0))
    q = np.clip(field.aggregate(field.lines(x, rows), weight, rows), 1e-4, 1 - 1e-4)
    f = np.stack([np.ones_like(q), q, np.log(q / (1 - q))], 1)
    even = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels != 1).sum())
    cal = _descend(lambda c: f.T @ ((1 / (1 + np.exp(-f @ c)) - labels) * even) + 1e-3 * c, np.zeros(3), 400, 0.1)
    field.calibration = tuple(map(float, cal))
    return field


def train(documents: DataFrame, labels: DataFrame, *, target: str = "quality", folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Field:
    """Fits a field to at most `sample` documents of each label outside the held-out fold; executors make the features."""
    rows = labelled.sample(documents, labels, target, folds=folds, held_out=held_out, most={0: sample, 1: sample})

    def features(batches):
        for batch in sliced(batches, 256, PART, 0):
            x, weight, first = line_features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), batch.column(1)], ["x", "weight", "label"])

    got = rows.select("text", "label").mapInArrow(features, "x binary, weight binary, label int").toArrow()
    x = [np.frombuffer(v, np.float32).reshape(-1, 3 * N_OWN + 2) for v in got.column("x").to_pylist()]
    weight = [np.frombuffer(v) for v in got.column("weight").to_pylist()]
    y = np.array(got.column("label").to_pylist(), int)
    order = np.lexsort((np.array([len(v) for v in x], int), y)) if len(x) else np.zeros(0, int)
    x, weight, y = [x[i] for i in order], [weight[i] for i in order], y[order] if len(order) else y
    first = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(int)
    return fit(np.concatenate(x) if x else np.zeros((0, 3 * N_OWN + 2)), np.concatenate(weight) if weight else np.zeros(0), first, y)


def score(df: DataFrame, field: Field, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the score of each row (a column of that name is replaced); the field is a few hundred numbers."""
    kept = df.drop(output) if output != text else df
    names = kept.columns
    at = names.index(text)

    def run(batches):
        for batch in sliced(batches, 512, PART, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(field.documents(*line_features(batch.column(at))), pa.float64())], [*names, output])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(output, T.DoubleType())]))


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """op1: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", F.coalesce(labelled.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
