"""Toxicity by a classifier with a counterfactual penalty.

A document is the set of its lower-cased words and word beginnings (hashed). A logistic model is fitted to labelled
documents; for every sentence of these that mentions an identity term, the term is swapped for the others of its
kind, and the squared change of the score is penalised, so that a neutral mention of a group does not move a score. A model knows
how many such pairs it was fitted to; labelled texts that name no group give none, and then the penalty has no effect.

Null texts count as empty. Scores depend on the text alone; repeated rows get equal scores. Other columns pass through, but for one
of the output's name, which is replaced. An empty table gives an empty result; without labels of both kinds every score is the share of toxic
ones among the labels (within 0.001 and 0.999).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import labelled
from tessera.llm.textops import ALNUM_WORDS, Words, sliced, word_hashes

#: Groups whose names are swapped for one another; a parameter of train().
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people", "children"),
    ("woman", "man", "girl", "boy", "person", "child"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "schwarze", "weiße", "schwule"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "noirs", "blancs", "homosexuels"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "negros", "blancos", "homosexuales"),
)
#: At most so many labelled documents of each label are fitted (toxic ones are rarer).
SAMPLE = {1: 3000, 0: 6000}
#: Numbers of hash slots for features, and of features that get a weight: those that tell the labels apart best.
SLOTS, CHOSEN = 1 << 18, 6000
#: Pairs of sentences that are fitted at most (a choice by hash), and features of each side.
PAIRS, PAIR_FEATURES = 20_000, 4096
#: Bytes of text whose features are in memory at once, or one text.
PART = 1 << 21
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
_END = re.compile(r"(?<=[.!?\n])\s+")


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of each row, ordered by row."""
    words = Words(column, ALNUM_WORDS, lower=True)
    row = words.row_of().astype(np.uint64)
    size = words.end - words.start
    key = [row * np.uint64(SLOTS) + words.hash % np.uint64(SLOTS)]
    for n in BEGINNINGS:
        long = size > n
        h = word_hashes(words.bytes, words.start[long], words.start[long] + n)
        key.append(row[long] * np.uint64(SLOTS) + (h * np.uint64(2 * n + 1) >> np.uint64(20)) % np.uint64(SLOTS))
    found = np.unique(np.concatenate(key))
    return (found // np.uint64(SLOTS)).astype(np.int64), (found % np.uint64(SLOTS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of each slot
    bias: float
    pairs: int = 0  # counterfactual pairs that it was fitted to

    def score(self, column) -> np.ndarray:
        row, slot = features(column)
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[slot], len(column)) + self.bias, -40, 40)))


def counterfactuals(texts: list[str], groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(sentence, sentence with the term swapped) for each sentence and term of a group in it, and each other term."""
    kinds = {term: group for group in groups for term in group}
    words = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, kinds), key=len, reverse=True)) + r")\b")
    out: dict[tuple[str, str], None] = {}
    for text in texts:
        low = (text or "").lower()
        if words.search(low):
            for sentence in _END.split(low):
                for term in dict.fromkeys(words.findall(sentence)):
                    for other in kinds[term]:
                        if other != term:
                            out[(sentence, re.sub(rf"\b{re.escape(term)}\b", other, sentence))] = None
    return list(out)


def pair_slots(pairs: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The slots of both sides of each pair."""
    sides = []
    for side in (0, 1):
        row, slot = features(pa.array([p[side] for p in pairs], pa.string()))
        cut = np.searchsorted(row, np.arange(len(pairs) + 1))
        sides.append([slot[x:y].astype(np.int32) for x, y in zip(cut[:-1], cut[1:], strict=True)])
    return list(zip(*sides, strict=True))


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], *, penalty: float = 20.0, l2: float = 5e-5, steps: int = 500) -> Model:
    """rows: the slots of each document; pairs: of both sides of each counterfactual pair.

    The loss is the balanced log loss, plus penalty times the mean squared difference of the scores of pairs.
    Without labels of both kinds every score is the share of the label.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(SLOTS), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), len(pairs))
    n = np.array([len(r) for r in rows])
    slot = np.concatenate(rows)
    bad = np.repeat(labels == 1, n)
    a, b = np.bincount(slot[bad], minlength=SLOTS), np.bincount(slot[~bad], minlength=SLOTS)
    na, nb = (labels == 1).sum(), (labels != 1).sum()
    z = np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))
    # by evidence: log odds over their standard error; rare features count little
    worth = z / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    worth[a + b < 3] = 0
    top = np.argsort(-np.abs(worth), kind="stable")[:CHOSEN]
    column = np.full(SLOTS, -1)
    column[top] = np.arange(len(top))
    keep = column[slot] >= 0
    r, c = np.repeat(np.arange(len(rows)), n)[keep], column[slot[keep]]
    sides = []
    for side in (0, 1) if pairs else ():
        i, k = np.repeat(np.arange(len(pairs)), [len(p[side]) for p in pairs]), column[np.concatenate([p[side] for p in pairs])]
        sides.append((i[k >= 0], k[k >= 0]))
    w, bias = np.zeros(len(top)), 0.0
    m, v = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    weight = np.where(labels == 1, 0.5 / na, 0.5 / nb)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(rows)) + bias, -40, 40)))
        err = (s - labels) * weight
        g = np.bincount(c, err[r], len(top)) + l2 * w
        slope = err.sum()
        if pairs:
            scores = [1 / (1 + np.exp(-np.clip(np.bincount(i, w[k], len(pairs)) + bias, -40, 40))) for i, k in sides]
            change = 2 * penalty * (scores[0] - scores[1]) / len(pairs)
            for (i, k), p, sign in zip(sides, scores, (1.0, -1.0), strict=True):
                pull = sign * change * p * (1 - p)
                g += np.bincount(k, pull[i], len(top))
                slope += pull.sum()
        g = np.append(g, slope)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    full = np.zeros(SLOTS)
    full[top] = w
    return Model(full, float(bias), len(pairs))


def train(documents: DataFrame, labels: DataFrame, *, target: str = "toxic", folds: int = 3, held_out: int = 1, most: dict[int, int] = SAMPLE, groups=IDENTITY_TERMS) -> Model:
    """Fits a model to at most most[label] documents of each label outside the held-out fold, and at most PAIRS pairs of their sentences.

    Sentences of more than PAIR_FEATURES features are not paired; what comes to the driver are slots, so its size is bounded.
    """
    rows = labelled.sample(documents, labels, target, folds=folds, held_out=held_out, most=most)
    seen = [t for g in groups for t in g]

    def slots(batches):
        for batch in sliced(batches, 256, PART, 0):
            row, slot = features(batch.column(0))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = [slot[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], ["x", "label"])

    def swaps(batches):
        for batch in sliced(batches, 256, PART, 0):
            texts = [t for t in batch.column(0).to_pylist() if t and any(w in t.lower() for w in seen)]
            both = [p for p in pair_slots(counterfactuals(texts, groups)) if max(map(len, p)) <= PAIR_FEATURES]
            yield pa.RecordBatch.from_arrays([pa.array([p[k].tobytes() for p in both], pa.binary()) for k in (0, 1)], ["a", "b"])

    got = rows.select("text", "label").mapInArrow(slots, "x binary, label int").toArrow()
    x, y = got.column("x").to_pylist(), got.column("label").to_pylist()
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i]))
    # an equal choice in every run
    found = rows.select("text").mapInArrow(swaps, "a binary, b binary").distinct().orderBy(F.xxhash64("a", "b"), "a", "b").limit(PAIRS).toArrow()
    pairs = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True)]
    return fit([np.frombuffer(x[i], np.int32) for i in order], np.array([y[i] for i in order], int), pairs)


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the score of each row (a column of that name is replaced). The model (a weight a slot: 2 MB) is broadcast."""
    kept = df.drop(output) if output != text else df
    names = kept.columns
    at = names.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, 512, PART, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(at)), pa.float64())], [*names, output])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(output, T.DoubleType())]))


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """op10: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", F.coalesce(labelled.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
