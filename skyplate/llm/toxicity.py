"""Toxicity: a logistic classifier over words and word beginnings, with a counterfactual penalty.

Where a labelled text names a group, a second version names another group instead; differences between the two
scores are penalised, so that the mere mention of a group hardly moves a score.

Contract on edge cases: a null or empty text has the score of the intercept alone; a null id passes through;
repeated rows are scored one by one; an empty table gives an empty result; without labels of both kinds every score
is the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import logistic, sampled_ids, texts

#: Terms that name groups; a swap replaces each by the next of its line. A parameter of the classifier.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("black", "white", "asian", "latino"),
    ("africans", "europeans", "asians", "americans"), ("african", "european", "american"), ("immigrants", "natives", "refugees"),
    ("immigrant", "native", "refugee"), ("disabled", "deaf", "blind"), ("old", "young"), ("elderly", "teenagers"),
)
EDGES = ".,;:!?\"'()[]{}<>«»„“”*#%&$|-_"


def swaps(identity: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {w: line[(i + 1) % len(line)] for line in identity for i, w in enumerate(line)}


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings of 3, 4 and 5 letters; a beginning is marked by a star."""
    return (word, *(word[:k] + "*" for k in (3, 4, 5) if len(word) > k))


def words_of(text: str) -> set[str]:
    return {w for w in (x.strip(EDGES) for x in set(text.lower().split())) if w}


def present(words: set[str]) -> set[str]:
    return {f for w in words for f in features(w)}


class Toxicity:
    """sample: most labelled rows per label value. most_features: most features, by chi square, that the model holds.
    penalty: weight of squared score changes under a swap of identity terms. ridge: L2 penalty."""

    def __init__(self, sample: int = 3000, most_features: int = 20_000, least_chi2: float = 6.0, penalty: float = 10.0, ridge: float = 2e-4, rounds: int = 400, seed: int = 13, identity: tuple = IDENTITY):
        self.sample, self.most_features, self.least_chi2, self.penalty, self.ridge, self.rounds, self.seed = sample, most_features, least_chi2, penalty, ridge, rounds, seed
        self.swap = swaps(identity)
        self.names: list[str] = []
        self.weight, self.bias = np.zeros(0), -np.inf

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
        ids = sampled_ids(labels, id_col, label_col, self.sample, self.seed)
        rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).coalesce(32)
        share = labels.where(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
        if share is None:
            return self
        self.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tally = (Counter(), Counter())
                size = [0, 0]
                for label, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    tally[label].update(present(words_of(text)))
                    size[label] += 1
                keys = ["", *sorted(tally[0].keys() | tally[1].keys())]
                for v in (0, 1):
                    tally[v][""] = size[v]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([tally[v][k] for k in keys], type=pa.int64()) for v in (0, 1))], names=["feature", "clean", "toxic"])

        sums = rows.mapInArrow(count, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 4")
        total = sums.where("feature = ''").first()
        if total is None or not total["clean"] or not total["toxic"]:
            return self
        n0, n1 = float(total["clean"]), float(total["toxic"])
        a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
        n = n0 + n1
        chi2 = n * F.pow(a * n0 - b * n1, 2) / (F.lit(n1) * n0 * (a + b) * F.greatest(n - a - b, F.lit(1.0)))
        top = sums.where("feature <> ''").withColumn("chi2", chi2).where(F.col("chi2") >= self.least_chi2).orderBy(F.desc("chi2"), "feature").limit(self.most_features).select("feature").toPandas()
        names = list(dict.fromkeys([*top["feature"], *sorted({f for w in self.swap for f in features(w)})]))
        number, swap = {f: i for i, f in enumerate(names)}, self.swap

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain, other = [], []
                for text in texts(batch.column(1)):
                    words = words_of(text)
                    plain.append(sorted(number[f] for f in present(words) if f in number))
                    other.append(sorted(number[f] for f in present({swap.get(w, w) for w in words}) if f in number) if words & swap.keys() else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, type=pa.list_(pa.int32())), pa.array(other, type=pa.list_(pa.int32()))], names=["label", "plain", "swapped"])

        got = rows.mapInArrow(encode, "label int, plain array<int>, swapped array<int>").toPandas()
        cases = sorted((int(y), tuple(p), () if s is None else tuple(s)) for y, p, s in zip(got["label"], got["plain"], got["swapped"], strict=True))  # rows arrive in any order
        self.names = names
        self.train([c[1] for c in cases], np.array([c[0] for c in cases]), [c[2] or None for c in cases], share)
        return self

    def train(self, plain: list[tuple[int, ...]], label: np.ndarray, swapped: list[tuple[int, ...] | None], share: float) -> None:
        """Adam on the weighted logistic loss + ridge + penalty * mean((score - swapped score) ** 2)."""
        wide = len(self.names)
        rows = np.repeat(np.arange(len(plain)), [len(p) for p in plain])
        cols = np.fromiter((c for p in plain for c in p), dtype=np.int64)
        pairs = [(p, s) for p, s in zip(plain, swapped, strict=True) if s is not None and s != p]
        drow, dcol, dsign = [], [], []
        for i, (p, s) in enumerate(pairs):
            for c in set(p) ^ set(s):
                drow.append(i)
                dcol.append(c)
                dsign.append(1.0 if c in p else -1.0)
        drow, dcol, dsign = np.array(drow, dtype=np.int64), np.array(dcol, dtype=np.int64), np.array(dsign)
        y = (label == 1).astype(np.float64)
        case = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        case /= case.sum()
        theta = np.zeros(wide + 1)
        theta[-1] = self.bias
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, self.rounds + 1):
            residual = case * (logistic(np.bincount(rows, weights=theta[cols], minlength=len(plain)) + theta[-1]) - y)
            grad = np.concatenate([np.bincount(cols, weights=residual[rows], minlength=wide) + self.ridge * theta[:-1], [residual.sum()]])
            if len(pairs):
                change = np.bincount(drow, weights=dsign * theta[dcol], minlength=len(pairs))
                grad[:-1] += 2 * self.penalty / len(pairs) * np.bincount(dcol, weights=dsign * change[drow], minlength=wide)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta -= 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-10)
        used = np.abs(theta[:-1]) > 1e-3
        self.names = [f for f, u in zip(self.names, used, strict=True) if u]
        self.weight, self.bias = theta[:-1][used], float(theta[-1])

    def scores(self, docs: list[str], memo: dict[str, tuple[int, ...]], number: dict[str, int]) -> np.ndarray:
        out = np.empty(len(docs))
        for i, text in enumerate(docs):
            found: set[int] = set()
            for w in set(text.lower().split()):
                at = memo.get(w)
                if at is None:
                    bare = w.strip(EDGES)
                    at = memo[w] = tuple(number[f] for f in features(bare) if f in number) if bare else ()
                if at:
                    found.update(at)
            out[i] = self.weight[sorted(found)].sum() if found else 0.0
            if len(memo) > 500_000:
                memo.clear()
        return logistic(out + self.bias) if np.isfinite(self.bias) else np.zeros(len(docs))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
        """id, score (probability of label 1), predicted (1 if score >= threshold)."""
        model, kind = self, docs.schema[id_col].dataType.simpleString()

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict[str, tuple[int, ...]] = {}
            number = {f: i for i, f in enumerate(model.names)}
            for batch in batches:
                score = model.scores(texts(batch.column(1)), memo, number)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

        return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, score double, predicted int")
