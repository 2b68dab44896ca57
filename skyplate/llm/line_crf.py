"""Quality classifier: a linear-chain conditional random field that labels every line good or bad.

Lines are what stands between \\n characters. Each line is described by its own shape and by that of its two
neighbours; forward-backward gives the probability that a line is good, and the mean of these, weighted by line
length, is calibrated into the document's probability of label 1.

Contract on edge cases: a null or empty text is one empty line and gets a score; a null id passes through;
repeated rows are scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, blobs, joined, logistic, pieces, sampled_ids, totals
from .quality_rules import DIGIT, LETTER, MARKS, SYMBOLS, UPPER

OWN = ("length", "upper", "symbols", "marks", "digits", "spaces", "repeats", "mean_word", "dup")


def line_table(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (one row per line: own, previous, next, edges, bias), length of each line in characters, number of lines of each text."""
    feats, weights, counts = [], [], []
    for a, b in pieces([len(d) for d in docs], 2 << 20):
        part = docs[a:b]
        data, starts = joined(part)
        ends = np.flatnonzero(data == 10) + 1
        bounds = np.concatenate([[0], ends])
        first = np.searchsorted(bounds, starts[:-1])
        n = np.diff(np.concatenate([first, [len(ends)]]))
        size = np.diff(bounds) - 1
        chars = totals((data & 0xC0) != 0x80, bounds) - 1
        whole = np.maximum(size, 1).astype(np.float64)
        letters = np.maximum(totals(LETTER[data], bounds), 1)
        words = np.zeros(len(size))
        unique = np.zeros(len(size))
        dup = np.zeros(len(size))
        at = 0
        for d in part:
            seen = set()
            for line in d.split(b"\n"):
                w = line.split()
                words[at] = len(w)
                unique[at] = len(set(w))
                if w:
                    dup[at] = line in seen
                    seen.add(line)
                at += 1
        own = np.stack(
            [
                np.minimum(np.log1p(chars), 8.0) / 4.0,
                totals(UPPER[data], bounds) / letters,
                np.minimum(5 * totals(SYMBOLS[data], bounds) / whole, 1.0),
                np.minimum(10 * totals(MARKS[data], bounds) / whole, 1.0),
                np.minimum(5 * totals(DIGIT[data], bounds) / whole, 1.0),
                np.minimum(np.maximum(totals(SPACE[data], bounds) - 1, 0) / whole, 0.5),
                1.0 - unique / np.maximum(words, 1),
                np.minimum(chars / np.maximum(words, 1) / 10.0, 3.0),
                dup,
            ],
            axis=1,
        )
        top = np.zeros(len(size), dtype=bool)
        top[first] = True
        last = np.roll(top, -1)
        before = np.where(top[:, None], 0.0, np.roll(own, 1, axis=0))
        after = np.where(last[:, None], 0.0, np.roll(own, -1, axis=0))
        feats.append(np.concatenate([own, before, after, top[:, None], last[:, None], np.ones((len(size), 1))], axis=1))
        weights.append(chars)
        counts.append(n)
    if not feats:
        return np.zeros((0, 3 * len(OWN) + 3)), np.zeros(0), np.zeros(0, dtype=np.int64)
    return np.concatenate(feats), np.concatenate(weights), np.concatenate(counts)


def forward_backward(score: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) of each line and, summed over lines, P(pair of neighbouring labels) as a 2 x 2 table.

    score: log potential of good against bad, one per line. move: log potentials of (label, next label).
    All texts advance together; those that have ended drop out, so the work is in proportion to the lines.
    """
    n = len(counts)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    depth = counts[order]
    active = np.searchsorted(-depth, -np.arange(1, (depth[0] if n else 0) + 1), side="right")
    begin = start[order]
    alpha = np.zeros((len(score), 2))
    beta = np.zeros((len(score), 2))
    unary = np.stack([np.zeros(len(score)), score], axis=1)

    def step(previous: np.ndarray, table: np.ndarray) -> np.ndarray:
        return np.logaddexp(previous[:, :1] + table[0], previous[:, 1:] + table[1])

    for t, k in enumerate(active):
        at = begin[:k] + t
        alpha[at] = unary[at] if t == 0 else step(alpha[at - 1], move) + unary[at]
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        beta[at] = step(beta[at + 1] + unary[at + 1], move.T)
    both = alpha + beta
    good = logistic(both[:, 1] - both[:, 0])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(score), dtype=bool)
    inner[start[counts > 0]] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = alpha[at - 1][:, :, None] + move[None] + (unary[at] + beta[at])[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs


class LineCrf:
    """sample: most labelled rows per label value that the field is trained on; every line of these rows is used."""

    def __init__(self, sample: int = 2000, rounds: int = 120, ridge: float = 1e-3, seed: int = 11):
        self.sample, self.rounds, self.ridge, self.seed = sample, rounds, ridge, seed
        self.weight, self.move, self.scale = np.zeros(3 * len(OWN) + 3), np.zeros((2, 2)), (1.0, 0.0)

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf:
        ids = sampled_ids(labels, id_col, label_col, self.sample, self.seed)
        rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
        got = rows.mapInArrow(_lines, "label int, lines binary, chars binary").toPandas()
        width = len(self.weight)
        x = [np.frombuffer(b, dtype=np.float32).reshape(-1, width) for b in got["lines"]]
        chars = [np.frombuffer(b, dtype=np.int64) for b in got["chars"]]
        if x and got["label"].nunique() == 2:
            order = sorted(range(len(x)), key=lambda i: (got["label"][i], x[i].tobytes()))  # rows arrive in any order
            prior = labels.where(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
            self.train(np.concatenate([x[i] for i in order]).astype(np.float64), np.concatenate([chars[i] for i in order]), np.array([len(x[i]) for i in order]), got["label"].to_numpy()[order] == 1, prior)
        return self

    def train(self, x: np.ndarray, chars: np.ndarray, counts: np.ndarray, good: np.ndarray, prior: float) -> None:
        """Adam on the conditional likelihood; a line bears the label of its text. Each text weighs the same within its label."""
        label = np.repeat(good, counts).astype(np.float64)
        inner = np.ones(len(x), dtype=bool)
        inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[np.flatnonzero(inner) - 1].astype(int), label[inner].astype(int)), 1)
        theta = np.zeros(len(self.weight) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, self.rounds + 1):
            p, pairs = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), counts)
            grad = np.concatenate([x.T @ (label - p), (seen - pairs).ravel()]) / len(x) - self.ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta += 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        self.weight, self.move = theta[:-4], theta[-4:].reshape(2, 2)
        raw = self.raw(x, chars, counts)
        balance = np.where(good, prior / max(good.mean(), 1e-9), (1 - prior) / max(1 - good.mean(), 1e-9))
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton's steps of a two-parameter logistic fit, with a weak pull to slope 1
            p = logistic(a * raw + b)
            g = np.array([(balance * (good - p) * raw).sum() - (a - 1), (balance * (good - p)).sum() - 1e-3 * b])
            h = balance * p * (1 - p)
            hess = np.array([[(h * raw * raw).sum() + 1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, g), -1, 1)
        self.scale = (float(a), float(b))

    def raw(self, x: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' probabilities; lines without characters weigh 1 in 1000."""
        p, _ = forward_backward(x @ self.weight, self.move, counts)
        starts = np.concatenate([[0], np.cumsum(counts)])
        w = chars + 1e-3
        run = np.zeros((2, len(p) + 1))
        np.cumsum(w * p, out=run[0, 1:])
        np.cumsum(w, out=run[1, 1:])
        mean = np.diff(run[0][starts]) / np.maximum(np.diff(run[1][starts]), 1e-9)
        mean = np.clip(mean, 1e-3, 1 - 1e-3)
        return np.log(mean / (1 - mean))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
        """id, score (probability of label 1), predicted (1 if score >= threshold), n_lines."""
        model, kind = self, docs.schema[id_col].dataType.simpleString()

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score, lines = model.scores(blobs(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(lines)], names=[id_col, "score", "predicted", "n_lines"])

        return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, score double, predicted int, n_lines bigint")

    def keep(self, docs: DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
        """The rows, with all their columns, whose score reaches the threshold. No shuffle: each batch filters itself."""
        model, at = self, docs.columns.index(text_col)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(model.scores(blobs(batch.column(at)))[0] >= threshold))

        return docs.mapInArrow(judge, docs.schema)

    def scores(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        score, lines = np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
        for a, b in pieces([len(d) for d in docs], 8 << 20):
            x, chars, counts = line_table(docs[a:b])
            score[a:b] = logistic(self.scale[0] * self.raw(x, chars, counts) + self.scale[1])
            lines[a:b] = counts
        return score, lines


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = blobs(batch.column(1))
        for a, b in pieces([len(d) for d in docs], 8 << 20):
            x, chars, counts = line_table(docs[a:b])
            at = np.concatenate([[0], np.cumsum(counts)])
            x = x.astype(np.float32)
            parts = [(x[i:j].tobytes(), chars[i:j].astype(np.int64).tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([p for p, _ in parts], type=pa.binary()), pa.array([c for _, c in parts], type=pa.binary())], names=["label", "lines", "chars"])
