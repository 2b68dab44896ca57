"""Quality rules: rule statistics of each text, and isolation forests over them.

Each rule statistic has a forest of its own, and one more has all of them together: random splits of rows drawn without
regard to their labels, in which an anomalous value stands alone after a short path. As the method has it, a tree splits
a few rows only (256); they are drawn from all documents that pass the base rule, labelled or not. Labels only calibrate
the thresholds, and all labelled rows count there: a score is a whole multiple of 1 / STEPS, so that the numbers of good
and bad rows of each score are a table of bounded size. A rule rejects what lies above its threshold, and a rule that
tells bad rows from good ones by nothing has none. (A single forest over all statistics finds the rarest rows, which are rare in any of them, and not those that
labels call bad: at a loss of .2 % of the good rows it rejected 4 % of the bad.)

Contract on edge cases: a null or empty text has zero for every statistic and fails the base rule; a null id
passes through; repeated rows are judged one by one; an empty table gives an empty result; columns other than
the id and the text are ignored, whatever their names; a repeated label counts once, with its largest value, and null
labels and ids teach nothing. A very long text is measured whole, in memory in proportion to
its length. Ties: a score that equals the threshold is kept; of rules that gain the same the first one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, blobs, joined, materialize, mixed, pieces, share_below, totals

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LOWER = np.zeros(256, dtype=bool)
LOWER[97:123] = True
LETTER = UPPER | LOWER
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b"!?")] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_marks", "n_digits", "n_lines")
#: Inputs of the forest, none of which grows with the length of a text.
RATIOS = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "marks", "digits")


def repeated(words: list[bytes]) -> int:
    """Words in a 3-word window that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    if len(ids) >= 1 << 20:  # three ids no longer fit into 63 bits: rank the pairs first
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        grams = pair[:-1] * len(ids) + w[2:]
    else:
        grams = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(docs: list[bytes]) -> np.ndarray:
    """One row per text, columns BASE + MORE."""
    out = np.zeros((len(docs), len(BASE) + len(MORE)), dtype=np.int64)
    for a, b in pieces([len(d) for d in docs], 4 << 20):
        data, bounds = joined(docs[a:b])
        word = ~SPACE[data]
        out[a:b, 1] = totals(word & ((data & 0xC0) != 0x80), bounds)
        for k, flags in ((2, SYMBOLS), (5, UPPER), (6, LETTER), (7, MARKS), (8, DIGIT)):
            out[a:b, k] = totals(flags[data], bounds)
        for i in range(a, b):
            words = docs[i].split()
            lines = [x for x in docs[i].split(b"\n") if x.strip()]
            out[i, 0] = len(words)
            out[i, 3] = len(lines) - len(set(lines))
            out[i, 4] = repeated(words)
            out[i, 9] = len(lines)
    return out


def ratios(stats: np.ndarray) -> np.ndarray:
    s = stats.astype(np.float64).T
    words, chars, lines, letters = (np.maximum(x, 1) for x in (s[0], s[1], s[9], s[6]))
    return np.stack([s[1] / words, s[2] / chars, s[3] / lines, s[4] / words, s[5] / letters, s[7] / chars, s[8] / chars], axis=1)


def path_norm(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, dtype=np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random splits kept as flat arrays: feature (-1 at a leaf), threshold, right child; the left child follows its parent."""

    def __init__(self, trees: int = 50, rows: int = 256, seed: int = 7):
        self.trees, self.rows, self.seed = trees, rows, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        feature, threshold, left, right, size, self.roots = [], [], [], [], [], []
        deepest = int(np.ceil(np.log2(max(self.rows, 2))))

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for store, value in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (size, depth + float(path_norm(len(part))))):
                store.append(value)
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(open_):
                return at
            f = int(rng.choice(open_))
            t = float(rng.uniform(low[f], high[f]))
            below = part[:, f] <= t
            feature[at], threshold[at], size[at] = f, t, 0.0
            left[at] = grow(part[below], depth + 1)
            right[at] = grow(part[~below], depth + 1)
            return at

        if len(x):
            for _ in range(self.trees):
                self.roots.append(grow(x[rng.choice(len(x), size=min(self.rows, len(x)), replace=False)], 0))
        self.feature, self.threshold, self.left, self.right, self.size = (np.asarray(v) for v in (feature, threshold, left, right, size))
        self.depth = deepest
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-path / expected path): near 1 for a row that few splits isolate."""
        if not self.roots:
            return np.zeros(len(x))
        out = np.empty(len(x))
        for a in range(0, len(x), 2000):
            rows = x[a : a + 2000]
            node = np.tile(np.asarray(self.roots), (len(rows), 1))
            at = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                node = np.where(f < 0, node, np.where(rows[at, f] <= self.threshold[node], self.left[node], self.right[node]))
            out[a : a + 2000] = 2.0 ** (-self.size[node].mean(axis=1) / float(path_norm(np.asarray(self.rows))))
        return out


#: Scores that rules compare are rounded to whole multiples of 1 / STEPS.
STEPS = 1 << 16


def calibrate(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, most_lost: float) -> float:
    """Threshold that rejects most bad rows while it rejects at most a share most_lost of the good ones.

    steps: the distinct scores, ascending; good, bad: how many rows have each.
    """
    if not good.sum() or not bad.sum():
        return float(STEPS)
    good_to, bad_to = np.cumsum(good), np.cumsum(bad)
    least = int(np.searchsorted(good_to, np.ceil((1 - most_lost) * (good_to[-1] - 1)), side="right"))
    cuts = steps[least:]
    margin = (cuts + np.concatenate([cuts[1:], [STEPS]])) / 2
    gain = (1 - bad_to / bad_to[-1] - (1 - good_to / good_to[-1]))[least:]
    best = np.flatnonzero(gain >= gain.max() - 1e-3)
    return float(margin[best[len(best) // 2]])


#: The statistics of each forest: one each, and all.
FORESTS = (*((k,) for k in range(len(RATIOS))), tuple(range(len(RATIOS))))


class QualityRules:
    """Fits the forests to all rows and their thresholds to all labelled rows; applies them to every row.

    most_lost: largest share of the rows labelled good that all thresholds together may reject. least_gain: share of the
    rows labelled bad, less that of the good, that a rule must reject beyond the others.
    """

    def __init__(self, most_lost: float = 0.002, least_gain: float = 0.01, seed: int = 7):
        self.most_lost, self.least_gain, self.seed = most_lost, least_gain, seed
        self.rules: list[tuple[tuple[int, ...], IsolationForest, float]] = []

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityRules:
        return self.learn(materialize(measured(docs, id_col, text_col), "statistics"), labels, label_col)

    def learn(self, stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> QualityRules:
        """fit, from the table of measured(). The id has the same name in both tables."""
        id_col = stats.columns[0]
        passed = stats.where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
        x = self.draw(passed)
        if len(x):
            label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg((F.max(label_col) == 1).alias("_good"))
            self.calibrate(self.grow(x[np.lexsort(x.T)]), passed.join(label, id_col).select("_good", *BASE, *MORE))  # rows arrive in any order
        return self

    def draw(self, passed: DataFrame) -> np.ndarray:
        """Ratios of as many rows as all trees of a forest draw, those whose hash is smallest."""
        forest = IsolationForest()
        most, key = forest.trees * forest.rows, mixed(F.struct(*passed.columns), self.seed)
        few = passed.where(key <= share_below(2 * most, F.lit(passed.count()))).orderBy(key).limit(most)
        return ratios(matrix(few.select(*BASE, *MORE).toArrow().columns))

    def grow(self, x: np.ndarray) -> list[IsolationForest]:
        """The forests, from rows without labels."""
        return [IsolationForest(seed=self.seed).fit(x[:, columns]) for columns in FORESTS]

    def calibrate(self, forests: list[IsolationForest], rows: DataFrame) -> None:
        """Add the rule that gains most beyond those already there, as long as one gains enough. rows: whether good, and the statistics."""

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = ratios(matrix(batch.columns[1:]))
                steps = np.stack([rounded(f.score(x[:, columns])) for f, columns in zip(forests, FORESTS, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(steps), type=pa.list_(pa.int32()))], names=["good", "steps"])

        left = materialize(rows.mapInArrow(scored, "good boolean, steps array<int>"), "scores")
        n_good = n_bad = None
        lost = 0.0
        while True:
            found = left.select("good", F.posexplode("steps").alias("k", "step")).groupBy("k", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
            k, step, good, bad = (c.to_numpy() for c in found.orderBy("k", "step").toArrow().columns)  # at most STEPS + 1 of each forest
            if n_good is None:
                n_good, n_bad = good[k == 0].sum(), bad[k == 0].sum()
            if not n_good or not n_bad:
                return
            best = (self.least_gain, None, 1.0, 0.0)
            for i in range(len(FORESTS)):
                own = k == i
                if own.any():
                    cut = calibrate(step[own], good[own], bad[own], max(self.most_lost - lost, 0.0))
                    above = own & (step > cut)
                    more = good[above].sum() / n_good
                    best = max(best, (bad[above].sum() / n_bad - more, i, cut, more), key=lambda b: b[0])
            _, i, cut, more = best
            if i is None:
                return
            self.rules.append((FORESTS[i], forests[i], cut / STEPS))
            left, lost = left.where(F.col("steps")[i] <= cut), lost + more

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The furthest that any rule's score lies above its threshold; above 0 a row is rejected."""
        return np.max([rounded(f.score(x[:, columns])) / STEPS - cut for columns, f, cut in self.rules], axis=0) if self.rules else np.full(len(x), -1.0)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return self.judge(measured(docs, id_col, text_col))

    def judge(self, stats: DataFrame) -> DataFrame:
        """apply, from the table of measured()."""
        model, id_col = self, stats.columns[0]

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stats = matrix(batch.columns[1:])
                bad = failed(stats)
                score = model.anomaly(ratios(stats))
                columns = [*batch.columns[: len(BASE) + 1], pa.array(bad), pa.array(score), pa.array(~bad & (score <= 0))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *BASE, "base_failed", "anomaly", "kept"])

        schema = f"`{id_col}` {stats.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean"
        return stats.mapInArrow(judged, schema)


def rounded(score: np.ndarray) -> np.ndarray:
    return np.rint(score * STEPS).astype(np.int32)


def matrix(columns: list) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in columns], axis=1)


def failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and a column for each statistic."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in stats.T)], names=[id_col, *BASE, *MORE])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(measure, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in BASE + MORE))
