"""SimHash near-dedup by anchor-point covering.

The 64 bits are split into five blocks, and four windows of two blocks each are chosen so that, wherever 4 bits
differ, some window holds at most 1 of them (see WINDOWS). In a window the anchors are the words of a linear covering
code, a shortened Hamming code with 5 parity bits: every point lies within the covering radius of one. A fingerprint
belongs to the anchor its syndrome leads to, and is replicated to every anchor that a fingerprint with one other bit
can belong to: all that matter within the covering radius plus the threshold. Two near fingerprints so meet at an
anchor, where they are compared in full.

Equal fingerprints are one row before that. At an anchor only a spanning forest of the links found is kept, so that
the rows stay in proportion to the fingerprints however dense a group is. Anchors are counted first; those with very
many fingerprints are cut into blocks that are compared pairwise in tasks of their own.

Contract on edge cases: a null or empty text has fingerprint zero and is linked like any other. Ids are of any type that
has an order. A row without an id links others as any row does but never names a component; a component of such rows
alone has id null. Rows that repeat an id are judged each by its own text. Repeated rows share a component. A bit that is
set in exactly half the hashes is 0; of equally small ids there is but one value. A very long text is hashed in slices of
65,536 shingles and needs memory in proportion to its length. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, materialize
from .components import components

THRESHOLD = 4
#: (lowest bit, width) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Sorted by size, 4 differing bits put 0 into the smallest block and at most 1 into the next. Two blocks that hold at
#: most 1 together always form one of these pairs: any three blocks contain a pair, and every block is in one.
WINDOWS = ((0, 1), (2, 3), (3, 4), (2, 4))
PARITY = 5
#: Rows at one anchor that a task compares; an anchor with more is cut into blocks.
MOST_ROWS = 1 << 14


def fingerprint(text: bytes, size: int = 4) -> int:
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    whole = b" ".join(words)
    if n <= size:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - size] + 1]).tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(starts), 1 << 16):
        h = np.array([digest(whole[i:j], 42) for i, j in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """rows with fp (the 64 bits as a signed number) in place of their last column, a text."""
    *kept, _ = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(b) for b in blobs(batch.columns[-1])], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*(f.name for f in kept), "fp"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp bigint"]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp."""
    return _with_fingerprint(docs.select(id_col, text_col))


class Anchors:
    """The covering code of one window: point -> the anchor it belongs to."""

    def __init__(self, width: int):
        columns = np.arange(1, width + 1)  # the syndrome of each bit, all different and not zero
        self.width = width
        self.checks = [np.uint64(sum(1 << b for b in range(width) if columns[b] >> r & 1)) for r in range(PARITY)]
        leader = np.zeros(1 << PARITY, dtype=np.uint64)
        for s in range(1, 1 << PARITY):
            one = np.flatnonzero(columns == s)
            if len(one):
                leader[s] = 1 << int(one[0])
            else:  # covering radius 2: some two bits have this syndrome
                i, j = next((i, j) for i in range(width) for j in range(i) if columns[i] ^ columns[j] == s)
                leader[s] = (1 << i) | (1 << j)
        self.leader = leader

    def of(self, points: np.ndarray) -> np.ndarray:
        syndrome = np.zeros(points.shape, dtype=np.uint64)
        for r, check in enumerate(self.checks):
            syndrome |= (np.bitwise_count(points & check).astype(np.uint64) & np.uint64(1)) << np.uint64(r)
        return points ^ self.leader[syndrome]


def windows() -> list[tuple[list[tuple[int, int]], Anchors]]:
    return [([BLOCKS[i], BLOCKS[j]], Anchors(BLOCKS[i][1] + BLOCKS[j][1])) for i, j in WINDOWS]


def covered(fp: np.ndarray, window: int, blocks: list[tuple[int, int]], code: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, whether the row belongs there) of each anchor that each fingerprint goes to."""
    point, shift = np.zeros(len(fp), dtype=np.uint64), 0
    for low, width in blocks:
        point |= (fp >> np.uint64(low) & np.uint64((1 << width) - 1)) << np.uint64(shift)
        shift += width
    home = code.of(point)
    around = code.of(point[:, None] ^ (np.uint64(1) << np.arange(code.width, dtype=np.uint64))[None])
    keys = np.sort(np.concatenate([home[:, None], around], axis=1), axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, at = np.nonzero(fresh)
    key = keys[row, at]
    return row, (key | np.uint64(window << 32)).view(np.int64), key == home[row]


def replicate(nodes: DataFrame) -> DataFrame:
    """key, fp, home of every anchor of every row of nodes (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = windows()
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fps), 4096):
                for w, (blocks, code) in enumerate(codes):
                    row, key, home = covered(fps[a : a + 4096], w, blocks, code)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[a + row].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "key bigint, fp bigint, home boolean")


def pairs_within(fp: np.ndarray, first: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows of the same group; first[i] is the row where i's group starts. Groups stand together."""
    left, right = [], []
    n = len(fp)
    row = np.arange(n)
    d = 1
    row = row[row + d < n]
    while len(row):
        row = row[row + d < n]
        row = row[first[row + d] == first[row]]
        near = (np.bitwise_count(fp[row] ^ fp[row + d]) <= threshold) & (home[row] | home[row + d])
        left.append(row[near])
        right.append(row[near] + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (row, row)


def lowest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after all rows linked by pairs take the lowest label among them. labels[i] is a row of i's group."""
    while len(left):
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:  # to the end of each chain
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def forest(fp: np.ndarray, home: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that join exactly what near pairs within groups join."""
    sizes = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), [len(first)]])) if len(first) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    labels = np.arange(len(fp))
    small = np.repeat(sizes <= 64, sizes)
    rows = np.flatnonzero(small)
    if len(rows):
        l, r = pairs_within(fp[rows], first[rows], home[rows], threshold)
        labels = lowest(labels, rows[l], rows[r])
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        group = np.arange(s, s + n)
        at_home = group[home[group]]
        for a in range(0, len(at_home), 128):
            part = at_home[a : a + 128]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[group][None]) <= threshold)
            labels = lowest(labels, part[i], group[j])
    linked = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[linked], fp[labels[linked]]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups of a stream sorted by its first `keys` columns."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(got[0]):
            continue
        if rest is not None:
            got = [np.concatenate([a, b]) for a, b in zip(rest, got, strict=True)]
        last = _first(got[:keys])[-1]
        if last:
            yield [c[:last] for c in got]
        rest = [c[last:] for c in got]
    if rest is not None:
        yield rest


def _first(columns: list[np.ndarray]) -> np.ndarray:
    change = np.ones(len(columns[0]), dtype=bool)
    change[1:] = False
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def _links(rows: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Links (a, b) within groups of rows (keys, fp, home)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _grouped(batches, len(keys)):
            a, b = forest(columns[-2].view(np.uint64), columns[-1], _first(columns[:-2]), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = rows.select(*keys, "fp", "home").repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes (fp) that make the components of all pairs that differ in at most 4 bits."""
    rows = replicate(nodes)
    # an anchor with more rows than a task should compare; counted by partial sums
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS), "simhash-anchors")
    if sizes.isEmpty():
        return _links(rows, ["key"], threshold)
    return _links(rows.join(sizes, "key", "left_anti"), ["key"], threshold).unionByName(_split_links(rows.join(sizes, "key"), threshold))


def _split_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links at anchors with n rows, too many: homes are cut into blocks i, all rows into blocks j, and each (i, j) is a task's group."""
    blocks = F.ceil(F.col("n") / F.lit(MOST_ROWS // 2)).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    homes = cut.where("home").select("key", F.col("own").alias("i"), every.alias("j"), "fp", F.lit(True).alias("home"))
    others = cut.select("key", every.alias("i"), F.col("own").alias("j"), "fp", F.lit(False).alias("home"))
    return _links(homes.unionByName(others), ["key", "i", "j"], threshold)


def classes(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fp, class (one fingerprint for all that are linked) of the distinct fingerprints of fps."""
    nodes = materialize(fps.select("fp").distinct(), "fingerprint-nodes")
    found = components(near_links(nodes, threshold)).withColumnRenamed("node", "fp")
    return materialize(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class")), "fingerprint-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    fps = materialize(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    low = fps.groupBy("fp").agg(F.min("id").alias("low")).join(classes(fps, threshold), "fp")
    named = low.join(low.groupBy("class").agg(F.min("low").alias("component_id")), "class").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest id, rows without an id last; of rows that repeat this id, the one with the smallest fingerprint, then digest of the text; of rows equal in all of these, any one.

    Rows are told apart by id and MD5 of the text, so that rows of one id but different texts each count for themselves.
    """
    digest = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    rows = _with_fingerprint(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).alias("text")))
    fps = materialize(rows, "fingerprints")
    own = fps.groupBy("id", "digest", "fp").agg(F.count(F.lit(1)).alias("n")).join(classes(fps, threshold), "fp")
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "fp", "digest")
    own = own.join(own.groupBy("class").agg(F.min(rank).alias("first")), "class")
    marks = own.withColumn("stays", rank.eqNullSafe(F.col("first"))).where("not stays or n > 1")
    marks = materialize(marks.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "stays"), "near-duplicates")
    # always the shuffled join, so that the work grows alike at every size; the rows that go grow with the documents
    same = docs[id_col].eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    marked = docs.join(marks.hint("merge"), same, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.where("stays").dropDuplicates(["_id", "_digest"]).select(*columns)  # equal rows, of which one stays
    return marked.where("stays is null").select(*columns).unionByName(once)
