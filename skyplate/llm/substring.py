"""Substring dedup with a log-structured fingerprint index.

A window is 13 consecutive words. Its fingerprint is the smallest hash among its 5-word sequences: equal windows have
equal fingerprints, and neighbouring windows mostly share one, so that the index holds about one row for each five
windows. Documents come in batches. Each batch leaves two immutable sorted runs, bucketed by fingerprint: its
fingerprints (fp, doc), and the verified windows (fp, h, doc) of fingerprints that several documents share, where h
hashes all 13 words; compaction leaves the smallest document of each. A batch is merge-joined with the runs of the
batches before it, bucket by bucket and without a shuffle of history:

* fingerprints that stand in history or in two documents of the batch make candidates;
* a candidate that only one earlier document holds has that document's windows computed now, from its compressed text,
  which lies bucketed by id beside the index and is not moved for that; candidates that more of them hold have theirs in
  the runs already;
* windows are equal if both the fingerprint (64 bits of 5 words) and h (64 bits of 13 words) are;
* words are cut out of the new texts alone, at the places of their repeated windows, which the runs hold beside the
  windows: no text is hashed once more for that.

compact() merges the runs into one. Documents never lose words to later batches, so that batches in the order of ids
give what one batch of all would.

Contract on edge cases: a null or empty text has no words; a document without an id takes no part and keeps its words;
rows that repeat an id count as one document, so that they never remove each other's words; ids are of any type that
has an order; an empty table gives an empty result; other columns are ignored, whatever their names. A very long text is
scanned in memory in proportion to its length. Ties: of documents with the same window all but the one with the smallest
id lose it, and within a document every occurrence counts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WRITTEN, blobs, discard, joined, materialize, pieces, shared_folder

WINDOW = 13
GRAM = 5
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: FACTOR's inverse modulo 2 ** 64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 20
#: Bits of a place that number the word; a text below 2 GB has fewer words than that.
WORD_BITS = 30


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * FACTOR
    return h ^ (h >> np.uint64(32))


def window_fingerprints(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each window of all texts, in order; number of words of each text."""
    data, starts = joined(docs)
    word = ~SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(begin, starts))
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, len(data)), out=run[1:])
    h = mixed((run[end] - run[begin]) * powers(INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), counts
    gram = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        gram += h[k : k + n] * MIX ** np.uint64(2 * k + 1)
    low = mixed(gram)
    reach, have = WINDOW - GRAM + 1, 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    first = np.concatenate([[0], np.cumsum(counts)])
    inside = np.zeros(max(len(low), 0), dtype=bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WINDOW:
            inside[a : b - WINDOW + 1] = True
    return low[inside], counts


def doc_fingerprints(docs: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, fingerprints of all windows, number of words of each text) of slices of docs of bounded size."""
    for a, b in pieces([len(d) for d in docs], SLICE):
        fp, counts = window_fingerprints(docs[a:b])
        yield a, b, fp.view(np.int64), counts


class FingerprintIndex:
    """Sorted runs in `buckets` buckets in the shared folder. most_runs: a batch that finds as many compacts them first."""

    def __init__(self, spark: SparkSession, id_type: str = "bigint", buckets: int | None = None, most_runs: int = 8):
        self.spark, self.kind, self.most_runs, self.runs, self.live = spark, id_type, most_runs, 0, 0
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.tables: dict[str, str] = {}  # fingerprints, windows, texts: name of the table, which is also its folder

    def _write(self, kind: str, rows: DataFrame, run: int, by: str, order: list[str]) -> None:
        name = self.tables.setdefault(kind, f"{kind}_{uuid.uuid4().hex}")
        path = f"{shared_folder(self.spark)}/{name}"
        dealt = rows.withColumn("run", F.lit(run)).repartition(self.buckets, by)  # the writer sorts
        fresh = path not in WRITTEN
        dealt.write.mode("errorifexists" if fresh else "append").option("path", path).option("compression", "zstd").partitionBy("run").bucketBy(self.buckets, by).sortBy(*order).saveAsTable(name)
        if fresh:
            WRITTEN.append(path)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{shared_folder(self.spark)}/{name}")

    def drop(self, *kinds: str) -> None:
        """Drop tables (all of them by default) and delete their files."""
        for kind in kinds or list(self.tables):
            self._drop(self.tables.pop(kind))

    def compact(self) -> None:
        """All runs become one; the old ones are deleted."""
        last, self.live = self.runs - 1, 1
        windows = self.windows().groupBy("fp", "h").agg(F.min("doc").alias("doc")).withColumns({"probe": F.lit(False), "places": F.array().cast("array<bigint>")})
        for kind, rows, order in (("fingerprints", self.fingerprints().select("fp", "doc").distinct(), ["fp", "doc"]), ("windows", windows, ["fp", "h", "doc"])):
            old = self.tables.pop(kind)
            self._write(kind, rows, last, "fp", order)
            self._drop(old)

    def fingerprints(self) -> DataFrame:
        """fp, doc, run."""
        return self.spark.table(self.tables["fingerprints"])

    def windows(self) -> DataFrame:
        """fp, h, doc, probe, places, run."""
        return self.spark.table(self.tables["windows"])

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch (id, text), ids not null. Returns its compressed texts (id, body) and, of documents that lose words, id and hits: places of the windows that a document with a smaller id has too."""
        if self.live >= self.most_runs:
            self.compact()
        k, self.runs, self.live = self.runs, self.runs + 1, self.live + 1
        self._write("texts", packed(docs), k, "id", ["id"])
        texts = self.spark.table(self.tables["texts"])
        self._write("fingerprints", doc_postings(docs.select("id", "text"), self.kind), k, "fp", ["fp", "doc"])
        new, old = self.fingerprints().where(F.col("run") == k), self.fingerprints().where(F.col("run") < k)
        shared = new.groupBy("fp").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        history = old.groupBy("fp").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        shared = shared.join(history.hint("merge"), "fp", "left").where("low < high or first is not null")
        # a window whose fingerprint no smaller id has can't be repeated; it only stands for the first document with its hash
        alone = (F.col("doc") == F.col("low")) & ~F.coalesce(F.col("first") < F.col("doc"), F.lit(False))
        candidates = new.join(shared.hint("merge"), "fp").groupBy("doc").agg(F.collect_list(F.when(alone, F.col("fp"))).alias("own"), F.collect_list(F.when(~alone, F.col("fp"))).alias("fps"))
        opened = shared.where("first = last").groupBy(F.col("first").alias("doc")).agg(F.collect_list("fp").alias("own"), F.array().cast("array<bigint>").alias("fps"))
        found = windows_in(texts.where(F.col("run") == k), candidates, self.kind).unionByName(windows_in(texts.where(F.col("run") < k), opened, self.kind))
        self._write("windows", found, k, "fp", ["fp", "h", "doc"])
        # the smallest document so far of each window; a window of one fingerprint lies in one bucket, and is streamed
        so_far = Window.partitionBy("fp", "h").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hits = self.windows().withColumn("first", F.min("doc").over(so_far)).where((F.col("run") == k) & F.col("probe") & (F.col("doc") > F.col("first")))
        hits = materialize(hits.groupBy(F.col("doc").alias("id")).agg(F.flatten(F.collect_list("places")).alias("hits")), "hits")
        return texts.where(F.col("run") == k).select("id", "body"), hits


def doc_postings(docs: DataFrame, kind: str) -> DataFrame:
    """fp, doc: the distinct fingerprints of the windows of each text of docs (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, fp, counts in doc_fingerprints(blobs(batch.column(1))):
                of = np.repeat(np.arange(a, b), np.maximum(counts - WINDOW + 1, 0))
                fresh = np.ones(len(fp), dtype=bool)
                fresh[1:] = (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])
                fp, of = fp[fresh], of[fresh]
                order = np.lexsort((fp, of))
                fp, of = fp[order], of[order]
                fresh = np.ones(len(fp), dtype=bool)
                fresh[1:] = (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(fp[fresh]), batch.column(0).take(pa.array(of[fresh]))], names=["fp", "doc"])

    return docs.mapInArrow(scan, f"fp bigint, doc {kind}")


def windows_of(text: bytes, at: np.ndarray) -> list[int]:
    """XXH3 of the word sequence of the windows that start at the words `at`."""
    words = text.split()
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    return [digest(whole[i:j]) for i, j in zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True)]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each list of a list column, and its values as a flat array; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size)]), pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)


def text_tag(text: bytes) -> int:
    """The upper bits of places in a text: they tell texts under one id apart."""
    return xxhash.xxh3_64_intdigest(text) >> (WORD_BITS + 1) << WORD_BITS


def candidate_windows(bodies: list[bytes | None], bounds: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, text, and place, fingerprint and hash of the windows whose fingerprint is wanted, of each compressed text for which any is."""
    unpress = zstandard.ZstdDecompressor().decompress
    some = np.flatnonzero(np.diff(bounds))
    for lot in range(0, len(some), 64):
        part = some[lot : lot + 64].tolist()
        docs = [unpress(bodies[i]) for i in part]
        for a, b, fp, counts in doc_fingerprints(docs):
            ends = np.concatenate([[0], np.cumsum(np.maximum(counts - WINDOW + 1, 0))])
            for i, doc, start, stop in zip(part[a:b], docs[a:b], ends[:-1], ends[1:], strict=True):
                own = fp[start:stop]
                at = np.flatnonzero(np.isin(own, wanted[bounds[i] : bounds[i + 1]]))
                yield i, doc, at, own[at], np.array(windows_of(doc, at) if len(at) else [], dtype=np.uint64).view(np.int64)


def packed(docs: DataFrame) -> DataFrame:
    """id, body: the compressed text. Shuffled twice, it takes half the room that the text would."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(t) for t in blobs(batch.column(1))], type=pa.binary())], names=["id", "body"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, body binary")


def windows_in(texts: DataFrame, candidates: DataFrame, kind: str) -> DataFrame:
    """fp, h, doc, probe, places: the distinct windows of each text (id, body) whose fingerprint is among the candidates (doc, own, fps); probe: it is in fps; places: where they start, if so."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (own_at, own), (fps_at, fps) = lists(batch.column(2)), lists(batch.column(3))
            rest = own_at[:-1] + fps_at[:-1]  # both lists of a text one after the other
            wanted = np.empty(len(own) + len(fps), dtype=np.int64)
            wanted[np.arange(len(own)) + np.repeat(rest - own_at[:-1], np.diff(own_at))] = own
            wanted[np.arange(len(fps)) + np.repeat(rest + np.diff(own_at) - fps_at[:-1], np.diff(fps_at))] = fps
            found = []
            for i, text, at, fp, h in candidate_windows(batch.column(1).to_pylist(), own_at + fps_at, wanted):
                order = np.lexsort((h, fp))
                at, fp, h = at[order], fp[order], h[order]
                fresh = np.ones(len(fp), dtype=bool)
                fresh[1:] = (fp[1:] != fp[:-1]) | (h[1:] != h[:-1])
                probe = np.isin(fp, fps[fps_at[i] : fps_at[i + 1]])
                size = np.diff(np.append(np.flatnonzero(fresh), len(fp)))
                found.append((np.full(len(size), i), fp[fresh], h[fresh], probe[fresh], np.where(probe[fresh], size, 0), (at + text_tag(text))[probe]))
            if found:
                of, fp, h, probe, size, place = (np.concatenate(x) for x in zip(*found, strict=True))
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(place))
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(h), batch.column(0).take(pa.array(of)), pa.array(probe), places], names=["fp", "h", "doc", "probe", "places"])

    rows = texts.join(candidates.withColumnRenamed("doc", "id"), "id").select("id", "body", "own", "fps")
    return rows.mapInArrow(scan, f"fp bigint, h bigint, doc {kind}, probe boolean, places array<bigint>")


def without(text: bytes, bad: np.ndarray) -> tuple[int, int, bytes]:
    """Number of words, number of words in the windows that start at `bad`, the other words joined by one space."""
    words = text.split()
    n = len(words)
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, bad, 1)
    np.add.at(cover, bad + WINDOW, -1)
    gone = np.cumsum(cover[:n]) > 0
    return n, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def cut(texts: DataFrame, hits: DataFrame, id_col: str, kind: str) -> DataFrame:
    """id, text, n_words, n_removed of compressed texts (id, body) and the places of the windows to remove (id, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bounds, places = lists(batch.column(2))
            out = []
            for body, a, b in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                text, own = unpress(body), places[a:b]
                if b > a:  # leave out those of another text under this id
                    own = own[own >> WORD_BITS == text_tag(text) >> WORD_BITS] & ((1 << WORD_BITS) - 1)
                if len(own):
                    out.append(without(text, own))
                else:
                    words = text.split()
                    out.append((len(words), 0, b" ".join(words)))
            columns = [pa.array([x[2] for x in out], type=pa.binary()).cast(pa.string()), *(pa.array([x[k] for x in out], type=pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "text", "n_words", "n_removed"])

    rows = texts.join(hits, "id", "left").select("id", "body", "hits")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string, n_words bigint, n_removed bigint")


def ranges(ids: DataFrame, parts: int) -> list:
    """Ids at which the ids are cut into so many batches of about the same size, in order."""
    ends = ids.repartitionByRange(parts, "id").groupBy(F.spark_partition_id()).agg(F.max("id").alias("end")).collect()
    ends = sorted(r["end"] for r in ends)
    return sorted({ends[len(ends) * k // parts - 1] for k in range(1, parts) if len(ends) * k // parts})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, most_runs: int = 8) -> DataFrame:
    """id, text (kept words joined by one space), n_words, n_removed. The documents enter the index in so many batches, in the order of their ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named, index = plain.where("id is not null"), FingerprintIndex(docs.sparkSession, kind, most_runs=most_runs)
    cuts = ranges(named.select("id"), batches)
    out = cut(packed(plain.where("id is null")), plain.limit(0).select("id", F.lit(None).cast("array<bigint>").alias("hits")), id_col, kind)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = named.where(F.col("id") > F.lit(low)) if low is not None else named
        out = out.unionByName(cut(*index.add(batch.where(F.col("id") <= F.lit(high)) if high is not None else batch), id_col, kind))
    index.drop("fingerprints", "windows")  # the result still reads the texts
    return out


def digests(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int, str]]:
    """The same by definition, for tests: doc -> (n_words, n_removed, sha256 of the kept words)."""
    split = {i: t.encode().split() for i, t in rows}
    first: dict[tuple[bytes, ...], int] = {}
    for i in sorted(split):
        for k in range(len(split[i]) - WINDOW + 1):
            first.setdefault(tuple(split[i][k : k + WINDOW]), i)
    out = {}
    for i, words in split.items():
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if first[tuple(words[k : k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        out[i] = (len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
    return out
