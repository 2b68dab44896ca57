"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are the lower-cased runs of letters and digits. A mask chooses some positions of a span of words; the hash of the
words at these positions is a seed, which a substitution elsewhere in the span leaves as it is. Seeds of benchmark items
and of documents meet in an equi-join; each hit lines an item up with a document, and word by word comparison around the
hit decides: a run of `overlap` words (or the whole item, if that is shorter) with at most `substitutions` others. Items
of 5 to 9 words are found with one word replaced, as two would leave too little of them; shorter ones as they are.

Whether a text overlaps an item depends on the text alone, so texts are told apart by their digest, and ids only name
the rows in the result: rows without an id, or that repeat one, are each judged by their own text. Items with the same
words are one item, reported by its smallest id with the number of its copies.

Contract on edge cases: a null or empty text has no words; items below `overlap` words are looked for as a whole, with
the masks of their length (TIERS), and items without words are left out; an item without an id counts like any other and is reported as null. Of several items or alignments
of a document the one with the most equal words is reported, then the smallest item id, then the first place. A very long text
is one row, of 8 bytes a word; the alignments of a text and an item are at most as many as their words together.
Empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Positions that each mask compares. Whatever two words of a run of OVERLAP are replaced, one of the masks still hits
#: somewhere in the run (tests check all pairs).
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 5, 8, 9), (0, 1, 3, 6, 8, 9, 10))
OVERLAP = 13
SUBSTITUTIONS = 2
LEAST = 5
#: From how many words on, how many of a run may be others, and the masks that hit it whichever they are. Items below
#: LEAST words must stand in the document word for word.
TIERS = (
    *((n, 0, (tuple(range(n)),)) for n in range(1, LEAST)),
    (LEAST, 1, ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))),
    (7, 1, ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 2, 3, 5))),
    (10, SUBSTITUTIONS, ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6))),
    (OVERLAP, SUBSTITUTIONS, MASKS),
)
#: A table of seeds or hits of more rows than this is never broadcast.
MOST_BROADCAST = 500_000


def words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(h: Column, positions: tuple[int, ...], mask: int) -> Column:
    """The seed at each start in the array of word hashes h at which the mask fits."""
    starts = F.sequence(F.lit(0), F.size(h) - F.lit(positions[-1] + 1))
    made = F.transform(starts, lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + F.lit(k)) for k in positions]))
    return F.when(F.size(h) > F.lit(positions[-1]), made).otherwise(F.array().cast("array<bigint>"))


def exploded(rows: DataFrame, masks: list[tuple[int, tuple[int, ...]]], keep: list[str]) -> DataFrame:
    """keep, at, seed: a row for each seed of each mask; at is the word it starts at."""
    made = F.array(*[seeds(F.col("h"), p, m) for m, p in masks])
    inner = rows.select(*keep, F.explode(made).alias("s"))
    return inner.select(*keep, F.posexplode("s").alias("at", "seed"))


def tier(size: Column) -> Column:
    """The place in TIERS of an item of so many words."""
    return F.size(F.filter(F.array(*[F.lit(t[0]) for t in TIERS]), lambda n: n <= size)) - 1


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def aligned(wanted: Column, h: Column, shift: Column) -> Column:
    """1 or 0 for each word i of `wanted` that lies within h at i + shift: are the two equal?"""
    start, stop = F.greatest(F.lit(0), -shift), F.least(F.size(wanted), F.size(h) - shift)
    same = F.transform(F.sequence(start, stop - 1), lambda i: (F.get(wanted, i) == F.get(h, i + shift)).cast("int"))
    return F.when(stop > start, same).otherwise(F.array().cast("array<int>"))


def total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda a, x: a + x)


def overlaps(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """digest, item, copies, at, n_same, n_item: one row for each overlapping pair of distinct texts of texts (digest, text) and distinct items.

    item: smallest id of the items with these words, copies: how many they are, at: word of the text where the item's
    first word lines up in the best alignment, n_same: equal words of that alignment, n_item: words of the item.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("h")).where(F.size("h") > 0)
    items = items.groupBy("h").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("copies"))
    items = materialize(items.withColumn("key", F.md5(F.array_join(F.transform("h", lambda w: w.cast("string")), " ").cast("binary"))), "benchmark-words")
    present = {r[0] for r in items.select(tier(F.size("h"))).distinct().collect()}  # at most len(TIERS) numbers
    masks = {k: [(k * 10 + n, p) for n, p in enumerate(TIERS[k][2])] for k in sorted(present)}
    found = exploded(items.limit(0), [(0, MASKS[0])], ["key"])
    for k, m in masks.items():
        found = found.unionByName(exploded(items.where(tier(F.size("h")) == k), m, ["key"]))
    item_seeds = materialize(found.withColumnsRenamed({"at": "item_at"}), "benchmark-seeds")
    n_seeds = item_seeds.count()
    own = texts.select("digest", words(F.col("text")).alias("h"))
    hits = exploded(own, sum(masks.values(), []) or [(0, MASKS[0])], ["digest"]).join(small(item_seeds, n_seeds), "seed")
    hits = hits.groupBy("digest", "key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    hits = materialize(hits, "benchmark-hits")
    n_hits = hits.agg(F.sum(F.size("shifts"))).first()[0] or 0
    lined = own.join(small(hits, n_hits), "digest").join(small(items.withColumnRenamed("h", "wanted"), n_seeds), "key")
    run = F.least(F.lit(OVERLAP), F.size("wanted"))
    least = run - F.get(F.array(*[F.lit(t[1]) for t in TIERS]), tier(F.size("wanted")))
    lined = lined.select("digest", "key", "item", "copies", "h", "wanted", "shifts", run.alias("run"), least.alias("least"))
    best = lambda same: F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size(same) - F.col("run"), F.lit(0))), lambda i: total(F.slice(same, i + 1, F.col("run")))))

    def fits(shift: Column) -> Column:  # no flags of an alignment outlive its comparison
        same = aligned(F.col("wanted"), F.col("h"), shift)
        return (F.size(same) >= F.col("run")) & (total(same) >= F.col("least")) & (best(same) >= F.col("least"))

    good = F.filter("shifts", fits)
    top = F.array_max(F.transform(good, lambda s: F.struct(total(aligned(F.col("wanted"), F.col("h"), s)).alias("n_same"), (-s).alias("back"))))
    out = lined.select("digest", "key", "item", "copies", F.size("wanted").alias("n_item"), top.alias("top")).where("top is not null")
    out = out.groupBy("digest", "key").agg(F.max(F.struct("top", "copies", "n_item", "item")).alias("t"))  # copies of a text
    return out.select("digest", "t.item", "t.copies", (-F.col("t.top.back")).alias("at"), F.col("t.top.n_same").cast("bigint").alias("n_same"), F.col("t.n_item").cast("bigint").alias("n_item"))


def _digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs that overlaps an item: id, n_items (benchmark rows that it overlaps), and of the item with the most equal words item, at, n_same and n_item."""
    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    found = overlaps(texts, benchmark, item_col, item_text)
    worst = F.min_by(F.struct("item", "at", "n_same", "n_item"), F.struct((-F.col("n_same")).alias("n"), "item")).alias("w")
    found = materialize(found.groupBy("digest").agg(F.sum("copies").alias("n_items"), worst), "contaminated")
    rows = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest")).join(small(found, found.count()), "digest")
    return rows.select(F.col("id").alias(id_col), "n_items", F.col("w.item").alias(item_col), "w.at", "w.n_same", "w.n_item")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text overlaps no benchmark item; ids play no part."""
    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    bad = materialize(overlaps(texts, benchmark, item_col, item_text).select(F.col("digest").alias("_digest")).distinct(), "contaminated")
    return docs.join(small(bad, bad.count()), _digest(text_col) == F.col("_digest"), "left_anti")
