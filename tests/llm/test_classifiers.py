import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyplate.llm import language_id, line_crf, quality_rules, queries, toxicity
from skyplate.llm.common import mixed, sampled_ids
from skyplate.llm.language_id import KneserNey, LanguageId, codes, hashes, letters
from skyplate.llm.line_crf import LineCrf
from skyplate.llm.quality_rules import QualityRules
from skyplate.llm.toxicity import Toxicity


def held(df, key="held_out"):
    return df[df[key]]


# ---- quality rules


def by_definition(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in repeated for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    return [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)]


@pytest.mark.parametrize("text", [None, "", "a b c a b c a", "x\nx\n\n\ny\nx", "# a|b é ü <tag>\x1cz", "a a a a", "one two"])
def test_statistics_by_definition(text):
    assert quality_rules.statistics([(text or "").encode()])[0, :5].tolist() == by_definition(text)


def test_statistics_of_random_texts():
    rnd = random.Random(2)
    docs = ["".join(rnd.choice(["a ", "b ", "c\n", "é ", "#", "  ", "\t"]) for _ in range(rnd.randrange(80))) for _ in range(200)]
    assert quality_rules.statistics([d.encode() for d in docs])[:, :5].tolist() == [by_definition(d) for d in docs]


def test_rules_reject_what_labels_call_bad(spark, big_dir):
    got = queries.op2_quality_rules(spark, big_dir).toPandas().merge(pd.read_parquet(f"{big_dir}/labels.parquet"), on="doc_id")
    assert len(got)
    rest = got[~got.base_failed]
    assert rest[rest.quality == 0].kept.mean() < 0.1
    assert rest[rest.quality == 1].kept.mean() > 0.98
    assert not got[got.base_failed].kept.any()


def slow_path(part, tree_rows, forest, at):
    """Path length of one row in one tree, walked node by node."""
    node, depth = at, 0
    while forest.feature[node] >= 0:
        node = forest.left[node] if part[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        depth += 1
    inside = [r for r in tree_rows if leaf(forest, at, r) == node]
    return depth + float(quality_rules.path_norm(len(inside)))


def leaf(forest, node, row):
    while forest.feature[node] >= 0:
        node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
    return node


def test_path_lengths_by_brute_force():
    """With as many rows as a tree draws, every tree holds all of them, so that its leaves can be counted again."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(64, 3))
    x[:20, 1] = 0.0
    forest = quality_rules.IsolationForest(trees=7, rows=64).fit(x)
    expected = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
    want = [2 ** (-np.mean([slow_path(r, x, forest, root) for root in forest.roots]) / expected) for r in x]
    assert forest.score(x) == pytest.approx(np.array(want))
    assert forest.score(np.array([[9.0, 9.0, 9.0]]))[0] > np.median(want)


def test_labels_do_not_change_the_forests(spark, big_dir):
    docs = spark.read.parquet(f"{big_dir}/documents.parquet")
    labels = spark.read.parquet(f"{big_dir}/labels.parquet")
    grown = []
    for own in (labels, labels.withColumn("quality", F.lit(1) - F.col("quality"))):
        model = QualityRules()
        grow = model.grow
        model.grow = lambda x, grow=grow: grown.append(grow(x)) or grown[-1]
        model.fit(docs, own)
    for a, b in zip(*grown, strict=True):
        assert a.threshold.tolist() == b.threshold.tolist() and a.feature.tolist() == b.feature.tolist()


def test_samples_keep_their_bound(spark):
    rows = [(i, i % 10 and 1, None) for i in range(5000)] + [(i, 0, None) for i in range(100)] + [(None, 1, None)] * 50
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    got = sampled_ids(labels, "doc_id", "quality", 300, 7).toPandas()
    assert got.doc_id.is_unique and got.doc_id.notna().all()
    assert 220 < (got.quality == 1).sum() < 380 and 220 < (got.quality == 0).sum() < 380
    assert sampled_ids(labels, "doc_id", "quality", 10_000, 7).count() == 5000


def test_rules_on_edge_cases(spark, edge, empty, labels):
    model = QualityRules().fit(edge, labels)
    got = model.apply(edge).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in got) == [(False, 1, 0), (False, 2, 0), (False, 3, 3), (False, 3, 3), (False, 4, 0), (False, 5, 30000), (False, 6, 1), (False, 7, 3), (True, 0, 3)]
    assert QualityRules().fit(empty, labels.limit(0)).apply(empty).count() == 0


def marked_tables(spark, n, labelled):
    """Texts of 60 words; every tenth is bad and has 25 symbols or more. A good one has less than 15; but, among the
    half of the rows with the larger hash, one in fifty has 30."""
    rnd = random.Random(11)
    order = spark.range(n).select("id", mixed(F.col("id"), QualityRules().seed).alias("h")).toPandas().set_index("id").h.rank()
    rows = []
    for i in range(n):
        bad = i % 10 == 0
        symbols = rnd.randrange(25, 60) if bad else 30 if order[i] > n / 2 and rnd.random() < 0.02 else rnd.randrange(15)
        rows.append((i, " ".join(["#" * symbols + "ab"] + [rnd.choice(["river", "stone", "cloud"]) + str(rnd.randrange(1000)) for _ in range(59)]), int(not bad)))
    df = pd.DataFrame(rows, columns=["doc_id", "text", "quality"])
    return spark.createDataFrame(df[["doc_id", "text"]]).repartition(8), spark.createDataFrame(df[["doc_id", "quality"]][:labelled]), df


def test_thresholds_come_from_all_labelled_rows(spark):
    docs, labels, df = marked_tables(spark, 20_000, 20_000)
    model = QualityRules().fit(docs, labels)
    kept = model.apply(docs).toPandas().set_index("doc_id").kept.sort_index()
    assert (~kept[df.quality == 1]).mean() <= 0.002
    columns, forest, cut = model.rules[0]
    score = np.rint(forest.score(quality_rules.ratios(quality_rules.statistics([t.encode() for t in df.text]))[:, columns]) * 2**16) / 2**16
    good = (df.quality == 1).to_numpy()
    cuts = np.unique(score[score >= np.quantile(score[good], 0.998, method="higher")])
    margin = (cuts + np.concatenate([cuts[1:], [1.0]])) / 2
    gain = np.array([(score[~good] > t).mean() - (score[good] > t).mean() for t in margin])
    best = np.flatnonzero(gain >= gain.max() - 1e-3)
    assert cut == pytest.approx(margin[best[len(best) // 2]])


def test_forests_draw_from_rows_without_labels(spark):
    docs, labels, _ = marked_tables(spark, 400, 40)
    model, drawn = QualityRules(), []
    model.grow = lambda x, grow=model.grow: drawn.append(len(x)) or grow(x)
    model.fit(docs, labels)
    assert drawn == [400]


# ---- line field


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4, 2])
    score, move = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    got, pairs = line_crf.forward_backward(score, move, counts)
    at, total = 0, np.zeros((2, 2))
    for n in counts:
        s = score[at : at + n]
        weights = {y: np.exp(sum(s[i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for i in range(n - 1):
                total[y[i], y[i + 1]] += w / z
        at += n
    assert pairs == pytest.approx(total)


def test_neighbours_do_not_cross_texts():
    x, chars, counts = line_crf.line_table([b"AAA\nbb", b"", b"CC"])
    assert counts.tolist() == [2, 1, 1]
    assert chars.tolist() == [3, 2, 0, 2]
    width = len(line_crf.OWN)
    assert (x[0, width : 2 * width] == 0).all()
    assert (x[1, width : 2 * width] == x[0, :width]).all()
    assert (x[1, 2 * width : 3 * width] == 0).all()


def test_field_on_held_out_rows(spark, big_dir):
    got = queries.op3_quality_crf(spark, big_dir).toPandas().merge(pd.read_parquet(f"{big_dir}/labels.parquet"), on="doc_id")
    h = held(got)
    assert len(h) > 30
    assert (h.predicted == h.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_field_on_edge_cases(spark, edge, empty, labels):
    model = LineCrf(rounds=5).fit(edge, labels)
    assert model.apply(edge).where("score between 0 and 1").count() == 9
    assert model.keep(edge).columns == edge.columns
    assert LineCrf().fit(empty, labels.limit(0)).apply(empty).count() == 0
    assert LineCrf().fit(edge, labels.limit(0)).apply(edge).count() == 9


# ---- language


def slow_kneser_ney(corpora, order, word, language, discount=0.75):
    """Log probability of a word by the definition, over strings. corpora: language -> words."""
    edge = "^"
    grams = {}
    for x, words in corpora.items():
        for w in words:
            t = edge * (order - 1) + w + edge
            for i in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    key = (x, t[i - k + 1 : i + 1])
                    grams[key] = grams.get(key, 0) + 1
    letters_ = {g for (_, g) in grams if len(g) == 1}
    floor = 1 / (len(letters_) + 1 + 256)

    def count(g):
        if len(g) == order:
            return grams.get((language, g), 0)
        return max(len({h for (x, h) in grams if x == language and len(h) == len(g) + 1 and h[1:] == g}), 1) if (language, g) in grams else 0

    def prob(context, c):
        lower = prob(context[1:], c) if context else floor
        after = [h for (x, h) in grams if x == language and len(h) == len(context) + 1 and h[:-1] == context]
        total = sum(count(h) for h in after)
        if not total:
            return lower
        return max(count(context + c) - discount, 0) / total + discount * len(after) / total * lower

    t = edge * (order - 1) + word + edge
    return sum(np.log(prob(t[i - order + 1 : i], t[i])) for i in range(order - 1, len(t)))


def test_scores_by_definition():
    is_letter, order = letters(), 3
    corpora = {"x": ["abba", "abc", "cab", "bca", "abc"], "y": ["bbb", "bab", "dab", "cd"]}
    parts = [language_id.gram_counts(Counter(w), is_letter, order) for w in corpora.values()]
    table = [tuple(np.concatenate(c) for c in zip(*((np.full(len(p[k][0]), i), *p[k]) for i, p in enumerate(parts)), strict=True)) for k in range(order)]
    model = KneserNey(list(corpora), order).fit(table)
    words = ["abba", "ab", "dcba", "zz", "bbbb", "c", "azb"]
    got, _ = model.word_scores(words, is_letter)
    want = [[slow_kneser_ney(corpora, order, w, x) for x in corpora] for w in words]
    assert got == pytest.approx(np.array(want), abs=1e-4)


def test_frequent_grams_stay_within_their_bound(spark):
    rows = [("x", k, g, 0, 0, 1 + g % 40) for k in (0, 1) for g in range(1000)] + [("y", 0, g, 0, 0, 1) for g in range(50)]
    grams = spark.createDataFrame(rows, "lang string, k int, gram bigint, context bigint, suffix bigint, n bigint")
    got = LanguageId(most_grams=300)._frequent(grams).toPandas()
    assert (got.lang == "y").sum() == 50
    for k in (0, 1):
        part = got[(got.lang == "x") & (got.k == k)]
        assert 200 < len(part) <= 380
        assert (part.n >= 32).sum() == sum(1 + g % 40 >= 32 for g in range(1000))


def invented_docs(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(160):
        few = "abcdefgh" if i % 2 else "efghijkl"
        rows.append((i, " ".join("".join(rnd.choice(few) for _ in range(rnd.randrange(1, 9))) for _ in range(60)) + " zéß 日本", "x" if i % 2 else "y"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_no_gram_is_left_out_of_a_large_model(spark):
    """The scores are those of one table of all n-grams of the rows that do not calibrate."""
    docs = invented_docs(spark)
    usable = F.col("doc_id") < 120
    whole = LanguageId(held=10).fit(docs, usable)
    small = LanguageId(held=10, most_grams=400).fit(docs, usable)
    assert isinstance(whole.model, KneserNey)
    want, got = (m.apply(docs).toPandas().sort_values("doc_id") for m in (whole, small))
    assert got.lang_pred.tolist() == want.lang_pred.tolist()
    for column in ("cross_entropy", "score"):
        assert got[column].to_numpy() == pytest.approx(want[column].to_numpy(), rel=1e-9)
    assert small.limit == pytest.approx(whole.limit) and small.sharpness == whole.sharpness
    assert len(small.model.parts) > 2


def test_parts_stay_within_their_bound(spark):
    rnd = random.Random(9)
    rows = [(x, k, b, g) for x in (0, 1) for k in (1, 2) for b in range(20) for g in range(rnd.randrange(1, 90))] + [(0, 2, 30, g) for g in range(150)]
    grams = spark.createDataFrame([(x, 0, -1, 0) for x in (0, 1)] + rows, "lang int, k int, bucket int, gram int")
    parts = LanguageId(most_grams=100)._deal(grams)
    assert sorted(b for members in parts for b in members) == [*range(20), 30]
    sizes = Counter((x, k, i) for x, k, b, _ in rows for i, members in enumerate(parts) if b in members)
    assert max(n for (x, k, i), n in sizes.items() if 30 not in parts[i] or (x, k) != (0, 2)) <= 100
    assert [n for (x, k, i), n in sizes.items() if 30 in parts[i] and (x, k) == (0, 2)] == [150]


def test_unseen_words_get_finite_scores():
    is_letter = letters()
    table = [(np.zeros(len(g), dtype=np.int64), g, c, s, n) for g, c, s, n in language_id.gram_counts(Counter("the then them".split()), is_letter, 4)]
    model = KneserNey(["en"], 4).fit(table)
    scores, n = model.word_scores(["the", "zzz", "123", "日本"], is_letter)
    assert np.isfinite(scores).all()
    assert n.tolist() == [4, 4, 0, 3]
    assert scores[0, 0] / 4 > scores[1, 0] / 4
    assert scores[2, 0] == 0


def test_language_on_held_out_rows(spark, big_dir):
    got = queries.op6_language_id(spark, big_dir).toPandas().merge(pd.read_parquet(f"{big_dir}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    h = held(got)
    assert len(h) > 100
    assert (h.lang_pred == h.lang).mean() > 0.96
    assert got.score.between(0, 1).all()


def test_language_on_edge_cases(spark, edge, empty):
    from pyspark.sql import functions as F

    model = LanguageId(held=2).fit(edge, F.lit(True))
    got = model.apply(edge).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 4)} == {1: "und", 2: "und", 4: "und"}
    assert {r.lang_pred for r in got} == {"und", "x"}
    none = LanguageId().fit(empty, F.lit(True))
    assert none.apply(empty).count() == 0
    assert {r.lang_pred for r in none.apply(edge).collect()} == {"und"}


# ---- toxicity


def toxic_table(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rnd.choice(["river", "stone", "cloud", "field", "road"]) for _ in range(20)]
        if toxic:
            words[rnd.randrange(20)] = rnd.choice(["scum", "idiot"])
        # a spurious link: toxic rows mostly name one group
        if rnd.random() < (0.9 if toxic else 0.1):
            words.append("muslims")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_the_penalty_closes_the_gap_between_groups(spark):
    docs, labels = toxic_table(spark)

    def gap(penalty):
        m = Toxicity(penalty=penalty).fit(docs, labels)
        number = {f: i for i, f in enumerate(m.names)}
        s = m.scores(["the river and muslims", "the river and christians", "you scum"], {}, number)
        return abs(s[0] - s[1]), s[2]

    free, _ = gap(0.0)
    bound, toxic = gap(50.0)
    assert bound < 0.3 * free
    assert toxic > 0.5


def test_toxicity_on_held_out_rows(spark, big_dir):
    got = queries.op8_toxicity(spark, big_dir).toPandas().merge(pd.read_parquet(f"{big_dir}/labels.parquet"), on="doc_id")
    h = held(got)
    assert len(h) > 50
    assert (h.predicted == h.toxic).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_toxicity_on_edge_cases(spark, edge, empty, labels):
    model = Toxicity().fit(edge, labels)
    assert model.apply(edge).where("score between 0 and 1").count() == 9
    assert Toxicity().fit(empty, labels.limit(0)).apply(empty).count() == 0
    assert Toxicity().fit(edge, labels.limit(0)).apply(edge).where("score = 0").count() == 9
    assert toxicity.features("abcdef") == ("abcdef", "abc*", "abcd*", "abcde*")
