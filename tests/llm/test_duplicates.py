import itertools
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from skyplate.llm import components, decontamination, queries, simhash, substring
from skyplate.llm.substring import FingerprintIndex, brute_force, dedup, digests


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi pi rho sigma tau".split()) + str(rnd.randrange(40)) for _ in range(n))


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


def near_copies(seed=1):
    rnd = random.Random(seed)
    docs, n = {}, 0
    for _ in range(30):
        base = words(rnd, 120).split()
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = "changed"
            docs[n] = " ".join(w)
            n += 1
    return docs


def test_fingerprints_by_definition():
    rnd = random.Random(9)
    for t in ["", "one", "A b C", "É É a b c", "a\x1cb c d e", words(rnd, 300), "x " * 9]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_some_window_holds_at_most_one_of_four_bits():
    for bits in itertools.combinations_with_replacement(range(5), 4):
        n = np.bincount(bits, minlength=5)
        assert any(n[i] + n[j] <= 1 for i, j in simhash.WINDOWS)


def test_every_point_lies_near_its_anchor():
    code = simhash.Anchors(25)
    rng = np.random.default_rng(2)
    p = rng.integers(0, 1 << 25, 5000, dtype=np.uint64)
    a = code.of(p)
    assert np.bitwise_count(p ^ a).max() <= 2
    assert (code.of(a) == a).all()


@pytest.mark.parametrize("most", [1 << 14, 40])
def test_components_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_ROWS", most)
    docs = near_copies()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == slow_components(fps)


def test_anchors_with_too_many_rows(spark, monkeypatch):
    """A dense cluster: every fingerprint near a centre, so that anchors overflow a small limit."""
    rnd = random.Random(4)
    fps = set()
    while len(fps) < 300:
        x = 0x0123456789ABCDEF
        for _ in range(rnd.randrange(0, 5)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp bigint")
    monkeypatch.setattr(simhash, "MOST_ROWS", 50)
    got = {r.fp: r["class"] for r in simhash.classes(nodes).collect()}
    order = sorted(fps)
    want = slow_components({i: f & (1 << 64) - 1 for i, f in enumerate(order)})
    assert got == {order[i]: order[c] for i, c in want.items()}


def test_hot_nodes_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 3)
    monkeypatch.setattr(components, "MOST_HOT", 8)
    rnd = random.Random(3)
    star = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in star:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    edges = spark.createDataFrame(star, "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: root(i) for a, b in star if a != b for i in (a, b)}


def test_repeated_ids_with_different_texts(spark):
    """Rows count by their own text, whatever ids they repeat; ids can be texts."""
    rnd = random.Random(21)
    a, b, c = (words(rnd, 60) for _ in range(3))
    rows = [("3", a), ("5", a), ("5", b), ("5", b), (None, a), (None, c), (None, c), ("3", c + " more")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "component_id").collect()), key=str)
    far = bin(slow_fingerprint(c) ^ slow_fingerprint(c + " more")).count("1") > 4
    assert far or ("3", "3") in got
    assert got.count(("5", "3")) == 1 and got.count(("5", "5")) == 2 and got.count((None, "3")) >= 1
    kept = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    want = [("3", a), ("5", b)] + ([("3", c + " more"), (None, c)] if far else [("3", c + " more")])
    assert kept == sorted(want, key=str)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_near_duplicate_edge_cases(spark, edge, empty):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(edge).collect()]
    by = dict((k, v) for k, v in got if k is not None)
    assert len(got) == 9
    assert by[1] == by[2] == by[4] == 1
    assert by[3] == 3
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (True, 0)]


# ---- benchmark leaks


def test_masks_hit_whatever_two_words_are_replaced():
    for sub in itertools.combinations(range(14), 2):
        assert any(all(i + p not in sub for p in m) for m in decontamination.MASKS for i in range(14 - m[-1]))


def test_masks_hit_in_the_shortest_run_that_counts():
    n = decontamination.OVERLAP
    for sub in itertools.combinations(range(n), decontamination.SUBSTITUTIONS):
        assert any(all(i + p not in sub for p in m) for m in decontamination.MASKS for i in range(n - m[-1]))


def test_runs_of_overlap_words_are_found_whatever_two_are_replaced(spark):
    rnd = random.Random(16)
    n = decontamination.OVERLAP
    items = {0: words(rnd, n), 1: words(rnd, 40)}
    docs = []
    for item, start in ((0, 0), (1, 11)):
        for sub in itertools.combinations(range(n), 2):
            piece = items[item].split()[start : start + n]
            for at in sub:
                piece[at] = "SUBSTITUTE"
            docs.append((len(docs), item, " ".join([words(rnd, 20), *piece, words(rnd, 20)])))
    d = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id bigint, text string")
    b = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()} == {(i, k) for i, k, _ in docs}


def test_short_items_are_found_with_words_replaced(spark):
    rnd = random.Random(21)
    items, docs, want = {}, [], set()
    for n in range(1, decontamination.OVERLAP + 1):
        items[n] = " ".join(f"item{n}word{k}" for k in range(n))
        allowed = 0 if n < 5 else 1 if n < 10 else 2
        for count in (0, 1, 2):
            for sub in itertools.combinations(range(n), count):
                piece = items[n].split()
                for at in sub:
                    piece[at] = "SUBSTITUTE"
                docs.append((len(docs), " ".join([words(rnd, 15), *piece, words(rnd, 15)])))
                want |= {(docs[-1][0], n)} if count <= allowed else set()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()} == want


def leaks(spark):
    rnd = random.Random(6)
    items = {k: words(rnd, 30) for k in range(12)} | {12: "short but telling item here", 13: "too short", 14: ""}
    docs = {}
    for k in range(12):
        body = words(rnd, 200).split()
        piece = items[k].split()
        for at in rnd.sample(range(30), 2):
            piece[at] = "SUBSTITUTE"
        docs[k] = " ".join([*body[:90], *(w.upper() + "," for w in piece), *body[90:]])
    docs |= {100 + k: words(rnd, 300) for k in range(40)}
    docs[200] = "and " + items[12].upper() + "!"
    docs[201] = " ".join(items[3].split()[5:20])
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    return d, spark.createDataFrame(list(items.items()), "item_id bigint, text string"), docs, items


def test_leaks_with_substitutions_are_found_and_others_left(spark):
    d, b, docs, items = leaks(spark)
    got = {(r.doc_id, r.item_id): (r.at, r.n_same, r.n_item) for r in decontamination.contaminated(d, b).collect()}
    want = {(k, k) for k in range(12)} | {(200, 12), (201, 3)}
    assert set(got) == want
    assert all(got[k, k] == (90, 28, 30) for k in range(12))
    assert {r.doc_id for r in decontamination.clean(d, b).collect()} == docs.keys() - {k for k, _ in want}


def test_decontamination_stays_in_the_jvm(spark, capsys):
    d, b, _, _ = leaks(spark)
    decontamination.contaminated(d, b).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_decontamination_edge_cases(spark, edge, empty):
    b = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b c d e f g h i j k", "x"), (3, "word " * 20, "x"), (3, "word " * 20, "x")], "item_id bigint, text string, h string")
    assert [(r.doc_id, r.item_id, r.n_items) for r in decontamination.contaminated(edge, b).collect()] == [(5, 3, 2)]
    assert decontamination.contaminated(empty, b).count() == 0
    assert decontamination.contaminated(edge, b.limit(0)).count() == 0
    assert decontamination.clean(edge, b).count() == 8
    assert decontamination.clean(edge, b).columns == edge.columns


def slow_overlaps(text, items):
    """Items that a text overlaps, by definition: every alignment compared word by word."""
    split = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    h, out = split(text), set()
    for k, t in items:
        want = split(t)
        n = len(want)
        run = min(13, n)
        least = run - (0 if n < 5 else 1 if n < 10 else 2)
        for shift in range(-n, len(h)):
            same = [want[i] == h[i + shift] for i in range(n) if 0 <= i + shift < len(h)]
            if n and any(sum(same[a : a + run]) >= least for a in range(len(same) - run + 1)):
                out.add(k)
    return out


def test_overlaps_by_brute_force(spark):
    """Few distinct words, so that many alignments come near the limits; ties, copies and ids that are null or repeated."""
    rnd = random.Random(31)
    draw = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    items = [(k, draw(rnd.randrange(1, 30))) for k in range(25)] + [(99, "a b c d e f g"), (None, "h g f e d c b a h g f e d")]
    items.append((50, items[3][1]))
    docs = [(rnd.randrange(20), draw(rnd.randrange(0, 60))) for _ in range(40)] + [(None, "x " + items[5][1] + " y"), (7, "nothing here"), (7, "q " + items[-2][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = [slow_overlaps(t, enumerate(t for _, t in items)) for _, t in docs]
    got = sorted(((r.doc_id, r.n_items) for r in decontamination.contaminated(d, b).collect()), key=str)
    assert got == sorted(((i, len(f)) for (i, _), f in zip(docs, found, strict=True) if f), key=str)
    kept = sorted(map(tuple, decontamination.clean(d, b).collect()), key=str)
    assert kept == sorted(((i, t) for (i, t), f in zip(docs, found, strict=True) if not f), key=str)


def test_leaks_against_sql(spark, big_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{big_dir}/{t}.parquet'")
    names = ["doc_id", "n_items", "item_id", "at", "n_same", "n_item"]
    want = sorted(map(tuple, con.sql(queries.LEAKS_SQL).df()[names].itertuples(index=False)))
    assert len(want) > 5
    assert sorted(tuple(r[n] for n in names) for r in queries.op7_decontamination(spark, big_dir).collect()) == want


# ---- repeated passages


def passages(seed=8, n=60):
    rnd = random.Random(seed)
    shared = [words(rnd, k) for k in (12, 13, 14, 40, 90)]
    docs = []
    for i in range(n):
        parts = [words(rnd, rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(shared), words(rnd, rnd.randrange(0, 30))]
        docs.append((i * 3, rnd.choice(["  ", "\n", " "]).join(parts)))
    docs += [(1001, docs[5][1]), (1002, docs[5][1].replace(" ", "\t")), (1003, "same " * 50), (1004, "same " * 60)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeated_words_by_brute_force(spark, batches):
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(dedup(df, batches=batches)).collect()}
    assert got == brute_force(docs)


@pytest.mark.parametrize("most_runs", [1, 3, 99])
def test_batches_and_compaction_change_nothing(spark, most_runs):
    """Each batch sees only the index; ids are texts."""
    docs = [(f"{i:05}", t) for i, t in passages(3)]
    df = spark.createDataFrame(docs, "id string, text string")
    index, got = FingerprintIndex(spark, "string", 4, most_runs), {}
    for low, high in (("", "00050"), ("00050", "00100"), ("00100", "00150"), ("00150", "99999")):
        texts, hits = index.add(df.where((F.col("id") >= low) & (F.col("id") < high)))
        got |= {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(substring.cut(texts, hits, "id", "string"), "id").collect()}
        assert index.live <= most_runs + 1
        assert index.windows().select("run").distinct().count() <= most_runs + 1
    assert got == brute_force(docs)
    folders = [substring.shared_folder(spark).removeprefix("file://") + "/" + n for n in index.tables.values()]
    assert all(os.path.exists(f) for f in folders)
    index.drop()
    assert not any(os.path.exists(f) for f in folders)


def test_a_later_batch_reads_no_old_text_that_it_does_not_share(spark):
    """Old documents are read again only where the new batch is the first to share a fingerprint with them; history is not shuffled."""
    rnd = random.Random(2)
    old = [(i, words(rnd, 60)) for i in range(20)]
    index = FingerprintIndex(spark, "bigint", 4)
    index.add(spark.createDataFrame(old, "id bigint, text string"))
    seen = []
    scan = substring.windows_in
    try:
        substring.windows_in = lambda texts, candidates, kind: (seen.append(sorted(r.doc for r in candidates.collect())), scan(texts, candidates, kind))[1]
        index.add(spark.createDataFrame([(100, words(rnd, 60)), (101, old[3][1])], "id bigint, text string"))
        index.add(spark.createDataFrame([(200, old[3][1] + " " + words(rnd, 20))], "id bigint, text string"))
    finally:
        substring.windows_in = scan
    assert seen == [[101], [3], [200], []]
    assert "Exchange" not in index.fingerprints().groupBy("fp").agg(F.min("doc"))._jdf.queryExecution().executedPlan().toString()


def test_equal_fingerprints_whatever_the_spaces():
    a, n = substring.window_fingerprints([b"a b c d e f g h i j k l m n", b"x"])
    b, _ = substring.window_fingerprints([b" a\tb\nc d  e f g h i j k l m n\n"])
    assert n.tolist() == [14, 1]
    assert a.tolist() == b.tolist()
    assert len(a) == 2


def test_texts_under_one_id_lose_their_own_words(spark):
    shared = [f"s{i}" for i in range(20)]
    early, late = " ".join([*shared, "x", "y"]), " ".join(["p", "q", "r", "t", "u", *shared])
    rows = spark.createDataFrame([(1, " ".join(shared)), (5, early), (5, late), (5, late), (9, late)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup(rows).collect())
    assert got == [(1, 20, 0, " ".join(shared)), (5, 22, 20, "x y"), (5, 25, 20, "p q r t u"), (5, 25, 20, "p q r t u"), (9, 25, 25, "")]


def test_substring_edge_cases(spark, edge, empty):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in dedup(edge).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 3, 0), (None, 3, 0), (4, 0, 0), (5, 30000, 0), (6, 1, 0), (7, 3, 0)}
    assert dedup(empty).count() == 0
    same = spark.createDataFrame([(1, "w " * 20), (1, "w " * 20), (2, "w " * 20)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in dedup(same).collect()) == [(1, 0), (1, 0), (2, 20)]


def test_tables(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substring_dedup(spark, sf_dir).collect()}
    assert got == brute_force(list(zip(docs.doc_id, docs.text, strict=True)))
    fps = {int(r.doc_id): slow_fingerprint(r.text) for r in docs.itertuples()}
    near = {r.doc_id: r.component_id for r in queries.op4_simhash(spark, sf_dir).collect()}
    assert near == slow_components(fps)
    bench = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {d.doc_id for b in bench.itertuples() for d in docs.itertuples() if plain(b.text) in plain(d.text)}
    leaked = {r.doc_id for r in queries.op7_decontamination(spark, sf_dir).collect()}
    assert want <= leaked
