import pytest

EDGE = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id here"), (4, " \n\t "), (5, "word " * 30_000), (6, "é" * 40_000), (7, "a\x00b \x1c c d")]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, very long and repeated rows, beside columns that clash with the operators' own."""
    clash = "kept string, score string, predicted string, fp string, node string, component_id string, h string, spans string, doc string, hashes string, body string, item string, item_id string, words string, label string, seed string, id string, run string, lang string, ids string"
    names = [c.split()[0] for c in clash.split(", ")]
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in EDGE], f"doc_id bigint, text string, {clash}")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (5, 1, 1), (6, 0, 0), (6, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def big_dir():
    return "/root/testdata/sf0.01"
