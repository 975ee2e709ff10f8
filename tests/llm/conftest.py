"""Small corpora with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import pytest
from odd import prose

@pytest.fixture(scope="session")
def odd_rows():
    base = prose(1, 120)
    words = base.split()
    near = words.copy()
    near[50] = "changed"
    far = words[:70] + prose(2, 50).split()
    return [
        (0, base), (1, base), (2, base.upper()), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "ONE  two"),
        (10, "日本語 テスト é   x"), (11, prose(3, 6000)), (12, prose(3, 6000) + " tail"), (13, "&&& *** !!!"), (14, prose(4, 60)), (15, prose(5, 13)), (16, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, ("a", "b", None)[i % 3], "src%d" % (i % 4) if i % 5 else None, len(t or ""), i, "k") for i, t in odd_rows]
    # id, n, key, size, rest, start and runs are names that the operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string").selectExpr("*", "1 as n", "2 as size", "'r' as rest", "3 as start", "'s' as score", "0 as target", "'t' as _id")


@pytest.fixture
def empty(odd):
    return odd.where("false")
