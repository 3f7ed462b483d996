from pyspark.sql import functions as F

from hirelake.functions import text as X
from hirelake.operators.lifecycle import classify, last_wins
from hirelake.sources.tables import epoch_millis_iso


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def plain_hash(s):
    h = 0
    for ch in s:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h


def test_ids(spark):
    for s in ("acme:1", "", "работа", "zzzzzzzz"):
        h = plain_hash(s)
        assert one(spark, s, X.site_job_id) == abs(h - (1 << 32) if h >= 1 << 31 else h)
        assert one(spark, s, X.stable_job_id) == ((h & 0x7FFFFFFF) or 1)


def test_texts(spark):
    assert one(spark, "  A–B \n c ", X.normalize_text) == "a-b c"
    assert one(spark, None, X.normalize_text) == ""
    assert one(spark, "HTTP://Ex.com/A/?q#f", X.canonical_url) == "http://ex.com/A"
    assert one(spark, "c++ and go, C++", X.token_set) == ["c++", "and"]
    assert one(spark, "", X.initials) == "IT"
    assert one(spark, "blue sky inc", X.initials) == "BS"


def test_bands(spark):
    got = spark.createDataFrame([(x,) for x in (0, 40, 55, 70, 80)], "x int").select(X.score_band(F.col("x")).alias("b"))
    assert [r.b for r in got.collect()] == ["poor", "weak", "fair", "strong", "excellent"]


def test_epoch(spark):
    assert spark.range(1).select(epoch_millis_iso(F.lit(0).cast("long"))).first()[0] == "1970-01-01T00:00:00Z"


def test_classify(spark):
    state = spark.createDataFrame(
        [(1, "a", True, False), (2, "a", False, False), (3, "a", True, True), (4, "a", True, False), (5, "a", True, False), (6, "a", False, False)],
        "id long, fingerprint string, active boolean, stale boolean",
    )
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b"), (7, "a")], "id long, fingerprint string")
    got = {r.id: r.event for r in classify(state, seen).collect()}
    assert got == {1: "unchanged", 2: "reopened", 3: "restored", 4: "updated", 5: "missing", 6: "absent", 7: "new"}


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, o int")
    assert sorted(map(tuple, last_wins(df, "k", "o").collect())) == [("a", 3), ("b", 2)]
