from pyspark.sql import functions as F

from hirelake.operators import page_audit as A


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_headings(spark):
    levels = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    got = [one(spark, A.heading_issue(levels(*x))) for x in ((), (2,), (1, 1), (1, 3), (1, 2, 3, 2), (1,))]
    assert got == ["none_found", "no_h1", "many_h1", "skip", "none", "none"]


def test_robots(spark):
    cases = {
        "User-agent: *\nDisallow: /": True, "User-agent: a\nUser-agent: *\nDisallow: / # all": True, "User-agent: a\nDisallow: /\nUser-agent: *\nAllow: /": False,
        "User-agent: *\nDisallow: /x": False, "User-agent: *\nDisallow: /\nUser-agent: b\nAllow: /": True, "": False,
    }
    assert {t: one(spark, A.robots_block_all(F.lit(t))) for t in cases} == cases
    assert one(spark, A.robots_block_all(F.lit(None).cast("string"))) is False


def test_headers(spark):
    good = {"Content-Security-Policy": "default-src 'self'; frame-ancestors 'none'", "Strict-Transport-Security": "max-age=31536000", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "no-referrer"}
    as_map = lambda h: F.create_map(*[F.lit(x) for kv in h.items() for x in kv]) if h else F.create_map().cast("map<string,string>")
    assert one(spark, A.security_headers(as_map(good), F.lit(True))) == []
    assert len(one(spark, A.security_headers(as_map({}), F.lit(True)))) == 5
    assert one(spark, A.security_headers(as_map(good | {"Strict-Transport-Security": "max-age=5"}), F.lit(True))) == ["strict-transport-security"]


def test_sql_and_reach(spark):
    lines = spark.createDataFrame([("a", 1, "db.query("), ("a", 2, '"SELECT * FROM t WHERE id=" + key'), ("a", 3, ")"), ("b", 1, 'query("SELECT 1")')], "f string, n int, line string")
    assert [(r.f, r.n) for r in A.dynamic_sql(lines, "f", "n", "line").collect()] == [("a", 1)]
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (2, 1)], "src long, dst long")
    got = A.reach(links, spark.createDataFrame([(1,)], "page long")).collect()
    assert sorted((r.page, r.depth) for r in got) == [(1, 0), (2, 1), (3, 1), (4, 2)]
