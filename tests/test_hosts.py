from pyspark.sql import functions as F

from hirelake.functions.hosts import ipv4_number
from hirelake.operators.facets import public_url
from hirelake.plans.placed import placed


def test_addresses(spark):
    forms = {"127.0.0.1": 2130706433, "0x7f.0.0.1": 2130706433, "0177.1": 2130706433, "2130706433": 2130706433, "1.2.3": 16908291, "1.2.3.4.": 16909060, "256.1.1.1": None, "1.2.3.4.5": None, "1.256": 16777472, "a.b": None, "08.1": None, "0x": 0, "": None, "1..2": None, "4294967296": None}
    got = {r.h: r.n for r in spark.createDataFrame([(h,) for h in forms], "h string").select("h", ipv4_number(F.col("h")).alias("n")).collect()}
    assert got == forms


def test_public_urls(spark):
    good = ["http://example.com/x", "HTTPS://Example.com:8443", "http://8.8.8.8", "http://100.128.0.1/", "http://localhost.example.com"]
    bad = ["http://100.64.0.1/", "http://224.0.0.1/", "http://192.0.2.1/", "http://0x7f.0.0.1/", "http://127.1", "http://[::1]/", "http://localhost", "http://a.local.", "http://intranet", "ftp://example.com", "http://u@example.com", "", None, "http://0/", "http://198.19.1.1", "http://250.1.1.1"]
    rows = spark.createDataFrame([(u, u in good) for u in good + bad], "u string, want boolean")
    assert [r.u for r in rows.withColumn("got", public_url(F.col("u"))).filter("got is distinct from want").collect()] == []


def test_places(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 101).repartition(7)
    got = placed(df, F.desc("k"), "id").collect()
    want = sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 1001))
    assert placed(df.limit(0), "id").count() == 0
