"""Landed pages by five stop rules, in batch and as a stream; sources that fail alone."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hirelake.plans import isolation as I
from hirelake.sources import landed as L

SPECS = [
    {"key": "pages", "items": "jobs", "stop": "pages", "at": "meta.pages"}, {"key": "rows", "items": "", "stop": "short", "size": 2},
    {"key": "total", "items": "found.items", "stop": "rows", "at": "found.total"}, {"key": "next", "items": "data", "stop": "next", "at": "links.next"},
    {"key": "empty", "items": "jobs", "stop": "empty"}, {"key": "broken", "items": "jobs", "stop": "empty"}, {"key": "hole", "items": "jobs", "stop": "empty"},
    {"key": "cut", "items": "jobs", "stop": "next", "at": "next"}, {"key": "absent", "items": "jobs", "stop": "empty"},
]
PAGES = {
    "pages": [{"jobs": [{"id": 1}, {"id": 2}], "meta": {"pages": 2}}, {"jobs": [{"id": 3}], "meta": {"pages": 2}}, {"jobs": [{"id": 9}], "meta": {}}],
    "rows": [[1, 2], [3]], "total": [{"found": {"items": [{"t": "й"}], "total": "3"}}, {"found": {"items": [5, 6], "total": 3}}],
    "next": [{"data": ["a"], "links": {"next": "u"}}, {"data": ["b"], "links": {}}], "empty": [{"jobs": [7]}, {"jobs": []}],
    "broken": [{"jobs": [1]}, "{not json"], "hole": [{"jobs": [1]}, None, {"jobs": []}], "cut": [{"jobs": [1], "next": "u"}],
}


def land(root, key, run, pages, files=1):
    folder = root / f"source_key={key}" / f"run={run}"
    folder.mkdir(parents=True)
    rows = [(n, p if isinstance(p, str) else json.dumps(p)) for n, p in enumerate(pages, 1) if p is not None]
    for k in range(files):
        (folder / f"{k}.json").write_text("".join(json.dumps({"page": n, "body": b}) + "\n" for n, b in rows[k::files]))


ROW = lambda r: (r.source_key, r.run, r.page, r.place, r.item and json.loads(r.item), r.error)


def test_batch_and_stream(spark, tmp_path):
    root, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    for key, pages in PAGES.items():
        land(root, key, 1, pages, files=2)
    df = L.read(spark, str(root), SPECS)
    got = {}
    for r in df.collect():
        got.setdefault(r.source_key, []).append((r.page, r.place, r.item and json.loads(r.item), r.error))
    assert sorted(got["pages"]) == [(1, 0, {"id": 1}, None), (1, 1, {"id": 2}, None), (2, 0, {"id": 3}, None)]
    assert sorted(x[2] for x in got["rows"]) == [1, 2, 3] and sorted(x[2] for x in got["next"]) == ["a", "b"]
    assert [x[2] for x in sorted(got["total"], key=lambda x: x[:2])] == [{"t": "й"}, 5, 6] and got["empty"] == [(1, 0, 7, None)]
    errors = {k: got[k] for k in ("broken", "hole", "cut")}
    assert all(len(v) == 1 and v[0][:3] == (None, None, None) for v in errors.values())
    assert errors["broken"][0][3].startswith("page 2") and errors["hole"][0][3] == "page 2 is missing" and "goes on" in errors["cut"][0][3] and "absent" not in got

    def stream():
        query = L.read_stream(spark, str(root), SPECS).writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(repr, map(ROW, spark.read.parquet(sink).collect())))

    assert stream() == sorted(map(repr, map(ROW, df.collect())))
    land(root, "broken", 2, [{"jobs": [4]}, {"jobs": []}])
    land(root, "absent", 1, [{"jobs": []}])
    assert stream() == stream() == sorted(map(repr, map(ROW, L.read(spark, str(root), SPECS).collect())))
    assert spark.read.parquet(sink).filter("source_key = 'broken' and error is null").count() == 1


def test_filters_and_chosen_sources(spark, tmp_path):
    for key in ("rows", "empty"):
        land(tmp_path, key, 1, PAGES[key])
    df = L.read(spark, str(tmp_path), SPECS)
    assert df.filter("source_key = 'rows'").count() == 3 and df.count() == 4 and df.filter("source_key = 'empty'").count() == 1
    assert df.filter("source_key in ('rows', 'x') and page = 2").count() == 1
    some = L.read(spark, str(tmp_path), SPECS, ["rows", "none"])
    assert some.count() == 3 and some.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        L.LandedReader({"path": str(tmp_path), "specs": '[{"key": "x", "stop": "never"}]'})


def test_sources_fail_alone(spark, tmp_path):
    store, schema = str(tmp_path), "source_key string, external_id string, title string"
    rows = lambda key, *ids: lambda before: spark.createDataFrame([(key, i, "t") for i in ids], schema)
    first = I.sync(spark, store, schema, {k: rows(k, "1", "2") for k in "abc"}, dt.datetime(2026, 8, 1))
    assert {r.status for r in first.collect()} == {"ok"} and I.state(spark, store, schema).count() == 6

    def broken_plan(before):
        return before.select("source_key", "external_id", F.raise_error(F.lit("simulated failure")).cast("string").alias("title"))

    def raises(before):
        raise RuntimeError("no answer")

    grown = lambda before: before.union(rows("a", "3")(before))
    got = {r.source_key: r for r in I.sync(spark, store, schema, {"a": grown, "b": broken_plan, "c": raises}, dt.datetime(2026, 8, 2)).collect()}
    assert (got["a"].status, got["a"].n) == ("ok", 3) and got["b"].status == got["c"].status == "error"
    assert "simulated failure" in got["b"].error and got["c"].error == "RuntimeError: no answer" and got["b"].folder is None
    held = sorted((r.source_key, r.external_id) for r in I.state(spark, store, schema).collect())
    assert held == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "2")]
    few = I.sync(spark, store, schema, {"c": rows("c", "9")}, dt.datetime(2026, 8, 3), least={"c": 2}).first()
    assert few.status == "error" and I.state(spark, store, schema, ["c"]).count() == 2
    assert I.runs(spark, store).count() == 7 and I.state(spark, store + "/none", schema).count() == 0
