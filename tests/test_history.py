"""Replay against repeated merges, keyed and expiring state against batch plans, and chains against a plain walk."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hirelake.plans import chains as C
from hirelake.plans import merge as M
from hirelake.plans import replay as R
from hirelake.streaming import keyed

DAY = lambda n: dt.datetime(2026, 8, n)
SEEN = "source_key string, external_id string, run_at timestamp, fingerprint string"
RUNS = "source_key string, run_at timestamp, authoritative boolean"


def history(seed, n=7):
    rng = random.Random(seed)
    runs = [(s, DAY(k), None if rng.random() < 0.6 else rng.random() < 0.5) for s in ("a", "b") for k in range(1, n + 1) if rng.random() < 0.9]
    seen = [(s, str(i), at, rng.choice("xy")) for s, at, _ in runs for i in range(9) if rng.random() < 0.5]
    return seen, runs


def merged(spark, seen, runs, close_after):
    """Events and state by one merge a run, as a reader of merge() would fold them."""
    batch = lambda rows: spark.createDataFrame(rows, "source_key string, external_id string, fingerprint string")
    events, states = [], []
    for source in sorted({r[0] for r in runs}):
        state = M.empty_state(batch([]))
        for s, at, counts in sorted(r for r in runs if r[0] == source):
            now = F.lit(at).cast("timestamp")
            got = M.merge(state, batch([(x[0], x[1], x[3]) for x in seen if x[0] == s and x[2] == at]), now, close_after, F.lit(counts is not False))
            got = spark.createDataFrame(got.collect(), got.schema)
            events += [(s, r.external_id, r.event, at) for r in got.filter("event is not null").collect()]
            state = got.drop("event")
        states += [(r.source_key, r.external_id, r.fingerprint, r.first_seen, r.last_seen, r.active, r.missing_runs) for r in state.collect()]
    return sorted(events), sorted(states)


@pytest.fixture(scope="module")
def told(spark):
    seen, runs = history(4)
    return seen, runs, *merged(spark, seen, runs, 2)


def test_replay_equals_merges(spark, told):
    seen, runs, events, states = told
    assert {e[2] for e in events} == {"new", "updated", "closed", "reopened"}
    s, r = spark.createDataFrame(seen + seen[:3], SEEN), spark.createDataFrame(runs, RUNS)
    assert sorted(map(tuple, R.replay(s, r).collect())) == events
    assert sorted(map(tuple, R.final_state(s, r).collect())) == states


def test_replay_example(spark):
    s = spark.createDataFrame([("s", "1", DAY(1), "a"), ("s", "1", DAY(2), "b"), ("s", "1", DAY(5), "b"), ("s", "1", DAY(9), "z")], SEEN)
    r = spark.createDataFrame([("s", DAY(k), None) for k in range(1, 6)], RUNS)
    got = R.replay(s, r).orderBy("happened_at").collect()
    assert [(x.event, x.happened_at.day) for x in got] == [("new", 1), ("updated", 2), ("closed", 4), ("reopened", 5)]
    once = [x.event for x in R.replay(s, r, close_after=1).orderBy("happened_at").collect()]
    assert once == ["new", "updated", "closed", "reopened"] and R.replay(s.limit(0), r).count() == 0


def test_keyed_state_equals_merges_over_restarts(spark, told, tmp_path):
    seen, runs, events, _ = told
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "source_key string, external_id string, fingerprint string, run_at timestamp, authoritative boolean"
    days = sorted({r[1] for r in runs})
    for some in (days[:2], days[2:3], days[3:], days[-1:]):  # the last files come twice
        rows = [(s, i, f, at, None) for s, i, at, f in seen if at in some] + [(s, None, None, at, c) for s, at, c in runs if at in some]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = keyed.lifecycle_stream(spark.readStream.schema(schema).parquet(source), shards=3)
        write = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark)
        write.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == events


def plain_hits(rows, seconds):
    out, filled = [], {}
    for key, event, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        hit = key in filled and ts < filled[key] + dt.timedelta(seconds=seconds)
        filled[key] = filled[key] if hit else ts
        out.append((key, event, ts, hit, filled[key]))
    return sorted(out)


LOOKUPS = "key string, event_id long, ts timestamp"


def test_expiring_entries(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), n, DAY(1) + dt.timedelta(seconds=rng.randrange(4000))) for n in range(300)]
    assert sorted(map(tuple, keyed.fresh(spark.createDataFrame(rows, LOOKUPS), 300).collect())) == plain_hits(rows, 300)
    assert keyed.fresh(spark.createDataFrame([], LOOKUPS), 300).count() == 0

    # In order of time, over three runs of the query, with a repeated key long after its entry expired.
    rows = sorted(rows, key=lambda r: (r[2], r[1])) + [("a", 900, DAY(2)), ("a", 901, DAY(2)), ("z", 902, DAY(3))]
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (rows[:120], rows[120:300], rows[300:]):
        spark.createDataFrame(part, LOOKUPS).coalesce(1).write.mode("append").parquet(source)
        stream = keyed.fresh_stream(spark.readStream.schema(LOOKUPS).parquet(source), 300)
        write = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark)
        write.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert got == plain_hits(rows, 300)
    late = spark.createDataFrame([("z", 903, DAY(1)), ("z", 904, DAY(3))], LOOKUPS)
    late.coalesce(1).write.mode("append").parquet(source)
    stream = keyed.fresh_stream(spark.readStream.schema(LOOKUPS).parquet(source), 300)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    more = [tuple(r) for r in spark.read.parquet(sink).filter("event_id > 902").collect()]
    assert more == [("z", 904, DAY(3), True, DAY(3))]  # 903 was behind the watermark


def test_chains(spark):
    pages = [("long", k, k + 1 if k < 37 else None) for k in range(38)] + [("ring", k, (k + 1) % 5) for k in range(5)]
    pages += [("rho", 0, 1), ("rho", 1, 2), ("rho", 2, 3), ("rho", 3, 1), ("gap", 0, 1), ("gap", 1, 99), ("self", 7, 7), ("one", 1, None), ("off", 3, None)]
    pages += [("one", None, 4), ("long", 0, 1), ("rho", 50, 0)]
    starts = [("long", 0), ("ring", 3), ("rho", 0), ("gap", 0), ("self", 7), ("one", 1), ("off", 2)]
    p = spark.createDataFrame(pages, "source_key string, page long, next long")
    s = spark.createDataFrame(starts, "source_key string, page long")
    at = {(r.source_key, r.page): r.place for r in C.places(p, s).collect()}
    want = {("long", k): k for k in range(38)} | {("ring", (3 + k) % 5): k for k in range(5)} | {("rho", k): k for k in range(4)}
    assert at == want | {("gap", 0): 0, ("gap", 1): 1, ("self", 7): 0, ("one", 1): 0}
    got = {r.source_key: tuple(r)[1:] for r in C.chains(p, s).collect()}
    assert got == {
        "long": (38, 37, None, "complete"), "ring": (5, 2, 3, "cycle"), "rho": (4, 3, 1, "cycle"), "gap": (2, 1, 99, "gap"),
        "self": (1, 7, 7, "cycle"), "one": (1, 1, None, "complete"), "off": (0, None, None, "missing"),
    }
    assert C.chains(p.limit(0), s.limit(0)).count() == 0
