import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelake.plans import merge as M
from hirelake.plans import notify as N


def at(day):
    return F.lit(dt.datetime(2026, 8, day)).cast("timestamp")


def batch(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], "source_key string, external_id string, title string, url string, fingerprint string")


A, B = ("1", "t", "http://x/1", "a"), ("1", "t2", "http://x/1", "b")


def held(df, spark):
    """Rows and schema again, as a state read back from storage."""
    return spark.createDataFrame(df.collect(), df.schema)


def play(spark, snapshots, close_after=2, authoritative=None):
    state, log = M.empty_state(batch(spark, A)), []
    for day, rows in enumerate(snapshots, 1):
        seen = batch(spark, *rows) if rows else batch(spark, A).limit(0)
        merged = held(M.merge(state, seen, at(day), close_after, authoritative), spark)
        log += [r.event for r in merged.filter("event is not null").collect()]
        state = merged.drop("event")
    return state, log


def test_sequence(spark):
    state, log = play(spark, [[A], [B], [], [], [B]])
    assert log == ["new", "updated", "closed", "reopened"]
    r = state.first()
    assert r.active and r.missing_runs == 0 and r.title == "t2" and r.first_seen.day == 1 and r.last_seen.day == 5 and r.closed_at is None


@pytest.mark.parametrize("authoritative, runs", [(None, 1), (F.lit, 0)])
def test_missing(spark, authoritative, runs):
    state, log = play(spark, [[A], []], 2, authoritative and authoritative(False))
    assert log == ["new"] and state.first().active and state.first().missing_runs == runs


def test_stale_prune_links(spark):
    state, _ = play(spark, [[A]])
    stale = held(M.mark_stale(state, at(10)), spark)
    assert stale.first().event == "stale" and stale.first().stale
    again = M.merge(stale.drop("event"), batch(spark, A), at(11)).first()
    assert again.event == "restored" and not again.stale
    assert M.prune(state, at(2), F.col("title") != "t").first().event == "filtered"
    assert M.recheck(state, at(9)).count() == 1 and M.recheck(state, at(5)).count() == 0
    down = spark.createDataFrame([("s", "1", "closed")], "source_key string, external_id string, outcome string")
    once = held(M.apply_links(state, down, at(9)), spark)
    assert once.first().link_runs == 1 and once.first().event is None
    assert M.apply_links(once.drop("event"), down, at(10)).first().event == "closed"
    up = down.withColumn("outcome", F.lit("active"))
    assert M.apply_links(stale.drop("event"), up, at(10)).first().event == "restored"
    unsure = M.apply_links(once.drop("event"), down.withColumn("outcome", F.lit("inconclusive")), at(12)).first()
    assert unsure.link_runs == 1 and unsure.link_checked.day == 12 and unsure.event is None


def test_event_ids(spark):
    rows = [(str(k), "t", "u", "a") for k in range(50)]
    merged = M.merge(M.empty_state(batch(spark, A)), batch(spark, *rows), at(1))
    got = M.events(merged, at(1), after=7).orderBy("id").collect()
    assert [r.id for r in got] == list(range(8, 58)) and {r.external_id for r in got} == {r[0] for r in rows}
    c = M.counts(merged).first()
    assert (c.new, c.live, c.closed) == (50, 50, 0)


JOB = "event_id long, company string, title string, location string, team string, workplace_type string, description string, technologies array<string>, score double"
PERSON = "chat_id string, " + ", ".join(f"{a} array<string>" for a in N.ARRAYS) + ", min_score double"


def test_notify(spark):
    jobs = spark.createDataFrame([(1, "Acme", "Java dev", "Remote", None, "", "text", ["Java", "SQL"], 80.0), (2, "Beta", "QA", None, None, "office", None, None, None)], JOB)
    person = lambda chat, score=None, **k: (chat, *[k.get(a) for a in N.ARRAYS], score)
    people = spark.createDataFrame(
        [person("all"), person("java", technologies=["java", "sql"]), person("remote", formats=["REMOTE"]), person("best", 70.0), person("qa", title_words=["qa"], companies=["beta"]), person(None), person("empty", keywords=[])], PERSON
    )
    pairs = N.matched(jobs, people, salts=3)
    got = sorted(map(tuple, pairs.collect()))
    assert got == [(1, "all"), (1, "best"), (1, "empty"), (1, "java"), (1, "remote"), (2, "all"), (2, "empty"), (2, "qa")]
    done = spark.createDataFrame([(1, "all", "sent"), (2, "all", "error")], "event_id long, chat_id string, status string")
    left = N.unsent(pairs, done)
    assert left.count() == 7
    after = N.ledger(done, left.withColumn("status", F.lit("sent")))
    assert after.count() == 8 and N.unsent(pairs, after).count() == 0
    text = spark.range(1).select(N.message(F.lit("A&B"), F.lit(""), F.lit("u?a=1"), F.lit(81.6)), N.digest_parts(F.array(*map(F.lit, (5, 6, 3, 20))), 10)).first()
    assert text[0] == '<b>A&amp;B</b>\nUntitled\nmatch 82%\n<a href="u?a=1">open</a>' and text[1] == [0, 1, 1, 2]


def test_tallied(spark):
    """Counts without pairs are those of the pairs: over several broadcasts, with chats of several filters and with keywords."""
    techs, firms = ["java", "sql", "go"], ["acme", "beta labs", "", None]
    jobs = spark.createDataFrame(
        [(k, firms[k % 4], ["Java dev", "QA", None][k % 3], ["Berlin", None][k % 2], None, "", f"text {k % 5}", techs[k % 3 :] or None, float(k)) for k in range(40)], JOB
    )
    wants = [{}, {"technologies": ["Java", "SQL"]}, {"companies": ["a"]}, {"locations": ["ber"], "keywords": ["text 3"]}, {"title_words": ["qa"], "technologies": ["go"]}, {"keywords": ["acme"]}]
    person = lambda chat, score, k: (chat, *[k.get(a) for a in N.ARRAYS], score)
    people = [person(f"c{i}", [None, 20.0][i % 2], wants[i % 6]) for i in range(30)] + [person("c1", None, wants[2]), person("c1", None, wants[4]), person("", None, {})]
    people = spark.createDataFrame(people + people[:3], PERSON)
    want = sorted(map(tuple, N.matched(jobs, people, salts=2).groupBy("chat_id").agg(F.count("*"), F.sum("event_id")).collect()))
    for asked_rows in (N.ASKED, 2):
        assert sorted(map(tuple, N.tallied(jobs, people, asked_rows).collect())) == want
    assert len(want) == 30


def test_filters_are_matched_once(spark):
    """Subscribers who share a filter are one row where events are met."""
    people = spark.createDataFrame([(f"c{i}", *[["Java", "java"] if a == "technologies" else None for a in N.ARRAYS], None) for i in range(50)], PERSON)
    jobs = spark.createDataFrame([(1, "Acme", "x", "", "", "", "", ["Java"], None)], JOB)
    assert N._asked(jobs, N._members(people), 2).count() == 1 and N.matched(jobs, people).count() == 50
