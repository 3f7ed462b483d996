from pyspark.sql import functions as F

from hirelake.operators.lifecycle import rate_limit
from hirelake.streaming.windows import drain, new_events, stream_rate_limit


def test_cursor_and_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    events.coalesce(1).write.parquet(source)
    for _ in range(2):
        drain(new_events(spark, source, events.schema, ("signup",)), sink, mark).awaitTermination()
    assert spark.read.parquet(sink).count() == events.filter("event_type = 'signup'").count()

    stream = stream_rate_limit(spark.readStream.schema(events.schema).parquet(source), limit=2)
    drain(stream, sink + "2", mark + "2").awaitTermination()
    closed = spark.read.parquet(sink + "2")
    whole = rate_limit(events, 2)
    assert closed.count() > 0 and closed.join(whole, ["user_id", "start", "calls", "allowed"], "left_anti").count() == 0
    assert closed.select(F.max("allowed")).first()[0] <= 2


def test_notices(spark, tmp_path):
    from hirelake.plans import notify as N
    from hirelake.streaming.notices import deliveries, notices

    source, ledger, mark = (str(tmp_path / n) for n in ("in", "ledger", "mark"))
    job = "event_id long, company string, title string, location string, team string, workplace_type string, description string, technologies array<string>, score double"
    row = lambda k, title: (k, "c", title, "", "", "", "", ["java"], None)
    person = "chat_id string, " + ", ".join(f"{a} array<string>" for a in N.ARRAYS) + ", min_score double"
    people = spark.createDataFrame([("a", *[None] * 8, None), ("b", None, ["qa"], *[None] * 6, None)], person)
    runs = ([row(1, "dev"), row(2, "qa")], [row(2, "qa"), row(3, "qa")])
    for rows in runs:
        spark.createDataFrame(rows, job).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(job).parquet(source)
        notices(stream, people, ledger, mark, lambda p: p.withColumn("status", F.when((F.col("chat_id") == "b") & (F.col("event_id") == 2), "error").otherwise("sent"))).awaitTermination()
    got = sorted(map(tuple, deliveries(spark, ledger).collect()))
    assert got == [(1, "a", "sent"), (2, "a", "sent"), (2, "b", "error"), (3, "a", "sent"), (3, "b", "sent")]
    log = spark.read.parquet(ledger)
    assert log.filter("event_id = 2 and chat_id = 'a'").count() == 1 and log.filter("event_id = 2 and chat_id = 'b'").count() == 2
