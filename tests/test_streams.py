import uuid

import pytest
from pyspark.sql import functions as F

from ticketloom.session import shared_folder
from ticketloom.streaming import jobs


@pytest.fixture()
def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def test_equal_rows_without_a_key_all_stay(spark, folder):
    rows = [(None, "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("created_at"))
    df.write.parquet(folder)
    out = jobs.run_to_table(jobs.deduplicated(jobs.file_stream(spark, folder, df.schema), "k"), "nulls")
    assert sorted((r["k"] or "") for r in out.collect()) == ["", "", "a"]


LOGS = "endpoint string, latency_ms double, created_at timestamp_ntz"


def logs(spark, rows):
    return spark.createDataFrame(rows, "endpoint string, latency_ms double, t string").select(
        "endpoint", "latency_ms", F.col("t").cast("timestamp_ntz").alias("created_at")
    )


def test_windows_resume_and_match_the_batch(spark, folder):
    first = logs(spark, [("a", 1.0, "2024-01-01 05:00:00"), ("a", 3.0, "2024-01-01 06:00:00"), (None, 2.0, "2024-01-01 07:00:00")])
    later = logs(spark, [("a", 5.0, "2024-01-01 08:00:00"), ("b", 1.0, "2024-01-02 08:00:00")])

    def result():
        stream = jobs.daily_endpoint_metrics(jobs.file_stream(spark, f"{folder}/in", first.schema))
        out = jobs.run_to_latest(
            stream.withColumn("endpoint", F.coalesce("endpoint", F.lit("none"))), ["day", "endpoint"], "days", f"{folder}/out", f"{folder}/progress"
        )
        return sorted((r["day"].day, r["endpoint"], r["requests"], r["mean_latency_ms"]) for r in out.collect())

    first.write.mode("append").parquet(f"{folder}/in")
    assert result() == [(1, "a", 2, 2.0), (1, "none", 1, 2.0)]
    assert result() == [(1, "a", 2, 2.0), (1, "none", 1, 2.0)]
    later.write.mode("append").parquet(f"{folder}/in")
    assert result() == [(1, "a", 3, 3.0), (1, "none", 1, 2.0), (2, "b", 1, 1.0)]


def triage(batch):
    return batch.select(
        "ticket_id", F.upper("word").alias("predicted_category"), F.lit("P3").alias("predicted_priority"),
        F.lit(0.5).alias("predicted_confidence"), F.lit("q").alias("assignee_queue"),
    )


def test_triage_resumes_and_updates(spark, folder):
    def run():
        stream = jobs.file_stream(spark, f"{folder}/in", "ticket_id long, word string")
        out = jobs.triage_stream(stream, triage, root=f"{folder}/out", progress=f"{folder}/progress")
        return sorted((str(r["ticket_id"]), r["predicted_category"], r["status"]) for r in out.collect())

    def add(rows):
        spark.createDataFrame(rows, "ticket_id long, word string").write.mode("append").parquet(f"{folder}/in")

    add([(1, "a"), (2, "b"), (None, "x")])
    assert run() == [("1", "A", "open"), ("2", "B", "open"), ("None", "X", "open")]
    assert run() == [("1", "A", "open"), ("2", "B", "open"), ("None", "X", "open")]
    add([(2, "c"), (3, "d"), (None, "x")])
    want = [("1", "A", "open"), ("2", "C", "open"), ("3", "D", "open"), ("None", "X", "open"), ("None", "X", "open")]
    assert run() == want
    log = jobs.ChangeLog(spark, f"{folder}/out", f"{folder}/progress")
    schema = spark.createDataFrame([], f"ticket_id long, status string, {jobs.PREDICTIONS}").schema
    log.compact(schema, ["ticket_id"], f"{folder}/compacted", ("status",))
    table = jobs.ChangeLog(spark, f"{folder}/compacted", f"{folder}/progress").table(schema, ["ticket_id"])
    assert sorted((str(r["ticket_id"]), r["predicted_category"], r["status"]) for r in table.collect()) == want


def test_nothing_arrived(spark, folder):
    spark.createDataFrame([], "ticket_id long, word string").write.parquet(f"{folder}/in")
    stream = jobs.file_stream(spark, f"{folder}/in", "ticket_id long, word string")
    assert jobs.triage_stream(stream, triage, root=f"{folder}/out", progress=f"{folder}/progress").collect() == []


def sla_events(spark, folder, opened, resolved):
    opened = spark.createDataFrame(opened, "ticket_id long, priority string, t string")
    opened = opened.select("ticket_id", "priority", F.col("t").cast("timestamp_ntz").alias("created_at"))
    resolved = spark.createDataFrame(resolved, "ticket_id long, t string").select(
        "ticket_id", F.col("t").cast("timestamp_ntz").alias("resolved_at")
    )
    opened.coalesce(1).write.mode("append").parquet(f"{folder}/opened")
    resolved.coalesce(1).write.mode("append").parquet(f"{folder}/resolved")


def sla_run(spark, folder, label, files=None):
    from ticketloom.streaming import sla

    opened = jobs.file_stream(spark, f"{folder}/opened", "ticket_id long, priority string, created_at timestamp_ntz", files)
    resolved = jobs.file_stream(spark, f"{folder}/resolved", "ticket_id long, resolved_at timestamp_ntz", files)
    out = sla.run_alerts(opened, resolved, f"{folder}/{label}", f"{folder}/{label}-progress")
    return sorted((r["ticket_id"], r["alert"], str(r["at"])) for r in out.collect())


FIRST = (
    [(1, "P1", "2024-01-01 00:00:00"), (2, "P1", "2024-01-01 00:00:00"), (3, "P1", "2024-01-01 00:00:00"), (4, "P1", "2024-01-01 00:00:00"),
     (None, "P1", "2024-01-01 00:00:00"), (1, "P1", "2024-01-01 00:00:00")],
    [(2, "2024-01-01 03:30:00"), (3, "2024-01-01 02:00:00"), (7, "2024-01-01 05:00:00"), (8, "2024-01-01 00:30:00"), (None, "2024-01-01 00:00:00")],
)
SECOND = (
    [(5, "P1", "2024-01-09 00:00:00"), (6, None, "2024-01-09 00:00:00"), (7, "P1", "2024-01-01 04:00:00")],
    [(4, "2024-01-09 06:00:00"), (1, "2024-01-09 07:00:00")],
)
THIRD = ([(9, "P4", "2024-01-20 00:00:00")], [(6, "2024-01-20 00:00:00")])


def test_sla_timers(spark, folder):
    """Hours of P1 are 4: at risk after 3."""
    from ticketloom import vocab

    assert vocab.SLA_HOURS["P1"] == 4
    sla_events(spark, folder, *FIRST)
    # Ticket 2 was resolved between the two times, 3 before both; nothing is certain yet of 1 and 4.
    assert sla_run(spark, folder, "out") == [(2, "at_risk", "2024-01-01 03:00:00")]
    sla_events(spark, folder, *SECOND)
    due = "2024-01-01 04:00:00"
    second = [(t, alert, at) for t in (1, 4) for alert, at in (("at_risk", "2024-01-01 03:00:00"), ("breach", due))]
    got = sla_run(spark, folder, "out")
    assert got == sorted([*second, (2, "at_risk", "2024-01-01 03:00:00")])
    sla_events(spark, folder, *THIRD)
    hours = vocab.DEFAULT_SLA_HOURS
    import datetime as dt

    opened = dt.datetime(2024, 1, 9)
    sixth = [(6, a, str(opened + dt.timedelta(hours=hours * s))) for a, s in (("at_risk", 0.75), ("breach", 1))]
    fifth = [(5, "at_risk", "2024-01-09 03:00:00"), (5, "breach", "2024-01-09 04:00:00")]
    assert sla_run(spark, folder, "out") == sorted([*got, *fifth, *sixth])
    # From the start in one run, file by file, the table is the same.
    assert sla_run(spark, folder, "again", files=1) == sorted([*got, *fifth, *sixth])


def test_sla_timers_of_many_tickets_in_one_group(spark, folder, monkeypatch):
    """All tickets share one state and one timer; alerts are those of each ticket by itself."""
    from ticketloom.streaming import sla

    monkeypatch.setattr(sla, "GROUPS", 1)
    test_sla_timers(spark, folder)
