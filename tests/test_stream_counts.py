"""Upserted running counts: totals, replaced versions, late rows."""

import datetime as dt

from cadenza.streaming.incremental import read_running_counts, upsert_running_counts

SCHEMA = "user_id string, track_id string, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day - 1)


def run(spark, tmp_path, name="log"):
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    upsert_running_counts(source, str(tmp_path / "table"), str(tmp_path / name), watermark="2 days", availableNow=True).awaitTermination()
    return {(r["user_id"], r["track_id"]): tuple(r[2:]) for r in read_running_counts(spark, str(tmp_path / "table")).collect()}


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_counts_versions_and_late_rows(spark, tmp_path):
    feed(spark, tmp_path, [("u", "a", at(10, 8)), ("u", "a", at(10, 6)), ("u", "b", at(9)), ("v", "a", None)])
    got = run(spark, tmp_path)
    assert got == {("u", "a"): (2, at(10, 6), at(10, 8)), ("u", "b"): (1, at(9), at(9))}  # a row without time does not count
    # Day 9 is still open (watermark day 8, 8:00); day 1 is long closed.
    feed(spark, tmp_path, [("u", "b", at(9, 5)), ("u", "a", at(11)), ("u", "a", at(1)), ("w", "late", at(2))])
    got = run(spark, tmp_path)
    assert got == {("u", "a"): (3, at(10, 6), at(11)), ("u", "b"): (2, at(9), at(9, 5))}
    # The same rows again from a second query with a state of its own are added.
    twice = run(spark, tmp_path, "other")
    assert twice[("u", "b")][0] >= 3 and twice[("u", "a")][1] <= at(10, 6)
