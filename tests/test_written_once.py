"""Shared tables of a query are written once, and wide rows are not shuffled where narrow ones do."""

import datetime

import pytest
from pyspark.sql import functions as F

from cadenza.functions.text import strip
from cadenza.operators.candidates import dedupe_candidates, expand_candidates
from cadenza.operators.profile import nearest_references
from registry import all_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    n, day = 12, datetime.date(2024, 1, 1)
    part = [(p, f"word{p % 5} tail{p % 3}", f"Brand#{p % 4}", f"TYPE {p % 3}", p % 50, 900.0 + p) for p in range(n)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(o, o % 6) for o in range(24)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    lines = [(o, (o * 5 + k * k) % n, day + datetime.timedelta(days=o + k), 1.0 + k, 0.01 * k, 0.02 * k) for o in range(24) for k in range(4)]
    schema = "l_orderkey long, l_partkey long, l_shipdate date, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["recent_distinct", "seed_affinity", "pool_shares", "pool_summary", "playlist_export", "newest_run"])
def test_plays_are_read_before_the_branches(spark, tables, name):
    out = all_queries()[name](spark, tables)
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() > 0


def test_candidates_are_dealt_once_and_bring_their_key(spark):
    recent = spark.createDataFrame(
        [("u", "a", 0, "Song (live)", "B", "pop"), ("v", "b", 0, "Other", "C", "rock")],
        "user_id string, track_id string, pos int, track_name string, artist_name string, artist_genres string",
    )
    catalog = spark.createDataFrame(
        [("a", "Song", "B", "pop", 5.0), ("c", "song [Live]", "B", "pop", 4.0), ("b", "Other", "C", "rock", 3.0), ("e", "", "C", "rock", 2.0)],
        "track_id string, track_name string, artist_name string, artist_genres string, popularity double",
    )
    raw = expand_candidates(recent, catalog)
    assert "copy_key" in raw.columns
    out = dedupe_candidates(raw)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(out) == rows(dedupe_candidates(raw.drop("copy_key")))
    assert {(r["user_id"], r["track_id"]) for r in out.collect()} == {("u", "a"), ("v", "b"), ("v", "e")}
    given = spark.createDataFrame(raw.collect(), raw.schema)
    assert dedupe_candidates(given)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_references_meet_user_by_user(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0]), ("z", [0.0, 0.0])], "track_id string, features array<double>")
    ranked = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "z"), ("w", "a")], "user_id string, track_id string")
    references = spark.createDataFrame([("u", "b", 0), ("u", "c", 1), ("u", "x", 2), ("v", "c", 0), ("v", "a", 1)], "user_id string, reference_id string, ref_pos int")
    near = nearest_references(ranked, references, vectors, vectors, k=1)
    got = {(r["user_id"], r["track_id"]): (r["reference_id"], round(r["similarity"], 6)) for r in near.collect()}
    assert got == {("u", "a"): ("b", 0.707107), ("u", "b"): ("c", 0.707107), ("v", "z"): ("c", 0.0)}
    first = next(line for line in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line)
    assert "user_id" in first and "right_id#" in first and first.count(" = ") == 2  # user = user, and not (left = right)


def test_strip_leaves_plain_text_and_trims_the_rest(spark):
    texts = ["a", "", " ", " x ", "~!", "é ", " é", "x\n", "a b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~strip(F.col("t")).eqNullSafe(plain)).count() == 0
    assert df.select(strip(F.col("i")).alias("s")).where("s = i").count() == len(texts)
