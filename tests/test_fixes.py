"""Exact values of cases that once went wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadenza.functions.text import utc_timestamp
from cadenza.operators import context as C
from cadenza.operators.benchmark import pool_benchmark
from cadenza.operators.candidates import dedupe_candidates, expand_candidates
from cadenza.operators.evaluate import list_diversity
from cadenza.operators.hybrid import exploration_weights
from cadenza.operators.normalize import track_level
from cadenza.operators.playlist import sequence_playlist
from cadenza.operators.rerank import rerank_diversity
from cadenza.operators.similarity import list_pair_cosine
from cadenza.session import ensure_checkpoint_dir
from cadenza.streaming.incremental import compact_interactions, read_interactions, stream_interactions


def test_audio_is_the_base_of_an_empty_metadata_table(spark):
    audio = spark.createDataFrame([("t1", 0.5), ("t2", 0.7)], "track_id string, danceability double").withColumn("duration_ms", F.lit(1))
    metadata = spark.createDataFrame([], "track_id string, track_name string")
    assert sorted(r["track_id"] for r in track_level(metadata, audio).collect()) == ["t1", "t2"]
    one = spark.createDataFrame([("t1", "One")], "track_id string, track_name string")
    assert [r["track_id"] for r in track_level(one, audio).collect()] == ["t1"]


def test_times_without_a_zone_are_utc_in_every_session(spark):
    texts = ["2009-05-04T23:08:57Z", "2009-05-04 23:08:57", "2009-05-04T23:08:57", "2009-05-05T01:08:57+02:00", "2009-05-04", "soon", None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(utc_timestamp(F.col("t"))).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    at = int(dt.datetime(2009, 5, 4, 23, 8, 57, tzinfo=dt.timezone.utc).timestamp())
    day = int(dt.datetime(2009, 5, 4, tzinfo=dt.timezone.utc).timestamp())
    assert [r["s"] for r in rows] == [at, at, at, at, day, None, None]


def _ranked(spark):
    rows = [("u", "a", 0.9), ("u", "b", 0.8), ("v", "c", 0.5)]
    return spark.createDataFrame(rows, "user_id string, track_id string, score double").withColumns(
        {"artist_name": F.lit("x"), "candidate_sources": F.lit("s"), "catalog_novelty": F.lit(0.1)}
    )


def test_no_items_asked_for_gives_no_rows(spark):
    assert rerank_diversity(_ranked(spark), exploration=0.5, k=0).count() == 0
    assert rerank_diversity(_ranked(spark), exploration=0.5, k=1).count() == 2


def test_a_repeated_candidate_is_placed_once(spark):
    row = {"track_name": "n", "artist_name": "x", "danceability": 0.5, "energy": 0.5, "valence": 0.5, "tempo": 120.0, "acousticness": 0.5, "instrumentalness": 0.1}
    df = spark.createDataFrame([("p", t, e) for t, e in (("a", 0.2), ("b", 0.9), ("a", 0.2))], "user_id string, track_id string, e double")
    df = df.withColumns({k: F.lit(v) for k, v in row.items()}).withColumn("energy", F.col("e"))
    got = sequence_playlist(df, "workout", max_items=3).orderBy("position").collect()
    assert sorted(r["track_id"] for r in got) == ["a", "b"]


def test_vocabulary_without_positive_information_keeps_its_context(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "track_id string, context_id string, weight double")
    none = C.ppmi(pairs).where("ppmi > 100")
    vectors = C.truncated_svd(none, dim=2)
    assert vectors.count() == 0
    seeds = spark.createDataFrame([("u", "a")], "user_id string, track_id string")
    asked = spark.createDataFrame([("u", "b"), ("u", "z"), ("w", "b")], "user_id string, track_id string")
    got = {(r["user_id"], r["track_id"]): r["score"] for r in C.context_scores(pairs, vectors, seeds, asked, 2).collect()}
    assert got == {("u", "b"): pytest.approx(0.65), ("u", "z"): 0.0, ("w", "b"): 0.0}
    near = {(r["track_id"], r["similar_id"]): r["score"] for r in C.similar_tracks(pairs, vectors, k=1).collect()}
    assert near == {("a", "b"): pytest.approx(0.65), ("b", "a"): pytest.approx(0.65)}


def test_svd_tells_when_it_does_not_converge(spark):
    cells = [(i, j, 1.0 / (1 + i + j)) for i in range(6) for j in range(6)]
    matrix = spark.createDataFrame(cells, "a long, b long, v double")
    with pytest.raises(RuntimeError, match="still change"):
        C.truncated_svd(matrix, dim=1, oversample=0, max_rounds=1)
    assert C.truncated_svd(matrix, dim=1, oversample=0).count() == 6


def test_tracks_of_several_artists(spark):
    recent = spark.createDataFrame([("u", "r", 0, "Old", "B", "pop")], "user_id string, track_id string, pos int, track_name string, artist_name string, artist_genres string")
    catalog = spark.createDataFrame([("t1", "One", "A, B", "rock", 5.0), ("t2", "Old", "B, C", "rock", 1.0)], "track_id string, track_name string, artist_name string, artist_genres string, popularity double")
    raw = expand_candidates(recent, catalog)
    assert {(r["track_id"], r["source"]) for r in raw.collect()} == {("t1", 0), ("t1", 1), ("t2", 0), ("t2", 1), ("t2", 2)}
    copies = raw.where("source = 0").unionByName(raw.where("source = 0 and track_id = 't1'").withColumns({"track_id": F.lit("t9"), "artist_name": F.lit("A, Z"), "rank": F.lit(9)}))
    assert sorted(r["track_id"] for r in dedupe_candidates(copies).collect()) == ["t1", "t2"]


def test_diversity_reads_every_pair_of_a_list(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "track_id string, features array<double>")
    ranked = spark.createDataFrame([("u", t) for t in "abc"] + [("v", "a")], "user_id string, track_id string")
    got = {r["user_id"]: r["diversity"] for r in list_diversity(ranked, list_pair_cosine(ranked, vectors)).collect()}
    assert got == {"u": pytest.approx(1 - 2 * 0.5**0.5 / 3), "v": 0.0}


def test_pool_tracks_without_training_rows_take_part(spark):
    rows = [(f"u{u}", f"t{t}", float(1 + (u * t) % 5), dt.datetime(2020, 1, 1 + t)) for u in range(4) for t in range(5)]
    interactions = spark.createDataFrame(rows, "user_id string, track_id string, interaction_strength double, last_timestamp timestamp")
    catalog = spark.createDataFrame([(f"t{t}", f"n{t}", "x", "pop", float(t)) for t in range(8)], "track_id string, track_name string, artist_name string, artist_genres string, popularity double")
    features = spark.createDataFrame([(f"t{t}", [float(t), 1.0]) for t in range(8)], "track_id string, features array<double>")
    for size in (6, None):
        out = pool_benchmark(interactions, catalog, features, 2, weights=exploration_weights(0.35), k=3, models=["ALS_only", "context_only"], pool_size=size)
        got = {r["model"]: r for r in out.collect()}
        assert set(got) == {"ALS_only", "context_only"} and all(r["evaluated_users"] == 4 for r in got.values())


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_a_new_checkpoint_adds_and_compaction_may_come_between(spark, tmp_path):
    rows = [("u", "t", dt.datetime(2020, 1, 1, 0, m), "A", "T") for m in range(6)]
    names = "user_id string, track_id string, ts timestamp, artist_name string, track_name string"
    table = str(tmp_path / "table")
    total = lambda: [(r["listen_count"], r["first_timestamp"].minute, r["last_timestamp"].minute) for r in read_interactions(spark, table).collect()]
    for k in range(3):
        source = str(tmp_path / f"in{k}")
        spark.createDataFrame(rows[2 * k : 2 * k + 2], names).write.parquet(source)
        stream = spark.readStream.schema(names).parquet(source)
        stream_interactions(stream, table, str(tmp_path / f"log{k}"), availableNow=True).awaitTermination()
        assert total() == [(2 * k + 2, 0, 2 * k + 1)]
        if k:
            compact_interactions(spark, table)
            assert total() == [(2 * k + 2, 0, 2 * k + 1)]


def test_audio_brings_no_duration_into_a_catalog_without_one(spark):
    audio = spark.createDataFrame([("t1", 0.5, 9)], "track_id string, danceability double, duration_ms int")
    names = spark.createDataFrame([("t1", "One")], "track_id string, track_name string")
    for metadata in (names, names.where("false")):
        out = track_level(metadata, audio)
        assert "duration_ms" not in out.columns and [r["danceability"] for r in out.collect()] == [0.5]
    timed = track_level(names.withColumn("duration_ms", F.lit(7)), audio).first()
    assert timed["duration_ms"] == 7
    assert track_level(names.withColumn("duration_ms", F.lit(7)).where("false"), audio).first()["duration_ms"] == 9
