"""Reranking, playlists, metrics, moods, profiles and streaming on small lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import evaluate as E
from cadenza.operators import mood as M
from cadenza.operators import playlist as P
from cadenza.operators import profile as T
from cadenza.operators import rerank as R
from cadenza.operators.candidates import dedupe_candidates, recent_plays
from cadenza.streaming.incremental import (
    compact_interactions, read_interactions, read_recent_plays, stream_interactions, stream_recent_plays, stream_running_counts,
)
from cadenza.operators.interactions import listens_to_interactions


def _greedy(rows, e, s):
    """Plain statement of the greedy diversity order for one list."""
    cap = 2 if e >= 0.65 else 4
    left = sorted(rows, key=lambda r: (-r["score"], r["track_id"]))
    artists, sources, out = {}, set(), []
    while left:
        open_artist = any(not r["a"] or artists.get(r["a"], 0) < cap for r in left)
        best = None
        for r in left:
            if open_artist and r["a"] and artists.get(r["a"], 0) >= cap:
                continue
            v = r["score"] + 0.35 * e * s * r["n"] + (0.12 * e * s if r["s"] and r["s"] not in sources else 0.0)
            v -= 0.95 * e * s * (artists.get(r["a"], 0) if r["a"] else 0)
            if best is None or v > best[0] + 1e-12 or (abs(v - best[0]) <= 1e-12 and r["track_id"] < best[1]["track_id"]):
                best = (v, r)
        left.remove(best[1])
        out.append(best[1]["track_id"])
        if best[1]["a"]:
            artists[best[1]["a"]] = artists.get(best[1]["a"], 0) + 1
        if best[1]["s"]:
            sources.add(best[1]["s"])
    return out


@pytest.mark.parametrize("level,strength", [(0.7, 1.0), (0.4, 0.75), (0.0, 1.0)])
def test_greedy_diversity_order(spark, level, strength):
    rng = random.Random(11)
    rows = []
    for user in range(6):
        for t in range(rng.randint(1, 15)):
            rows.append((user, f"t{t:02d}", rng.choice([1.0, 0.8, rng.random()]), rng.choice(["A", "a ", "B", "C", ""]), rng.choice(["x, y", "y", ""]), rng.random()))
    df = spark.createDataFrame(rows, "user_id long, track_id string, score double, artist_name string, candidate_sources string, catalog_novelty double")
    out = R.rerank_diversity(df, exploration=level, strength=strength)
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["track_id"])
    for user in range(6):
        mine = [dict(track_id=r[1], score=r[2], a=r[3].strip().lower(), s=r[4].split(",")[0].strip(), n=r[5]) for r in rows if r[0] == user]
        assert got[user] == _greedy(mine, level, strength)
    assert R.rerank_diversity(df, exploration=level, k=1).groupBy("user_id").count().where("count <> 1").count() == 0


def test_artist_cap_fixture(spark):
    rows = [("u", f"a{n}", 1.0 - n / 100, "Artist A", "s", 0.1) for n in range(3)] + [("u", "b", 0.5, "Artist B", "s", 0.1), ("u", "c", 0.4, "Artist C", "s", 0.1)]
    df = spark.createDataFrame(rows, "user_id string, track_id string, score double, artist_name string, candidate_sources string, catalog_novelty double")
    first = [r["track_id"] for r in R.rerank_diversity(df, exploration=1.0).orderBy("rank").limit(4).collect()]
    assert sum(t.startswith("a") for t in first) <= 2


def test_playlist_order_and_checks(spark):
    rng = random.Random(4)
    columns = ["danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness"]
    rows = [(p, f"t{n}", "x", "y", *[rng.random() if c != "tempo" else rng.uniform(60, 160) for c in columns]) for p in "pq" for n in range(9)]
    df = spark.createDataFrame(rows, "user_id string, track_id string, track_name string, artist_name string, " + ", ".join(f"{c} double" for c in columns))
    out = P.sequence_playlist(df, "workout", max_items=5)
    prof = M.MOOD_PROFILES["workout"]
    for p in "pq":
        left = {r[1]: dict(zip(columns, r[4:])) for r in rows if r[0] == p}
        fit = {t: sum(max(0, 1 - abs(v[c] - a) / b) for c, (a, b) in prof["features"].items()) / 5 for t, v in left.items()}
        order = [min(left, key=lambda t: (-round(fit[t], 9), t))]
        while len(order) < 5:
            prev = left[order[-1]]

            def score(t):
                v = left[t]
                div = min(1.0, sum(sum(abs(v[c] - left[o][c]) for c in P.DIVERSITY_COLUMNS) / 4 for o in order) / len(order))
                smooth = (max(0, 1 - abs(v["tempo"] - prev["tempo"]) / prof["tempo_step"]) + max(0, 1 - abs(v["energy"] - prev["energy"]) / prof["energy_step"])) / 2
                return 0.6 * fit[t] + 0.2 * div + 0.2 * smooth

            order.append(min((t for t in sorted(left) if t not in order), key=lambda t: (-round(score(t), 9), t)))
        got = [r["track_id"] for r in out.where(F.col("user_id") == p).orderBy("position").collect()]
        assert got == order
    with pytest.raises(ValueError, match="tempo"):
        P.prepare_candidates(df.drop("tempo"))
    with pytest.raises(ValueError, match="unknown mood"):
        M.sequencing_profile("party")
    assert P.sequence_playlist(df, "calm", max_items=0).count() == 0


def test_metrics_fixture(spark):
    ranked = spark.createDataFrame([("u", "t1", 1), ("u", "t2", 2), ("u", "t3", 3), ("u", "t4", 4)], "user_id string, track_id string, rank int")
    rel = spark.createDataFrame([("u", "t1"), ("u", "t3"), ("none", "t9")], "user_id string, track_id string")
    at3 = {r["user_id"]: r for r in E.ranking_metrics(ranked, rel, k=3).collect()}
    assert at3["u"]["precision"] == pytest.approx(2 / 3) and at3["u"]["ndcg"] == pytest.approx(0.9197, abs=1e-4)
    assert at3["none"]["precision"] == at3["none"]["ndcg"] == at3["none"]["map"] == 0.0
    assert {r["user_id"]: r["map"] for r in E.ranking_metrics(ranked, rel, k=4).collect()}["u"] == pytest.approx(0.8333, abs=1e-4)
    table = E.compare_models({"m": ranked, "empty": ranked.where("false")}, rel, k=3).collect()
    assert {r["model"]: (r["evaluated_users"], round(r["recall"], 3)) for r in table} == {"m": (2, 0.5), "empty": (2, 0.0)}


def test_beyond_accuracy_fixture(spark):
    ranked = spark.createDataFrame([("u", f"t{n}", n) for n in (1, 2, 3)] + [("v", "t9", 1)], "user_id string, track_id string, rank int")
    sims = spark.createDataFrame([("t1", "t2", 0.2), ("t3", "t1", 0.4), ("t2", "t3", 0.6)], "track_a string, track_b string, similarity double")
    div = {r["user_id"]: r["diversity"] for r in E.list_diversity(ranked, sims).collect()}
    assert div["u"] == pytest.approx(0.6) and div["v"] == 0.0
    pop = spark.createDataFrame([("t1", 0.5), ("t2", 0.25), ("t3", 0.125)], "track_id string, popularity double")
    nov = {r["user_id"]: r for r in E.list_novelty(ranked, pop).collect()}
    assert nov["u"]["novelty"] == pytest.approx(2.0) and nov["u"]["popularity_bias"] == pytest.approx(0.875 / 3)
    assert nov["v"]["novelty"] == 0.0 and nov["v"]["popularity_bias"] == 0.0
    cat = spark.createDataFrame([(f"t{n}",) for n in range(1, 6)], "track_id string")
    assert E.catalog_coverage(ranked, cat).first()["coverage"] == pytest.approx(0.6)


def test_holdout_by_time_and_fallback(spark):
    rows = [("u1", "a", 5.0, "2020-01-01"), ("u1", "b", 1.0, "2020-02-01"), ("u2", "c", 9.0, None), ("u2", "d", 10.0, None), ("solo", "z", 1.0, None)]
    df = spark.createDataFrame(rows, "user_id string, track_id string, interaction_strength double, last_timestamp string")
    test = {r["user_id"]: r["track_id"] for r in E.holdout(df, n=3, min_interactions=2, by="time").where("is_test").collect()}
    assert test == {"u1": "b", "u2": "d"}
    assert E.holdout(df, n=1).where("is_test AND user_id = 'u1'").first()["track_id"] == "a"
    train = df.where("track_id IN ('a', 'c')")
    pool = spark.createDataFrame([("a",)], "track_id string")
    assert [r["track_id"] for r in E.restrict_to_pool(train, pool).collect()] == ["a"]
    assert E.restrict_to_pool(train, pool.where("false")).count() == 2


def test_duplicate_candidates(spark):
    rows = [("u", 0, 0, 1, "id1", "One Song", "Band"), ("u", 1, 0, 1, "id2", "One Song - Live Version", "Band"),
            ("u", 2, 0, 1, "id1", "One Song", "Band"), ("u", 3, 0, 1, "id3", "(!)", ""), ("u", 3, 0, 2, "id4", "(!)", "")]
    df = spark.createDataFrame(rows, "user_id string, source int, value_pos int, rank int, track_id string, track_name string, artist_name string")
    out = dedupe_candidates(df).orderBy("candidate_pos").collect()
    assert [r["track_id"] for r in out] == ["id1", "id3", "id4"]
    assert out[0]["candidate_sources"] == ["recent artist top track", "recent artist search match", "recent track search match"]


def test_profile_rerank_without_signals(spark):
    ranked = spark.createDataFrame([("u", "a", 0.5), ("u", "b", 0.4)], "user_id string, track_id string, score double")
    cat = spark.createDataFrame([("a", "X", "pop", 0.5), ("b", "X", "pop", 0.5)], "track_id string, artist_name string, artist_genres string, danceability double")
    for c in ("energy", "valence", "acousticness", "instrumentalness"):
        cat = cat.withColumn(c, F.lit(0.5))
    none = spark.createDataFrame([("other",)], "user_id string").selectExpr(
        "user_id", "map('a', 1D) recent_artists", "map('a', 1D) seed_artists", "map('a', 1D) genres", "array(1D, 1D, 1D, 1D) taste", "'calm' mood")
    out = R.rerank_profile(ranked, cat, none).orderBy("rank").collect()
    assert [(r["track_id"], r["score"], r["reasons"]) for r in out] == [("a", 0.5, []), ("b", 0.4, [])]


def test_rank_overlap(spark):
    a = spark.createDataFrame([("u", t, n) for n, t in enumerate("abc", 1)], "user_id string, track_id string, rank int")
    b = spark.createDataFrame([("u", t, n) for n, t in enumerate("bcd", 1)], "user_id string, track_id string, rank int")
    assert R.top_overlap(a, b, k=3).first()["overlap"] == pytest.approx(2 / 3)
    assert R.position_changes(a, b).first()["positions_changed"] == 3


def test_small_profile_has_not_enough_data(spark):
    rows = spark.createDataFrame([("u", 1, True), ("u", 2, True)], "user_id string, track_id long, is_recent boolean").selectExpr(
        "*", "0.5D energy", "0.5D danceability", "0.5D valence", "0.5D acousticness", "'indie pop' artist_genres")
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "track_id long, cluster_id int")
    assert T.taste_profile(rows, clusters).first()["cluster_label"] == "Not enough data"
    three = rows.union(rows.where("track_id = 1").withColumn("track_id", F.lit(3).cast("long")))
    assert T.taste_profile(three, clusters).first()["cluster_label"] == "Indie / Alternative Discovery"


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"u{rng.randint(0, 4)}", f"t{rng.randint(0, 6)}", "A", "S", rng.randint(0, 10**6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "user_id string, track_id string, artist_name string, track_name string, sec long").selectExpr(
        "user_id", "track_id", "artist_name", "track_name", "timestamp_seconds(sec) AS ts")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    def stream(**kw):
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_interactions(stream(), str(tmp_path / "i"), str(tmp_path / "ic"), availableNow=True).awaitTermination()
    columns = ["user_id", "track_id", "listen_count", "first_timestamp", "last_timestamp"]
    want = sorted(map(tuple, listens_to_interactions(df).select(*columns).collect()))
    assert sorted(map(tuple, read_interactions(spark, str(tmp_path / "i")).select(*columns).collect())) == want
    compact_interactions(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, read_interactions(spark, str(tmp_path / "i")).select(*columns).collect())) == want
    counts = stream_running_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("running")
    counts.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("running").select(*columns).collect())) == want
    plays = df.selectExpr("user_id", "track_id", "ts AS played_at")
    source = stream().selectExpr("user_id", "track_id", "ts AS played_at")
    stream_recent_plays(source, str(tmp_path / "r"), str(tmp_path / "rc"), limit=5, availableNow=True).awaitTermination()
    key = ["user_id", "pos", "track_id"]
    assert sorted(map(tuple, read_recent_plays(spark, str(tmp_path / "r"), limit=5).select(*key).collect())) == sorted(
        map(tuple, recent_plays(plays, limit=5).select(*key).collect()))


def test_keyword_mood(spark):
    df = spark.createDataFrame([("Brunch run", "search"), ("sleep piano", "")], "track_name string, candidate_sources string")
    got = [r[0] for r in df.select(M.keyword_mood_score("workout", M.mood_text(df.columns))).collect()]
    assert got[0] == pytest.approx(0.72 * (0.22 + 0.12 + 0.15) + 0.28) and got[1] == pytest.approx(0.28 * (1 - 0.56))
    assert M.scoring_mood("focus") == "calm"
    assert math.isclose(sum(M.POSITIVE_SIGNALS["happy"].values()), 1.0)


def test_one_long_list_next_to_short_ones(spark):
    """Heap order and playlist matrix against the plain rule, and a long list that no padding multiplies."""
    rng = random.Random(8)
    rows = [("long", t, rng.random(), f"A{rng.randrange(9)}", rng.choice(["", "s1, x", "S2", "s3"]), rng.random()) for t in range(700)]
    rows += [(f"u{u}", t, round(rng.random(), 1), rng.choice(["", "A", "a ", "B"]), rng.choice(["", "p", "q"]), 0.5) for u in range(30) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "user_id string, track_id long, score double, artist_name string, candidate_sources string, catalog_novelty double").repartition(3)
    out = R.rerank_diversity(df, exploration=0.7, strength=0.8)
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["track_id"])
    for user in ("long", "u0", "u7", "u29"):
        left = [(t, s + 0.35 * 0.7 * 0.8 * n, a.strip().lower(), src.split(",")[0].strip().lower()) for u, t, s, a, src, n in rows if u == user]
        repeats, seen, want = {}, set(), []
        while left:
            under = [x for x in left if not (x[2] and repeats.get(x[2], 0) >= 2)] or left
            value = lambda x: x[1] + 0.12 * 0.56 * bool(x[3] and x[3] not in seen) - 0.95 * 0.56 * (repeats.get(x[2], 0) if x[2] else 0)
            best = min(under, key=lambda x: (-round(value(x), 9), x[0]))
            left.remove(best)
            want.append(best[0])
            repeats[best[2]] = repeats.get(best[2], 0) + 1
            seen.add(best[3])
        assert got[user] == want
    n = 200_000
    big = spark.range(n).selectExpr("'big' AS user_id", "id AS track_id", "(id * 7919 % 100003) / 100003D AS score", "concat('A', id % 5000) AS artist_name", "concat('s', id % 3) AS candidate_sources", "0.5D AS catalog_novelty")
    assert R.rerank_diversity(big, exploration=0.7).agg(F.max("rank"), F.countDistinct("track_id")).first()[:] == (n, n)
