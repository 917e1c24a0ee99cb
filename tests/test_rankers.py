import numpy as np
import pytest

from cadenza.operators import context as C
from cadenza.operators.content import content_explain, content_topk
from cadenza.operators.factors import factor_scores, factor_topk, fit_factors
from cadenza.operators.features import content_features, feature_table
from cadenza.operators.hybrid import (
    BlendWeights, Weights, advanced_blend, candidate_weights, component_table, exploration_weights, hybrid, optional_blend,
)
from cadenza.operators.neighbours import cf_topk, item_neighbours
from cadenza.operators.clusters import cluster_count, kmeans_labels, project_2d

INTER = "user_id string, track_id string, interaction_strength double"


def test_cf_fixture(spark):
    i = spark.createDataFrame([("u1", "t1", 3.0), ("u1", "t2", 2.0), ("u2", "t2", 3.0), ("u2", "t3", 2.0), ("u3", "t2", 2.0), ("u3", "t3", 3.0)], INTER)
    top = cf_topk(i, item_neighbours(i), k=5)
    got = {}
    for r in top.collect():
        got.setdefault(r["user_id"], []).append(r["track_id"])
    assert got["u1"] == ["t3"] and not {"t2", "t3"} & set(got.get("u2", []))


def test_als_fixture(spark):
    i = spark.createDataFrame([("u1", "t1", 3.0), ("u1", "t2", 1.0), ("u2", "t2", 2.0), ("u2", "t3", 3.0), ("u3", "t3", 2.0), ("u3", "t4", 1.0)], INTER)
    users, tracks = fit_factors(i, rank=3, iterations=3)
    assert users.count() == 3 and tracks.count() == 4 and len(users.first()["factors"]) == 3
    got = {r["track_id"] for r in factor_topk(users, tracks, i, k=2).where("user_id = 'u1'").collect()}
    assert got == {"t3", "t4"}
    asked = spark.createDataFrame([("u1", "t1"), ("u1", "nope"), ("nobody", "t1")], "user_id string, track_id string")
    scores = {(r["user_id"], r["track_id"]): r["score"] for r in factor_scores(users, tracks, asked).collect()}
    assert scores[("u1", "nope")] == 0.0 and scores[("nobody", "t1")] == 0.0 and scores[("u1", "t1")] > 0.5


def _tracks(spark):
    rows = [("seed_1", 0.8, 0.8, 0.7, 120.0, "pop, dance pop"), ("seed_2", 0.78, 0.82, 0.72, 122.0, "pop"),
            ("close", 0.79, 0.81, 0.7, 121.0, "pop"), ("far", 0.2, 0.1, 0.2, 70.0, "ambient")]
    return spark.createDataFrame(rows, "track_id string, danceability double, energy double, valence double, tempo double, artist_genres string")


def test_content_fixture(spark):
    t = _tracks(spark)
    table, names = feature_table(t)
    assert "genre_pop" in names and "genre_dance_pop" in names
    features, names = content_features(t)
    m = np.array([r["features"] for r in features.collect()])
    assert np.allclose(m.mean(axis=0), 0) and set(np.round(m.std(axis=0), 6)) <= {0.0, 1.0}
    seeds = spark.createDataFrame([("u", "seed_1"), ("u", "seed_2"), ("u", "unknown")], "user_id string, track_id string")
    top = content_topk(features, seeds, len(names), k=2).collect()
    assert [r["track_id"] for r in top] == ["close"]
    asked = spark.createDataFrame([("u", "close")], "user_id string, track_id string")
    why = content_explain(features, names, seeds, asked, top_n=3).collect()
    assert len(why) == 3 and [r["rank"] for r in why] == [1, 2, 3]
    seen = spark.createDataFrame([("u", "close")], "user_id string, track_id string")
    assert content_topk(features, seeds, len(names), k=2, seen=seen).count() == 0


def test_hybrid_blend_and_cold_start(spark):
    c = "user_id string, track_id string"
    s = c + ", score double"
    cands = spark.createDataFrame([("u", x) for x in "abc"] + [("cold", x) for x in "abc"], c)
    cf = spark.createDataFrame([("u", "b", 0.9), ("u", "c", 0.2)], s)
    content = spark.createDataFrame([("u", "a", 0.8), ("u", "b", 0.4), ("u", "c", 0.1)], s)
    prior = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.9)], "track_id string, popularity_prior double")
    table = component_table(cands, prior, collaborative=cf, content=content)
    top = hybrid(table, Weights(1.0, 0.5), k=2).where("user_id = 'u'").orderBy("rank").collect()
    assert [r["track_id"] for r in top] == ["b", "a"] and top[0]["collaborative"] == 1.0
    assert top[0]["content"] == pytest.approx(0.428571428) and not top[0]["cold_start"]
    cold = hybrid(table, Weights(1.0, 1.0, 0.0, 1.0), k=1).where("user_id = 'cold'").collect()
    assert cold[0]["track_id"] == "c" and cold[0]["cold_start"]


def test_advanced_blend_flips(spark):
    s = "user_id string, track_id string, score double"
    base = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 0.9)], s)
    als = spark.createDataFrame([("u", "a", 0.1), ("u", "b", 0.9)], s)
    out = advanced_blend(base, BlendWeights(0.1, 1.0, 1.0), als=als, embedding=als, k=2).orderBy("rank").collect()
    assert [r["track_id"] for r in out] == ["b", "a"] and out[0]["signals"] == ["als", "embedding"] and out[1]["signals"] == []
    same = spark.createDataFrame([("u", "a", 0.5), ("u", "b", 0.5)], s)
    assert {r["als_score"] for r in optional_blend(base, als=same).collect()} == {0.0}
    assert optional_blend(base) is base


def test_exploration_weights():
    assert exploration_weights(0.0) == Weights(1.4, 1.2, 0.2, 0.35, 0.2)
    w = candidate_weights(5.0)
    assert (w.collaborative, w.popularity_prior) == (0.0, 0.0) and w.content == pytest.approx(1.15) and w.discovery == pytest.approx(1.3)
    assert Weights.of({"content": 2, "other": 1}).content == 2.0


def _pairs(spark, sequences):
    rows = [(g, p, t) for g, seq in enumerate(sequences) for p, t in enumerate(seq)]
    return C.cooccurrence(spark.createDataFrame(rows, "group_id long, pos long, track_id string"))


def test_context_similarity(spark):
    pairs = _pairs(spark, [["seed", "near", "other"], ["seed", "near", "far"]])
    vectors = C.truncated_svd(C.ppmi(pairs), dim=4)
    seeds = spark.createDataFrame([("u", "seed")], "user_id string, track_id string")
    asked = spark.createDataFrame([("u", x) for x in ("near", "far", "missing")], "user_id string, track_id string")
    size = len(vectors.first()["vector"])
    got = {r["track_id"]: r["score"] for r in C.context_scores(pairs, vectors, seeds, asked, size).collect()}
    assert got["near"] > got["far"] and got["missing"] == 0.0
    assert C.similar_tracks(pairs, vectors, k=1).count() >= 3


def test_truncated_svd_matches_numpy(spark):
    rng = np.random.default_rng(5)
    n = 40
    base = rng.normal(size=(n, 4))
    dense = np.maximum(base @ base.T, 0.0)
    rows = [(i, j, float(dense[i, j])) for i in range(n) for j in range(n) if dense[i, j] > 0]
    out = C.truncated_svd(spark.createDataFrame(rows, "a long, b long, v double"), dim=4, oversample=10, max_rounds=12)
    got = np.array([r["vector"] for r in out.orderBy("track_id").collect()])
    u, s, _ = np.linalg.svd(dense)
    want = u[:, :4] * np.sqrt(s[:4])
    assert np.allclose((got**2).sum(axis=0), s[:4], rtol=1e-6)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)


def test_truncated_svd_on_a_flat_spectrum(spark):
    rng = np.random.default_rng(0)
    n = 240
    upper = np.triu((rng.random((n, n)) < 0.1) * np.abs(rng.normal(size=(n, n))), 1)
    dense = upper + upper.T
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    out = C.truncated_svd(spark.createDataFrame(rows, "a long, b long, v double"), dim=6, oversample=6)
    got = np.array([r["vector"] for r in out.orderBy("track_id").collect()])
    sizes = (got**2).sum(axis=0)
    true = np.linalg.eigvalsh(dense)
    assert np.allclose(sizes, sorted(np.abs(true), reverse=True)[:6], rtol=1e-6)
    q = got / np.sqrt(sizes)
    signed = np.einsum("ij,ij->j", q, dense @ q)
    assert np.max(np.linalg.norm(dense @ q - q * signed, axis=0) / sizes) < 1e-5


def test_clusters_and_projection(spark):
    assert [cluster_count(n) for n in (1, 3, 9, 400)] == [1, 1, 3, 4]
    v = spark.createDataFrame([(i, [float(i % 2) * 10, float(i), 1.0]) for i in range(8)], "track_id long, features array<double>")
    labels = {r["track_id"]: r["cluster_id"] for r in kmeans_labels(v, clusters=2).collect()}
    assert len(labels) == 8 and len(set(labels.values())) == 2
    xy = np.array([[r["x"], r["y"]] for r in project_2d(v).orderBy("track_id").collect()])
    m = np.array([[float(i % 2) * 10, float(i), 1.0] for i in range(8)])
    m -= m.mean(axis=0)
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(np.abs(xy), np.abs(m @ vt[:2].T))
