"""A listener's own map against the plain rule, one listener at a time."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import profile as T
from cadenza.operators import taste_map as TM

ROWS = "user_id string, track_id long, danceability double, energy double, tempo double, artist_genres string, artist_name string, track_name string, is_recent boolean, place long"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("map_order", F.struct(F.lit(0).alias("source"), F.col("place").alias("pos")))


def plain_map(rows):
    """(coordinates without sign, clusters) of one listener by separate steps."""
    counts = {}
    tokens = [sorted({g.strip().lower().replace(" ", "_") for g in r[5].split(",") if g.strip()}) for r in rows]
    for t in tokens:
        for g in t:
            counts[g] = counts.get(g, 0) + 1
    genres = sorted(counts, key=lambda g: (-counts[g], g))[:20]
    x = np.array([[r[2], r[3], r[4], *(float(g in t) for g in genres)] for r, t in zip(rows, tokens)])
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread <= 1e-12 * np.maximum(1, abs(x.mean(axis=0))), 1, spread)
    at = z @ np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][:2].T
    n = len(rows)
    k = min(4, int(np.sqrt(n)))
    centre = z[[int(j * (n - 1) / max(1, k - 1)) if k > 1 else 0 for j in range(k)]].copy()
    label = np.zeros(n, int)
    for _ in range(20):
        new = np.linalg.norm(z[:, None] - centre[None], axis=2).round(9).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centre[c] = z[label == c].mean(axis=0)
    return at, label


def listeners(seed=4):
    rng = np.random.default_rng(seed)
    out = {}
    for u, n in enumerate([1, 2, 3, 4, 9, 15, 16, 17, 60, 130]):
        style = rng.normal(size=(3, 3))
        rows = []
        for i in range(n):
            a = style[rng.integers(3)] + 0.2 * rng.normal(size=3)
            genres = ", ".join(rng.choice([f"Genre {g:02d}" for g in range(30)], rng.integers(0, 4), replace=False))
            rows.append((f"u{u}", 1000 * u + i, float(a[0]), float(a[1]), float(a[2]), genres, f"Artist {rng.integers(4)}", f"t{i}", bool(i % 3 == 0), i))
        out[f"u{u}"] = rows
    out["same"] = [("same", 10 + i, 0.5, 0.5, 100.0, "pop", "A", "t", True, i) for i in range(9)]
    return out


def check(spark, users, **options):
    rows = table(spark, [r for rs in users.values() for r in rs]).repartition(3)
    got = {}
    for r in TM.listener_maps(TM.listener_features(rows), **options).collect():
        got.setdefault(r["user_id"], {})[r["track_id"]] = r
    assert set(got) == {u for u, rs in users.items() if len(rs) >= 3}
    for u, mine in got.items():
        at, label = plain_map(users[u])
        assert [mine[r[1]]["cluster_id"] for r in users[u]] == label.tolist(), u
        for name, want in zip("xy", at.T):
            have = np.array([mine[r[1]][name] for r in users[u]])
            assert min(abs(have - want).max(), abs(have + want).max()) < 1e-6, (u, name)
    return rows


def test_maps_of_many_listeners(spark):
    check(spark, listeners())
    check(spark, listeners(5), cells=2000)  # one or a few listeners a tensor


def test_one_listener_with_most_rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # the long one comes in many batches
    try:
        rng = np.random.default_rng(1)
        users = {"a": [("a", i, float(rng.normal()), float(rng.normal()), 1.0, "pop", "A", "t", False, i) for i in range(1500)], **listeners()}
        check(spark, users)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_profile_row(spark):
    users = listeners()
    rows = table(spark, [r for rs in users.values() for r in rs])
    maps = TM.listener_maps(TM.listener_features(rows))
    recent = spark.createDataFrame([("u3", "Own, Other"), ("u3", "Own")], "user_id string, artist_name string")
    candidates = spark.createDataFrame([("u4", "Candidate")], "user_id string, artist_name string")
    got = {r["user_id"]: r for r in TM.own_taste_profile(rows, maps, recent, candidates).collect()}
    assert got["u1"]["cluster_label"] == "Not enough data" and got["u1"]["cluster_id"] is None and got["u1"]["warning"] == TM.WARNING
    assert got["u3"]["top_artists"] == ["Own", "Other"] and got["u4"]["top_artists"] == ["Candidate"] and got["u3"]["warning"] is None
    assert got["same"]["top_artists"] == ["A"] and got["same"]["top_genres"] == ["Pop"] and got["same"]["cluster_label"] == "Pop Familiarity"
    _, label = plain_map(users["u8"])
    votes = [c for c, r in zip(label, users["u8"]) if r[8]]
    assert got["u8"]["cluster_id"] == min(set(votes), key=lambda c: (-votes.count(c), c))
    assert TM.own_taste_points(rows, maps).count() == sum(len(r) for r in users.values() if len(r) >= 3)


def test_order_of_profile_rows(spark):
    recent = spark.createDataFrame([("u", 5, 1), ("u", 6, 0)], "user_id string, track_id long, pos int")
    candidates = spark.createDataFrame([("u", 6, 0), ("u", 7, 2), ("u", 8, 1)], "user_id string, track_id long, candidate_pos int")
    rows = T.profile_rows(recent, candidates, recent.select("user_id", "track_id"))
    assert [r["track_id"] for r in rows.orderBy("map_order").collect()] == [6, 5, 8, 7]
