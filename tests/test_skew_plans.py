"""Plans for hot keys against brute force, with limits so small that every path is used."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.operators.neighbours import cf_topk, item_neighbours
from cadenza.operators.similarity import cosine_topk
from cadenza.operators.context import build_sequences, cooccurrence
from cadenza.plans.skew import dense_index, positions_by_time, salted_join
from cadenza.plans.tiles import HELD_BYTES, HELD_ITEMS, _cells, inner_products


def _hot_interactions():
    rng = random.Random(7)
    rows = {}
    for item in range(40):
        rows[("hot", item)] = rng.randint(1, 5)  # one user holds a third of all rows
    for user in range(30):
        for item in rng.sample(range(40), 3):
            rows[(f"u{user}", item)] = rng.randint(1, 5)
    return rows


def _brute_neighbours(rows, k):
    norm = defaultdict(float)
    for (_, i), v in rows.items():
        norm[i] += v * v
    by_user = defaultdict(dict)
    for (u, i), v in rows.items():
        by_user[u][i] = v / math.sqrt(norm[i])
    sims = defaultdict(lambda: defaultdict(float))
    for items in by_user.values():
        for a in items:
            for b in items:
                if a != b:
                    sims[a][b] += items[a] * items[b]
    return {
        a: sorted(((b, s) for b, s in near.items() if s != 0), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        for a, near in sims.items()
    }


@pytest.mark.parametrize("piece_tracks,held", [(512, 4_000_000), (5, 4_000_000), (5, 10), (1, 7)])
@pytest.mark.parametrize("signs", [(1,), (1, -1)])
def test_item_neighbours_of_pieces(spark, piece_tracks, held, signs):
    rows = {key: v * signs[n % len(signs)] for n, (key, v) in enumerate(_hot_interactions().items())}
    df = spark.createDataFrame([(u, i, float(v)) for (u, i), v in rows.items()], "user_id string, track_id long, interaction_strength double")
    got = defaultdict(list)
    out = item_neighbours(df, k=6, piece_tracks=piece_tracks, held=held)
    for r in out.collect():
        got[r["track_id"]].append((r["neighbour_id"], r["similarity"]))
    want = _brute_neighbours(rows, 6)
    assert set(got) == set(want)
    for a in want:
        have = sorted(got[a], key=lambda x: (-round(x[1], 9), x[0]))
        assert [b for b, _ in have] == [b for b, _ in want[a]]
        assert [s for _, s in have] == pytest.approx([s for _, s in want[a]])


@pytest.mark.parametrize("step,piece_tracks", [(3, 5), (40, 5), (1_000_000, 512)])
def test_whole_lists_of_neighbours_leave_their_slot_ranked(spark, monkeypatch, step, piece_tracks):
    """Lists were grouped and ranked again behind two more shuffles; a slot's sums were all held at once."""
    monkeypatch.setattr("cadenza.operators.neighbours.STEP_PRODUCTS", step)
    rows = _hot_interactions()
    df = spark.createDataFrame([(u, i, float(v)) for (u, i), v in rows.items()], "user_id string, track_id long, interaction_strength double")
    out = item_neighbours(df, k=6, piece_tracks=piece_tracks)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Window" not in above and "Repartition" not in above
    got = defaultdict(list)
    for r in out.collect():
        got[r["track_id"]].append((r["neighbour_id"], r["similarity"]))
    for a, want in _brute_neighbours(rows, 6).items():
        have = sorted(got[a], key=lambda x: (-round(x[1], 9), x[0]))
        assert [b for b, _ in have] == [b for b, _ in want]
        assert [s for _, s in have] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize("piece_entries", [4096, 3])
def test_cf_topk_every_path(spark, piece_entries):
    rows = _hot_interactions()
    del rows[("hot", 3)], rows[("hot", 4)]
    df = spark.createDataFrame([(u, i, float(v)) for (u, i), v in rows.items()], "user_id string, track_id long, interaction_strength double")
    near = item_neighbours(df, k=6)
    got = defaultdict(list)
    for r in cf_topk(df, near, k=4, piece_entries=piece_entries).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append((r["track_id"], r["score"]))
    lists = _brute_neighbours(rows, 6)
    for user in {u for u, _ in rows}:
        own = {i: v for (u, i), v in rows.items() if u == user}
        score = defaultdict(float)
        for i, v in own.items():
            for j, s in lists.get(i, []):
                if j not in own:
                    score[j] += v * s
        want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        assert [t for t, _ in got[user]] == [t for t, _ in want]
        assert [s for _, s in got[user]] == pytest.approx([s for _, s in want])


def test_tiles_equal_brute_force_with_exclusions(spark):
    rng = random.Random(3)
    vec = {f"i{n}": [rng.uniform(-1, 1) for _ in range(5)] for n in range(60)}
    df = spark.createDataFrame(list(vec.items()), "item string, v array<double>")
    q = df.withColumnRenamed("item", "query")
    banned = [(f"i{n}", f"i{(n * 7) % 60}") for n in range(60)]
    ex = spark.createDataFrame(banned, "query string, item string")
    out = inner_products(q, df, query="query", item="item", vector="v", k=5, floor=0.0, exclude=ex, exclude_self=True, tile_rows=9)
    got = defaultdict(list)
    for r in out.orderBy("query", "rank").collect():
        got[r["query"]].append(r["item"])
    for a, va in vec.items():
        scores = [(b, sum(x * y for x, y in zip(va, vb))) for b, vb in vec.items() if b != a and (a, b) not in banned]
        want = [b for b, s in sorted(((b, s) for b, s in scores if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[:5]]
        assert got[a] == want


@pytest.mark.parametrize("held_bytes,held_items,tile_rows", [(1 << 20, 1 << 20, 1024), (2000, 30, 4), (400, 7, 64)])
def test_cells_of_any_size_equal_brute_force(spark, held_bytes, held_items, tile_rows):
    rng = random.Random(5)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(4)]  # noqa: E731 - many equal scores
    queries, items = [(n, vec()) for n in range(50)], [(n, vec()) for n in range(300)]
    banned = {(rng.randrange(50), rng.randrange(300)) for _ in range(2000)}
    q, i = spark.createDataFrame([*queries, (None, vec())], "q long, v array<double>"), spark.createDataFrame([*items, (None, [0.0] * 4), (301, None)], "i long, v array<double>")
    ex = spark.createDataFrame([*banned, (None, 3), (4, None)], "q long, i long")
    for k in (7, None):
        out = inner_products(q, i, query="q", item="i", vector="v", k=k, floor=0.0, exclude=ex, tile_rows=tile_rows, held_bytes=held_bytes, held_items=held_items)
        got = defaultdict(list)
        for r in out.collect():
            got[r["q"]].append((r["i"], r["score"]))
        assert len(got[None]) > 0
        for a, va in queries:
            want = sorted(((b, s) for b, vb in items if (a, b) not in banned and (s := sum(x * y for x, y in zip(va, vb))) > 0), key=lambda x: (-x[1], x[0]))[:k]
            assert sorted(got[a], key=lambda x: (-x[1], x[0])) == want


def test_rows_of_large_products_are_sent_to_few_cells(spark):
    """Sets of 2,048 rows would send 900,000 queries 586 times."""
    q_sets, i_sets = _cells(900_000, 1_200_000, 29, 10, 32, HELD_BYTES, HELD_ITEMS)
    assert q_sets * i_sets >= 32 and 900_000 * i_sets + 1_200_000 * q_sets < 20_000_000
    q_sets, i_sets = _cells(5_400_000, 7_200_000, 29, 10, 32, HELD_BYTES, HELD_ITEMS)
    assert 5_400_000 / q_sets * (29 * 8 + 240) <= HELD_BYTES and 7_200_000 / i_sets <= HELD_ITEMS
    assert 5_400_000 * i_sets + 7_200_000 * q_sets < 250_000_000


def test_cosine_include_self_and_zero_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0])], "track_id long, features array<double>")
    rows = {(r["track_a"], r["track_b"]): r["similarity"] for r in cosine_topk(df, k=3, include_self=True).collect()}
    assert rows[(1, 1)] == pytest.approx(1.0) and rows[(1, 2)] == pytest.approx(1.0) and rows[(3, 1)] == 0.0


def test_positions_of_a_hot_user(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 500), t) for t in range(300)] + [("a", 5, 1), ("a", 5, 0), ("b", None, 9)]
    df = spark.createDataFrame(rows, "user string, sec int, track int").selectExpr("user", "timestamp_seconds(sec) AS ts", "track")
    out = positions_by_time(df, "user", "ts", ["track"], parts=16)
    got = {(r["user"], r["ts"], r["track"]): r["pos"] for r in out.collect()}
    assert len(got) == len(set(rows))
    for user in ("hot", "a", "b"):
        mine = sorted((k for k in got if k[0] == user), key=lambda k: (k[1] is not None, k[1], k[2]))
        assert [got[k] for k in mine] == list(range(len(mine)))


def test_a_burst_at_one_time_is_spread_over_tasks(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 4).selectExpr("'hot' AS user", "timestamp_seconds(CASE WHEN id < 24000 THEN 7 ELSE id END) AS ts", "id % 20000 AS track")
    out = positions_by_time(rows.unionByName(spark.sql("SELECT cast(null AS string) AS user, timestamp_seconds(1) AS ts, 3L AS track")), "user", "ts", ["track"], parts=12)
    got = out.where("user = 'hot'").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(30_000))
    assert [(r["ts"], r["track"]) for r in got] == sorted((r["ts"], r["track"]) for r in got)
    assert out.where("user IS NULL").first()["pos"] == 0
    out.write.parquet(str(tmp_path / "p"))  # ranges keep their size
    sizes = spark.read.parquet(str(tmp_path / "p")).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) < 10_000


def test_cooccurrence_across_chunks(spark):
    rng = random.Random(2)
    seq = [rng.randint(0, 6) for _ in range(50)]
    df = spark.createDataFrame([("g", p, t) for p, t in enumerate(seq)], "group_id string, pos long, track_id long")
    want = defaultdict(float)
    for p, a in enumerate(seq):
        for q in range(max(0, p - 2), min(len(seq), p + 3)):
            if q != p:
                want[(a, seq[q])] += 1.0 / abs(p - q)
    for chunk in (4096, 4, 2):
        got = {(r["track_id"], r["context_id"]): r["weight"] for r in cooccurrence(df, chunk_rows=chunk).collect()}
        assert got == pytest.approx(dict(want))


def test_dense_index_and_salted_join(spark):
    df = spark.createDataFrame([(f"k{i % 37}", i) for i in range(200)], "k string, v int")
    idx = dense_index(df, "k", buckets=8)
    assert sorted(r["idx"] for r in idx.collect()) == list(range(37))
    for salts in (1, 5):
        joined = salted_join(df, idx, "k", spread=["v"], salts=salts)
        assert joined.count() == 200 and joined.where("idx IS NULL").count() == 0


def test_a_hot_key_is_split_by_its_measured_size(spark, tmp_path):
    """One key holds a third of the rows; with small thresholds no task of the join gets them all."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 90_000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "sha2(cast(id AS string), 256) AS v")
        keys = facts.select("k").distinct().selectExpr("k", "k AS w")
        salted_join(facts, keys, "k", spread=["v"], how="inner").write.parquet(str(tmp_path / "joined"))  # a file for each task
        sizes = spark.read.parquet(str(tmp_path / "joined")).groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in sizes) == 90_000 and max(r["count"] for r in sizes) < 30_000  # the key alone has 30,000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sequences_from_playlist_positions(spark):
    df = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, " "), ("q", 1, "c")], "playlist string, n int, track_id string")
    out = build_sequences(df, playlist="playlist", position="n")
    assert sorted((r["group_id"], r["pos"], r["track_id"]) for r in out.collect()) == [("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")]
