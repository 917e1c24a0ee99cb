"""Pieces and tracks with many products are added up without a sort; shared tables are compressed and leave no shuffle behind."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.operators import neighbours as N
from cadenza.plans import sparse as S
from cadenza.session import CLEANUP, ensure_checkpoint_dir, written

_R = random.Random(11)
_ROWS = [(u, t, float(_R.randint(-2, 9))) for u in range(30) for t in _R.sample(range(60), 3 if u % 3 else 45)] + [(3, 5, 2.0), (3, 5, 2.0)]
_LISTS = {t: [(c, _R.uniform(-0.5, 1.0)) for c in _R.sample(range(80), 12)] for t in range(50)}


def _expected(k, exclude_self):
    sums, own = defaultdict(lambda: defaultdict(float)), defaultdict(set)
    for u, t, w in _ROWS:
        own[u].add(t)
        for c, v in _LISTS.get(t, []):
            sums[u][c] += w * v
    out = {}
    for u, row in sums.items():
        best = sorted((-round(s, 9), c) for c, s in row.items() if s > 0 and c not in own[u] and not (exclude_self and c == u))
        out.update({(u, c): round(-s, 6) for s, c in best[:k]})
    return out


@pytest.mark.parametrize("many", [1, 100])
@pytest.mark.parametrize("options", [{}, {"held_entries": 40, "piece_entries": 4}, {"step": 50}])
@pytest.mark.parametrize("k,exclude_self", [(5, True), (None, False)])
def test_long_pieces_match_plain_sums(spark, monkeypatch, many, options, k, exclude_self):
    monkeypatch.setattr(S, "MANY", many)
    rows = spark.createDataFrame(_ROWS, "row long, link long, weight double")
    packed = spark.createDataFrame([(t, c, v) for t, cells in _LISTS.items() for c, v in cells], "link long, col long, v double")
    lists = packed.groupBy("link").agg(F.collect_list(F.struct("col", "v")).alias("cells"))
    got = S.sparse_product(rows, lists, k=k, exclude_links=True, exclude_self=exclude_self, **options).collect()
    assert len(got) == len({(r["row"], r["col"]) for r in got})
    assert {(r["row"], r["col"]): round(r["score"], 6) for r in got} == _expected(k, exclude_self)


@pytest.mark.parametrize("many,held", [(1, 4_000_000), (30, 4_000_000), (1, 50)])
def test_tracks_with_many_products_match_plain_sums(spark, monkeypatch, many, held):
    monkeypatch.setattr(N, "MANY", many)
    monkeypatch.setattr(N, "FILLED", 1e9)  # never in whole rows
    rows = {(u, t): float(_R.choice([-3, 1, 2, 4])) for u in range(25) for t in _R.sample(range(40), 12)}
    df = spark.createDataFrame([(u, t, v) for (u, t), v in rows.items()], "user_id long, track_id long, interaction_strength double")
    norm, sums = defaultdict(float), defaultdict(lambda: defaultdict(float))
    for (u, t), v in rows.items():
        norm[t] += v * v
    for (u, a), x in rows.items():
        for (w, b), y in rows.items():
            if u == w and a != b:
                sums[a][b] += x * y / (norm[a] * norm[b]) ** 0.5
    got = defaultdict(dict)
    for r in N.item_neighbours(df, k=6, held=held).collect():
        got[r["track_id"]][r["neighbour_id"]] = round(r["similarity"], 6)
    want = {a: sorted((-round(s, 9), b) for b, s in near.items() if round(s, 12) != 0)[:6] for a, near in sums.items()}
    assert got == {a: {b: round(-s, 6) for s, b in best} for a, best in want.items()}


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_shared_tables_are_compressed(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    df = spark.range(200_000).select((F.col("id") % 500).alias("user_id"), F.col("id").alias("track_id"), (F.col("id") % 9).cast("double").alias("x"))
    before, own = _bytes(folder), spark.conf.get(CLEANUP)
    out = written(df.repartition(4, "user_id"))
    assert _bytes(folder) - before < 200_000 * 12  # a checkpoint's rows take 36 bytes each
    assert out.schema == df.schema or [f.name for f in out.schema] == df.columns
    assert out.count() == 200_000 and out.agg(F.sum("x")).first()[0] == df.agg(F.sum("x")).first()[0]
    assert spark.conf.get(CLEANUP) == own
    assert written(spark.range(3).select("id", F.lit(None).alias("nothing"))).count() == 3  # a type that Parquet lacks
