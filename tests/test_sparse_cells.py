"""History x lists in cells: a list is sent once for each set of rows, whatever the number of cells, pieces and steps."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import context as C
from cadenza.plans.sparse import _sets, sparse_product

_R = random.Random(5)
_ROWS = [(u, t, float(_R.randint(-2, 9))) for u in range(40) for t in _R.sample(range(60), 1 if u % 7 else 45)] + [(3, 5, 2.0), (3, 5, 2.0)]
_LISTS = {t: [(c, _R.uniform(-0.5, 1.0)) for c in _R.sample(range(80), 12)] for t in range(50)}


def _expected(k):
    sums, own = {}, {}
    for u, t, w in _ROWS:
        own.setdefault(u, set()).add(t)
        for c, v in _LISTS.get(t, []):
            sums.setdefault(u, {})[c] = sums.get(u, {}).get(c, 0.0) + w * v
    out = {}
    for u, row in sums.items():
        best = sorted(((-round(s, 9), c) for c, s in row.items() if s > 0 and c not in own[u]))
        out.update({(u, c): round(-s, 6) for s, c in best[:k]})
    return out


@pytest.mark.parametrize("options", [{}, {"held_entries": 40}, {"held_entries": 40, "piece_entries": 4, "step": 10}, {"step": 7}])
@pytest.mark.parametrize("k", [5, None])
def test_cells_pieces_and_steps(spark, options, k):
    rows = spark.createDataFrame([*_ROWS, (None, 1, 1.0), (1, None, 1.0)], "row long, link long, weight double")
    flat = [(t, c, v) for t, cells in _LISTS.items() for c, v in cells]
    packed = spark.createDataFrame(flat, "link long, col long, v double")
    # Several lists for a link, and a link without any.
    lists = packed.groupBy("link", F.col("col") % 2).agg(F.collect_list(F.struct("col", "v")).alias("cells")).select("link", "cells")
    got = sparse_product(rows, lists, k=k, exclude_links=True, **options).collect()
    assert len(got) == len({(r["row"], r["col"]) for r in got})
    assert {(r["row"], r["col"]): round(r["score"], 6) for r in got} == _expected(k)


def test_a_list_is_not_sent_once_for_each_link():
    """36 million links to lists of 100: well under a third of the entries that one list for each link takes."""
    links, users, entries = 36_000_000, 900_000, 120_000_000
    r_sets, c_sets = _sets(links, users, entries, 10, 48, 8_000_000)
    assert r_sets * c_sets >= 48 and entries / c_sets <= 8_000_000
    assert c_sets * links + r_sets * entries < 100 * links / 3


def test_seed_context_makes_no_row_for_a_seed_and_a_context(spark):
    n = 60
    pairs = spark.range(n * n).select((F.col("id") % n).alias("track_id"), F.floor(F.col("id") / n).cast("long").alias("context_id"), (F.col("id") % 7 + 1.0).alias("weight"))
    seeds = spark.range(20 * n).select((F.col("id") % 20).alias("user_id"), F.floor(F.col("id") / 20).cast("long").alias("track_id"))
    out = C.seed_context(pairs, seeds)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(score" not in plan  # the lists have been added up where they are held
    score = {t: {c: (n * c + t) % 7 + 1.0 for c in range(n)} for t in range(n)}
    mean = {c: sum(score[t][c] / max(score[t].values()) for t in range(n)) / n for c in range(n)}
    got = out.collect()
    assert len(got) == 20 * n and all(abs(r["score"] - mean[r["track_id"]]) < 1e-9 for r in got)
