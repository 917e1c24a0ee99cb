"""Factor scores in cells: every candidate once, unknown ids zero, and no cap on the candidates of a listener."""

import datetime

import pytest
from pyspark.sql import functions as F

from cadenza.operators.factors import factor_scores
from cadenza.operators.neighbours import cf_scores, item_neighbours
from registry import all_queries
from registry import views as V


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
@pytest.mark.parametrize("held", [200, 1 << 20])
def test_scores_match_plain_products(spark, step, held):
    users = {u: [float(u + n) / 7 for n in range(3)] for u in range(9)}
    tracks = {f"t{t}": [float(t - n) / 5 for n in range(3)] for t in range(11)}
    asked = [(u, f"t{t}") for u in (0, 1, 5, 77, None) for t in (*range(10), 99)] + [(2, None), (0, "t1"), (0, "t1")]
    schema = "factors array<double>"
    got = factor_scores(
        spark.createDataFrame(list(users.items()), f"user_id long, {schema}"), spark.createDataFrame(list(tracks.items()), f"track_id string, {schema}"),
        spark.createDataFrame(asked, "user_id long, track_id string"), held_bytes=held, step=step,
    )

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):  # one after the other, as sum() does not
            total += x * y
        return total

    key = lambda r: (str(r[0]), str(r[1]))
    want = [(u, t, dot(users[u], tracks[t]) if u in users and t in tracks else 0.0) for u, t in asked]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_als_scores_has_every_unseen_candidate(spark, tmp_path):
    d, day = str(tmp_path), datetime.date(2024, 1, 1)
    n = 40
    spark.createDataFrame([(o, o % 5) for o in range(30)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    lines = [(o, (o * 7 + k * 3) % n, day, 1.0 + k) for o in range(30) for k in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate date, l_quantity double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    i = V.interactions(spark, d)
    want = {tuple(r) for r in cf_scores(i, item_neighbours(i)).select("user_id", "track_id").collect()}
    got = all_queries()["als_scores"](spark, d)
    rows = got.collect()
    assert {(r["user_id"], r["track_id"]) for r in rows} == want and len(rows) == len(want)
    assert got.groupBy("user_id").count().agg(F.max("count")).first()[0] > 10  # more than a list of ten
