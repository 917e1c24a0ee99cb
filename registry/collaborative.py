"""Item neighbours, context co-occurrence, factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import context as C
from cadenza.operators.candidates import base_pool
from cadenza.operators.factors import factor_scores, factor_topk, fit_factors
from cadenza.operators.neighbours import cf_scores, cf_topk, item_neighbours
from registry import views as V
from registry.sql import view, with_views

view("v_x", """
  SELECT user_id, track_id, interaction_strength / sqrt(sum(interaction_strength * interaction_strength) OVER (PARTITION BY track_id)) AS x
  FROM v_interactions WHERE interaction_strength <> 0
""")
view("v_neighbours", """
  SELECT track_id, neighbour_id, similarity FROM (
    SELECT a.track_id, b.track_id AS neighbour_id, sum(a.x * b.x) AS similarity
    FROM v_x a JOIN v_x b ON a.user_id = b.user_id AND a.track_id <> b.track_id GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(similarity, 9) DESC, neighbour_id) <= 100
""")
view("v_cf", """
  SELECT i.user_id, n.neighbour_id AS track_id, sum(i.interaction_strength * n.similarity) AS score
  FROM v_interactions i JOIN v_neighbours n USING (track_id)
  WHERE NOT EXISTS (SELECT 1 FROM v_interactions s WHERE s.user_id = i.user_id AND s.track_id = n.neighbour_id)
  GROUP BY 1, 2 HAVING sum(i.interaction_strength * n.similarity) > 0
""")
view("v_pool", "SELECT track_id, popularity FROM v_tracks ORDER BY popularity DESC, track_id LIMIT 1000")
view("v_seq", """
  SELECT user_id AS group_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, track_id) - 1 AS pos FROM v_event_plays
""")
view("v_cooc", """
  SELECT a.track_id, b.track_id AS context_id, sum(1.0::DOUBLE / abs(a.pos - b.pos)) AS weight
  FROM v_seq a JOIN v_seq b ON a.group_id = b.group_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos
  GROUP BY 1, 2
""")
view("v_row_total", "SELECT track_id, sum(weight) AS t, max(weight) AS m FROM v_cooc GROUP BY 1")
view("v_direct", "SELECT track_id, context_id, weight / m AS score FROM v_cooc JOIN v_row_total USING (track_id)")


def _strengths(spark, d):
    """The interactions without their times, written once."""
    return V.once(V.interactions(spark, d).select("user_id", "track_id", "interaction_strength"))


def neighbours(spark, d):
    return item_neighbours(_strengths(spark, d)).select(
        "track_id", "neighbour_id", F.round("similarity", 6).alias("similarity")
    )


def _with_collector(spark, d):
    """The interactions and one more listener who holds every track of the catalog."""
    part = V.table(spark, d, "part").select(
        F.lit(0).cast("long").alias("user_id"), F.col("p_partkey").alias("track_id"), F.col("p_size").cast("double").alias("interaction_strength")
    )
    return V.interactions(spark, d).select("user_id", "track_id", "interaction_strength").unionByName(part)


def neighbours_heavy(spark, d):
    return item_neighbours(V.once(_with_collector(spark, d))).select("track_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


def cf_ranked(spark, d):
    i = _strengths(spark, d)
    top = cf_topk(i, item_neighbours(i), k=10)
    return top.select("user_id", "track_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def cf_pool(spark, d):
    i = _strengths(spark, d)
    top = cf_topk(i, item_neighbours(i), k=10, pool=base_pool(V.tracks(spark, d)))
    return top.select("user_id", "track_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _sequences(spark, d):
    return C.build_sequences(V.event_plays(spark, d))


def sequences(spark, d):
    return _sequences(spark, d)


def turn_sequences(spark, d):
    """Conversations as playlists: roles ordered by turn."""
    t = V.table(spark, d, "conversations").select(F.col("conv_id").alias("playlist_id"), "turn", F.col("role").alias("track_id"))
    return C.build_sequences(t, playlist="playlist_id", position="turn")


def common_sequences(spark, d):
    """Only tracks with at least 90 plays keep a place in the sequences."""
    return C.build_sequences(V.event_plays(spark, d), min_count=90)


def _pairs(spark, d):
    return C.cooccurrence(_sequences(spark, d))


def cooccurrence(spark, d):
    return _pairs(spark, d).withColumn("weight", F.round("weight", 6))


def ppmi(spark, d):
    return C.ppmi(_pairs(spark, d)).withColumn("ppmi", F.round("ppmi", 6))


def context_direct(spark, d):
    return C.direct_context(_pairs(spark, d)).withColumn("score", F.round("score", 6))


def context_seeds(spark, d):
    seeds = V.event_plays(spark, d).select("user_id", "track_id").distinct()
    return C.seed_context(V.once(_pairs(spark, d)), V.once(seeds)).withColumn("score", F.round("score", 6))


def _vectors(spark, d, dim=16):
    return C.truncated_svd(C.ppmi(_pairs(spark, d)), dim=dim)


def context_similar(spark, d):
    return C.similar_tracks(_pairs(spark, d), _vectors(spark, d), k=10)


def context_candidates(spark, d):
    plays = V.event_plays(spark, d)
    seeds = V.once(plays.select("user_id", "track_id").distinct())
    pairs = V.once(_pairs(spark, d))
    candidates = V.once(V.interactions(spark, d))  # pairs of the orders, most of them unknown to the plays
    return C.context_scores(pairs, C.truncated_svd(C.ppmi(pairs), dim=8), seeds, candidates, 8)


def als_top(spark, d):
    i = _strengths(spark, d)
    users, tracks = fit_factors(i)
    return factor_topk(users, tracks, i, k=10)


def als_pairs(spark, d):
    i = _strengths(spark, d)
    users, tracks = fit_factors(i)
    unseen = cf_scores(i, item_neighbours(i))  # every unseen track with a positive score
    return factor_scores(users, tracks, unseen)


_CF_TOP = """
  SELECT user_id, track_id, round(score, 5) AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
  FROM v_cf {where} QUALIFY rank <= 10
"""
QUERIES = {
    "item_neighbours": neighbours, "item_neighbours_heavy": neighbours_heavy, "cf_topk": cf_ranked, "cf_pool_topk": cf_pool, "sequences": sequences,
    "turn_sequences": turn_sequences, "common_sequences": common_sequences, "cooccurrence": cooccurrence, "ppmi": ppmi,
    "context_direct": context_direct, "context_seeds": context_seeds, "context_similar": context_similar,
    "context_candidates": context_candidates, "als_topk": als_top, "als_scores": als_pairs,
}
ORACLES = {
    "item_neighbours": with_views("SELECT track_id, neighbour_id, round(similarity, 6) AS similarity FROM v_neighbours"),
    "item_neighbours_heavy": with_views("""
      , h AS (SELECT user_id, track_id, interaction_strength FROM v_interactions UNION ALL SELECT 0, p_partkey, cast(p_size AS DOUBLE) FROM part),
      x AS (SELECT user_id, track_id, interaction_strength / sqrt(sum(interaction_strength * interaction_strength) OVER (PARTITION BY track_id)) AS x
            FROM h WHERE interaction_strength <> 0)
      SELECT track_id, neighbour_id, round(similarity, 6) AS similarity FROM (
        SELECT a.track_id, b.track_id AS neighbour_id, sum(a.x * b.x) AS similarity
        FROM x a JOIN x b ON a.user_id = b.user_id AND a.track_id <> b.track_id GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(similarity, 9) DESC, neighbour_id) <= 100""").replace("\n,", ",", 1),
    "cf_topk": with_views(_CF_TOP.format(where="")),
    "cf_pool_topk": with_views(_CF_TOP.format(where="WHERE track_id IN (SELECT track_id FROM v_pool)")),
    "sequences": with_views("SELECT group_id, pos, track_id FROM v_seq"),
    "turn_sequences": """
      SELECT conv_id AS group_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, role AS track_id
      FROM conversations""",
    "common_sequences": with_views("""
      SELECT user_id AS group_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, track_id) - 1 AS pos, track_id
      FROM v_event_plays WHERE track_id IN (SELECT track_id FROM v_event_plays GROUP BY 1 HAVING count(*) >= 90)"""),
    "cooccurrence": with_views("SELECT track_id, context_id, round(weight, 6) AS weight FROM v_cooc"),
    "ppmi": with_views("""
      SELECT track_id, context_id, round(p, 6) AS ppmi FROM (
        SELECT c.track_id, c.context_id, ln(c.weight * (SELECT sum(weight) FROM v_cooc) / (r.t * k.t)) AS p
        FROM v_cooc c JOIN v_row_total r ON r.track_id = c.track_id JOIN v_row_total k ON k.track_id = c.context_id) WHERE p > 0"""),
    "context_direct": with_views("SELECT track_id, context_id, round(score, 6) AS score FROM v_direct"),
    "context_seeds": with_views("""
      , s AS (SELECT DISTINCT user_id, track_id FROM v_event_plays),
      n AS (SELECT user_id, count(*) AS n FROM s JOIN v_row_total USING (track_id) GROUP BY 1)
      SELECT user_id, context_id AS track_id, round(sum(score) / any_value(n), 6) AS score
      FROM s JOIN v_direct USING (track_id) JOIN n USING (user_id) GROUP BY 1, 2""").replace("\n,", ",", 1),
}
