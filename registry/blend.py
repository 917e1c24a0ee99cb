"""Hybrid blend, discovery, advanced blend."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.columns import unit
from cadenza.operators.candidates import base_pool, pool_candidates
from cadenza.operators.content import content_table, seed_profiles
from cadenza.operators.features import content_features
from cadenza.operators.hybrid import (
    BlendWeights, advanced_blend, candidate_universe, component_table, exploration_weights, hybrid, priors, user_history,
)
from cadenza.operators.neighbours import cf_scores, item_neighbours
from cadenza.operators.tiled_blend import tiled_lists
from registry import collaborative, content  # noqa: F401  (define the SQL views used below)
from registry import views as V
from registry.sql import view, with_views


def _tables(spark, d):
    i, t = V.once(V.interactions(spark, d)), V.once(V.curated(spark, d))
    features, names = content_features(t)
    features = V.once(features)
    pool = base_pool(t)
    candidates = content_table(features, i, len(names), pool, i)
    cf = V.once(cf_scores(i, item_neighbours(i), pool))
    return candidates, cf, component_table(candidates, priors(t), collaborative=cf)


def _blended(spark, d, k):
    """Pairs of users and unseen pool tracks with their blend, worked out in tiles; the best ``k`` of each user, or all."""
    i, t = V.once(V.interactions(spark, d)), V.once(V.curated(spark, d))
    features, names = content_features(t)
    features, pool = V.once(features), base_pool(t).select("track_id")
    profiles = seed_profiles(features, i, len(names)).select("user_id", unit(F.col("profile")).alias("content"))
    tracks = features.join(pool, "track_id", "left_semi").select("track_id", unit(F.col("features")).alias("content"))
    if k is None:
        profiles, tracks = profiles.where("content IS NOT NULL"), tracks.where("content IS NOT NULL")
        tracks = tracks.withColumn("copy", F.row_number().over(W.partitionBy("track_id").orderBy("content")) - 1)
    tracks = tracks.join(priors(t), "track_id", "left")
    cf = cf_scores(i, item_neighbours(i), pool)
    return tiled_lists(profiles, tracks, i.select("user_id", "track_id"), models=["hybrid"], weights=exploration_weights(0.35), k=k, collaborative=cf)


def hybrid_topk(spark, d):
    ranked = _blended(spark, d, 10)
    parts = ["score", "collaborative", "content", "novelty", "popularity_prior", "discovery"]
    return ranked.select(
        "user_id", "track_id", *[F.round(c, 6).alias(c) for c in parts], "cold_start", F.col("rank").cast("long").alias("rank")
    )


def discovery_scores(spark, d):
    return _blended(spark, d, None).where(F.col("discovery") > 0).select("user_id", "track_id", F.round("discovery", 6).alias("discovery"))


def advanced(spark, d):
    """The blend with item-neighbour scores in the place of ALS and content scores in that of embeddings."""
    candidates, cf, table = _tables(spark, d)
    full = hybrid(table, exploration_weights(0.35), k=None)
    content = candidates.where(F.col("content").isNotNull()).withColumnRenamed("content", "score")
    out = advanced_blend(full, BlendWeights(1.0, 0.3, 0.3), als=cf, embedding=content, k=10)
    return out.select(
        "user_id", "track_id", F.round("score", 6).alias("score"), F.round("als_score", 6).alias("als_score"),
        F.round("embedding_score", 6).alias("embedding_score"), F.array_join("signals", "|").alias("signals"),
        F.col("rank").cast("long").alias("rank"),
    )


def pool_unseen(spark, d):
    i, pool = V.interactions(spark, d), base_pool(V.tracks(spark, d))
    extra = V.seeds(spark, d)
    return pool_candidates(i, pool, i, extra).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("track_id").alias("checksum")
    )


def history(spark, d):
    """Seeds from the event plays, interactions from the orders: neither holds the other."""
    return user_history(V.event_plays(spark, d), V.interactions(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("tracks"))


def universe(spark, d):
    """Tracks of the event plays, of the orders and of the catalog."""
    return candidate_universe(V.event_plays(spark, d), V.interactions(spark, d), priors(V.tracks(spark, d)))


view("v_cand", """
  SELECT u.user_id, p.track_id, p.popularity FROM (SELECT DISTINCT user_id FROM v_interactions) u CROSS JOIN v_pool p
  WHERE NOT EXISTS (SELECT 1 FROM v_interactions i WHERE i.user_id = u.user_id AND i.track_id = p.track_id)
""")
view("v_comp", """
  SELECT c.user_id, c.track_id, f.score AS cf, CASE WHEN t.score > 0 THEN t.score END AS ct,
         c.popularity / 100.0::DOUBLE AS pp, 1.0::DOUBLE - c.popularity / 100.0::DOUBLE AS nv
  FROM v_cand c LEFT JOIN v_cf f USING (user_id, track_id) LEFT JOIN v_content_all t USING (user_id, track_id)
""")


def _norm(c: str) -> str:
    w = "OVER (PARTITION BY user_id)"
    return (
        f"CASE WHEN {c} IS NULL THEN 0.0::DOUBLE WHEN max({c}) {w} = min({c}) {w} THEN CASE WHEN {c} > 0 THEN 1.0::DOUBLE ELSE 0.0 END "
        f"ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"
    )


def hybrid_views(prefix: str, comp: str, weights: tuple) -> None:
    """Views <prefix>norm and <prefix>hybrid over a component view (user, track, cf, ct, pp, nv)."""
    view(f"{prefix}norm", f"""
      SELECT user_id, track_id, {_norm('cf')} AS cf, {_norm('ct')} AS ct, {_norm('pp')} AS pp, {_norm('nv')} AS nv,
             max(CASE WHEN cf IS NOT NULL OR ct IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 0 AS cold
      FROM {comp}""")
    a, b, c, e, f = (f"{w!r}::DOUBLE" for w in weights)
    view(f"{prefix}hybrid", f"""
      SELECT *, {a} * cf + {b} * ct + {c} * nv + {e} * pp + {f} * ds AS score FROM (
        SELECT *, CASE WHEN 0.5 * cf + 0.5 * ct > 0 AND nv > 0
                  THEN 2.0::DOUBLE * (0.5::DOUBLE * cf + 0.5::DOUBLE * ct) * nv / (0.5::DOUBLE * cf + 0.5::DOUBLE * ct + nv) ELSE 0.0 END AS ds
        FROM {prefix}norm) WHERE {a} * cf + {b} * ct + {c} * nv + {e} * pp + {f} * ds > 0""")


_w = exploration_weights(0.35)
WEIGHTS = (_w.collaborative, _w.content, _w.novelty, _w.popularity_prior, _w.discovery)
hybrid_views("v_h_", "v_comp", WEIGHTS)

QUERIES = {
    "hybrid_topk": hybrid_topk, "discovery_scores": discovery_scores, "advanced_blend": advanced,
    "pool_candidates": pool_unseen, "user_history": history, "candidate_universe": universe,
}
ORACLES = {
    "hybrid_topk": with_views("""
      SELECT user_id, track_id, round(score, 6) AS score, round(cf, 6) AS collaborative, round(ct, 6) AS content,
             round(nv, 6) AS novelty, round(pp, 6) AS popularity_prior, round(ds, 6) AS discovery, cold AS cold_start,
             row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
      FROM v_h_hybrid QUALIFY rank <= 10"""),
    "discovery_scores": with_views("SELECT user_id, track_id, round(ds, 6) AS discovery FROM v_h_hybrid WHERE ds > 0"),
    "advanced_blend": with_views("""
      , s AS (SELECT user_id, track_id,
        CASE WHEN cf IS NULL OR max(cf) OVER w = min(cf) OVER w THEN 0.0::DOUBLE ELSE (cf - min(cf) OVER w) / (max(cf) OVER w - min(cf) OVER w) END AS a,
        CASE WHEN ct IS NULL OR max(ct) OVER w = min(ct) OVER w THEN 0.0::DOUBLE ELSE (ct - min(ct) OVER w) / (max(ct) OVER w - min(ct) OVER w) END AS e
        FROM v_comp WINDOW w AS (PARTITION BY user_id)),
      b AS (SELECT user_id, track_id, a, e, score + 0.3::DOUBLE * a + 0.3::DOUBLE * e AS score FROM v_h_hybrid JOIN s USING (user_id, track_id))
      SELECT user_id, track_id, round(score, 6) AS score, round(a, 6) AS als_score, round(e, 6) AS embedding_score,
             concat_ws('|', CASE WHEN a > 0 THEN 'als' END, CASE WHEN e > 0 THEN 'embedding' END) AS signals,
             row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
      FROM b QUALIFY rank <= 10""").replace("\n,", ",", 1),
    "pool_candidates": with_views("""
      SELECT user_id, count(*) AS candidates, cast(sum(track_id) AS BIGINT) AS checksum FROM v_cand GROUP BY 1"""),
    "user_history": with_views("""
      SELECT user_id, count(*) AS tracks FROM (SELECT user_id, track_id FROM v_event_plays UNION SELECT user_id, track_id FROM v_interactions) GROUP BY 1"""),
    "candidate_universe": with_views("SELECT track_id FROM v_event_plays UNION SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part"),
}
