"""Holdout splits, ranking metrics, beyond-accuracy metrics, model benchmarks, streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import evaluate as E
from cadenza.operators.benchmark import ALL_MODELS, CORE_MODELS, RERANKED, pool_benchmark
from cadenza.operators.candidates import base_pool
from cadenza.operators.content import content_topk
from cadenza.operators.features import content_features
from cadenza.operators.hybrid import exploration_weights
from cadenza.operators.neighbours import cf_topk, item_neighbours
from cadenza.operators.similarity import list_pair_cosine
from registry import views as V
from registry.blend import WEIGHTS, hybrid_views
from registry.sql import dot, view, with_views


def holdout_time(spark, d):
    s = E.holdout(V.interactions(spark, d), n=1, min_interactions=5, by="time")
    return s.select("user_id", "track_id", "is_test")


def holdout_strength(spark, d):
    s = E.holdout(V.interactions(spark, d), n=2, min_interactions=2)
    return s.select("user_id", "track_id", "is_test")


def candidate_pool(spark, d):
    return base_pool(V.tracks(spark, d)).withColumn("popularity", F.round("popularity", 6))


def train_pool(spark, d):
    s = E.holdout(V.interactions(spark, d), n=1, min_interactions=5, by="time").where(~F.col("is_test"))
    return E.restrict_to_pool(s, base_pool(V.tracks(spark, d))).select("user_id", "track_id")


def _cf_lists(spark, d):
    s = V.once(E.holdout(V.once(V.interactions(spark, d)), n=3, min_interactions=5, by="time"))
    train, test = s.where(~F.col("is_test")), s.where("is_test")
    return cf_topk(train, item_neighbours(train), k=10), test


def ranking_metrics(spark, d):
    ranked, test = _cf_lists(spark, d)
    m = E.ranking_metrics(ranked, test, k=10)
    return m.select("user_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "map")])


def list_quality(spark, d):
    """Diversity, novelty and popularity bias of every user's content list."""
    i, t = V.once(V.interactions(spark, d)), V.once(V.curated(spark, d))
    features, names = content_features(t)
    features = V.once(features)
    ranked = V.once(content_topk(features, i, len(names), k=5))
    div = E.list_diversity(ranked, list_pair_cosine(ranked, features))
    nov = E.list_novelty(ranked, E.popularity_of(i))
    return div.join(nov, "user_id").select(
        "user_id", *[F.round(c, 6).alias(c) for c in ("diversity", "novelty", "popularity_bias")]
    )


def coverage(spark, d):
    i = V.once(V.interactions(spark, d))
    ranked = cf_topk(i, item_neighbours(i), k=10)
    return E.catalog_coverage(ranked, V.tracks(spark, d)).withColumn("coverage", F.round("coverage", 6))


def _benchmark(spark, d, models, **kw):
    i, t = V.once(V.interactions(spark, d)), V.once(V.curated(spark, d))
    features, names = content_features(t)
    return pool_benchmark(i, t, features, len(names), weights=exploration_weights(0.35), models=models, **kw)


def benchmark_core(spark, d):
    out = _benchmark(spark, d, CORE_MODELS)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")], "evaluated_users")


def benchmark_all(spark, d):
    return _benchmark(spark, d, ALL_MODELS)


def benchmark_strength(spark, d):
    """Eight models over the whole catalog, holdout by strength, k = 3, with the reranked model."""
    return _benchmark(spark, d, [*ALL_MODELS, RERANKED], k=3, min_interactions=2, by="strength", als_iterations=6, pool_size=None)


def benchmark_strength_core(spark, d):
    """The three models of the strength benchmark that SQL can state, over the whole catalog."""
    out = _benchmark(spark, d, CORE_MODELS, k=3, min_interactions=2, by="strength", pool_size=None)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")], "evaluated_users")


def weight_tuning(spark, d):
    out = E.weight_tuning(_benchmark(spark, d, CORE_MODELS))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "ndcg")})


def model_verdicts(spark, d):
    pairs = [("collaborative_only", "content_only"), ("hybrid", "content_only"), ("hybrid", "collaborative_only")]
    return E.model_verdicts(_benchmark(spark, d, CORE_MODELS), pairs)


def advanced_verdicts(spark, d):
    """The four comparisons of the advanced models."""
    return E.model_verdicts(_benchmark(spark, d, ALL_MODELS))


# --- SQL ------------------------------------------------------------------------------------------

view("v_split", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC NULLS LAST, interaction_strength DESC, track_id) AS place,
         count(*) OVER (PARTITION BY user_id) AS n FROM v_interactions QUALIFY n >= 5
""")
view("v_train", "SELECT user_id, track_id, interaction_strength FROM v_split WHERE place > 1")
view("v_test", "SELECT user_id, track_id FROM v_split WHERE place = 1")


def cf_views(prefix: str, source: str) -> None:
    view(f"{prefix}x", f"""
      SELECT user_id, track_id, interaction_strength / sqrt(sum(interaction_strength * interaction_strength) OVER (PARTITION BY track_id)) AS x
      FROM {source} WHERE interaction_strength <> 0""")
    view(f"{prefix}nb", f"""
      SELECT track_id, neighbour_id, similarity FROM (
        SELECT a.track_id, b.track_id AS neighbour_id, sum(a.x * b.x) AS similarity
        FROM {prefix}x a JOIN {prefix}x b ON a.user_id = b.user_id AND a.track_id <> b.track_id GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(similarity, 9) DESC, neighbour_id) <= 100""")
    view(f"{prefix}cf", f"""
      SELECT i.user_id, n.neighbour_id AS track_id, sum(i.interaction_strength * n.similarity) AS score
      FROM {source} i JOIN {prefix}nb n USING (track_id)
      WHERE NOT EXISTS (SELECT 1 FROM {source} s WHERE s.user_id = i.user_id AND s.track_id = n.neighbour_id)
      GROUP BY 1, 2""")


view("v_fit", "SELECT * FROM v_train WHERE track_id IN (SELECT track_id FROM v_pool)")
def benchmark_views(prefix: str, train: str, test: str, fit: str, pool: str, k: int) -> None:
    """Views of the three benchmark models: candidates, components, ranked lists, metrics per user."""
    cf_views(prefix, fit)
    view(f"{prefix}profile", f"SELECT user_id, list(z ORDER BY pos) AS v FROM (SELECT user_id, pos, avg(z) AS z FROM {train} JOIN v_z USING (track_id) GROUP BY 1, 2) GROUP BY 1")
    view(f"{prefix}unit", f"SELECT user_id, CASE WHEN {dot('v', 'v')} > 0 THEN [x / sqrt({dot('v', 'v')}) for x in v] ELSE v END AS u FROM {prefix}profile")
    view(f"{prefix}cand", f"""
      SELECT u.user_id, p.track_id FROM (SELECT DISTINCT user_id FROM {test}) u CROSS JOIN {pool} p
      WHERE NOT EXISTS (SELECT 1 FROM {train} i WHERE i.user_id = u.user_id AND i.track_id = p.track_id)
      UNION SELECT user_id, track_id FROM {test}
    """)
    view(f"{prefix}comp", f"""
      SELECT c.user_id, c.track_id, f.score AS cf, CASE WHEN {dot('pu.u', 'tu.u')} > 0 THEN {dot('pu.u', 'tu.u')} END AS ct,
             t.popularity / 100.0::DOUBLE AS pp, 1.0::DOUBLE - t.popularity / 100.0::DOUBLE AS nv
      FROM {prefix}cand c JOIN v_tracks t USING (track_id) JOIN {prefix}unit pu USING (user_id) JOIN v_unit tu USING (track_id)
      LEFT JOIN {prefix}cf f USING (user_id, track_id)
    """)
    hybrid_views(prefix, f"{prefix}comp", WEIGHTS)
    view(f"{prefix}lists", f"""
      SELECT 'content_only' AS model, user_id, track_id, ct AS score FROM {prefix}comp WHERE ct > 0
      UNION ALL SELECT 'collaborative_only', user_id, track_id, cf FROM {prefix}comp WHERE cf > 0
      UNION ALL SELECT 'hybrid', user_id, track_id, score FROM {prefix}hybrid
    """)
    view(f"{prefix}ranked", f"""
      SELECT model, user_id, track_id, row_number() OVER (PARTITION BY model, user_id ORDER BY round(score, 9) DESC, track_id) AS rank
      FROM {prefix}lists QUALIFY rank <= {k}
    """)
    view(f"{prefix}metrics", f"""
      SELECT m.model, u.user_id, coalesce(avg(CASE WHEN t.track_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (r.rank IS NOT NULL), 0.0) AS p,
             cast(count(t.track_id) AS DOUBLE) AS r, sum(CASE WHEN t.track_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / log2(r.rank + 1.0::DOUBLE) END) AS g
      FROM (SELECT DISTINCT model FROM {prefix}lists) m CROSS JOIN (SELECT DISTINCT user_id FROM {test}) u
      LEFT JOIN {prefix}ranked r ON r.model = m.model AND r.user_id = u.user_id
      LEFT JOIN {test} t ON t.user_id = r.user_id AND t.track_id = r.track_id GROUP BY 1, 2
    """)


benchmark_views("v_e_", "v_train", "v_test", "v_fit", "v_pool", 10)
view("v_split_s", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interaction_strength DESC, track_id) AS place,
         count(*) OVER (PARTITION BY user_id) AS n FROM v_interactions QUALIFY n >= 2
""")
view("v_train_s", "SELECT user_id, track_id, interaction_strength FROM v_split_s WHERE place > 1")
view("v_test_s", "SELECT user_id, track_id FROM v_split_s WHERE place = 1")
benchmark_views("v_es_", "v_train_s", "v_test_s", "v_train_s", "v_tracks", 3)
CORE_SQL = """
  SELECT model, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(g), 6) AS ndcg, count(*) AS evaluated_users
  FROM {prefix}metrics GROUP BY 1
"""
view("v_split3", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC NULLS LAST, interaction_strength DESC, track_id) AS place,
         count(*) OVER (PARTITION BY user_id) AS n FROM v_interactions QUALIFY n >= 5
""")
view("v_train3", "SELECT user_id, track_id, interaction_strength FROM v_split3 WHERE place > least(3, n - 1)")
view("v_test3", "SELECT user_id, track_id FROM v_split3 WHERE place <= least(3, n - 1)")
cf_views("v_m_", "v_train3")
view("v_m_ranked", """
  SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
  FROM v_m_cf WHERE score > 0 QUALIFY rank <= 10
""")
METRICS_SQL = """
  , h AS (SELECT r.user_id, r.rank, CASE WHEN t.track_id IS NULL THEN 0 ELSE 1 END AS hit,
                 sum(CASE WHEN t.track_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.user_id ORDER BY r.rank) AS so_far
          FROM v_m_ranked r LEFT JOIN v_test3 t USING (user_id, track_id)),
  l AS (SELECT user_id, count(*) AS len, sum(hit) AS hits, sum(hit / log2(rank + 1.0::DOUBLE)) AS dcg,
               sum(hit * so_far / cast(rank AS DOUBLE)) AS ap FROM h GROUP BY 1),
  s AS (SELECT user_id, count(*) AS rel, sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE)) AS ideal
        FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY track_id) AS i FROM v_test3) GROUP BY 1)
  SELECT user_id, round(coalesce(hits / cast(len AS DOUBLE), 0.0), 6) AS precision, round(coalesce(hits / cast(rel AS DOUBLE), 0.0), 6) AS recall,
         round(coalesce(dcg / ideal, 0.0), 6) AS ndcg, round(coalesce(ap / least(rel, len), 0.0), 6) AS map
  FROM s LEFT JOIN l USING (user_id)
"""
QUALITY_SQL = f"""
  , r AS (SELECT user_id, track_id FROM v_content_top WHERE rank <= 5),
  known AS (SELECT a.track_id AS x, b.track_id AS y, {dot('a.u', 'b.u')} AS s FROM v_unit a JOIN v_unit b ON a.track_id < b.track_id
            WHERE (a.track_id, b.track_id) IN (SELECT (p.track_id, q.track_id) FROM r p JOIN r q ON p.user_id = q.user_id)),
  dv AS (SELECT p.user_id, greatest(0.0, 1.0 - avg(coalesce(s, 0.0))) AS diversity
         FROM (SELECT a.user_id, a.track_id AS x, b.track_id AS y FROM r a JOIN r b ON a.user_id = b.user_id AND a.track_id < b.track_id) p
         LEFT JOIN known USING (x, y) GROUP BY 1),
  pop AS (SELECT track_id, sum(interaction_strength) / greatest((SELECT max(s) FROM (SELECT sum(interaction_strength) AS s FROM v_interactions GROUP BY track_id)), 1.0) AS p
          FROM v_interactions GROUP BY 1),
  nv AS (SELECT user_id, avg(-log2(least(greatest(coalesce(p, 1.0), 1e-12), 1.0))) AS novelty, avg(coalesce(p, 0.0)) AS popularity_bias
         FROM r LEFT JOIN pop USING (track_id) GROUP BY 1)
  SELECT user_id, round(diversity, 6) AS diversity, round(novelty, 6) AS novelty, round(popularity_bias, 6) AS popularity_bias
  FROM dv JOIN nv USING (user_id)
"""


def _chain(views: str, body: str) -> str:
    """Views used by ``views`` and ``body``, then the extra CTEs of ``body``."""
    head = with_views(f"SELECT 1 FROM {views}").rsplit("\nSELECT 1", 1)[0]
    return head + body


QUERIES = {
    "holdout_time": holdout_time, "holdout_strength": holdout_strength, "candidate_pool": candidate_pool,
    "train_pool": train_pool, "ranking_metrics": ranking_metrics, "list_quality": list_quality,
    "catalog_coverage": coverage, "benchmark_core": benchmark_core, "benchmark_all": benchmark_all,
    "benchmark_strength": benchmark_strength, "benchmark_strength_core": benchmark_strength_core, "weight_tuning": weight_tuning, "model_verdicts": model_verdicts,
    "advanced_verdicts": advanced_verdicts,
}
ORACLES = {
    "holdout_time": with_views("SELECT user_id, track_id, place <= 1 AS is_test FROM v_split"),
    "holdout_strength": with_views("""
      SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY interaction_strength DESC, track_id)
             <= least(2, count(*) OVER (PARTITION BY user_id) - 1) AS is_test
      FROM v_interactions QUALIFY count(*) OVER (PARTITION BY user_id) >= 2"""),
    "candidate_pool": with_views("SELECT track_id, round(popularity, 6) AS popularity FROM v_pool"),
    "train_pool": with_views("SELECT user_id, track_id FROM v_fit"),
    "ranking_metrics": _chain("v_m_ranked, v_test3", METRICS_SQL),
    "list_quality": _chain("v_content_top, v_interactions, v_unit", QUALITY_SQL),
    "catalog_coverage": with_views("""
      SELECT round(count(DISTINCT track_id) / cast((SELECT count(*) FROM part) AS DOUBLE), 6) AS coverage FROM (
        SELECT track_id FROM v_cf QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) <= 10)"""),
    "benchmark_core": with_views(CORE_SQL.format(prefix="v_e_")),
    "benchmark_strength_core": with_views(CORE_SQL.format(prefix="v_es_")),
    "weight_tuning": with_views("""
      , m AS (SELECT model, avg(p) AS precision, avg(r) AS recall, avg(g) AS ndcg FROM v_e_metrics GROUP BY 1),
      c(config, model, hybrid_weight, als_weight, embedding_weight, diversity_weight, novelty_weight) AS (VALUES
        ('content_focus', 'content_only', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE),
        ('hybrid_baseline', 'hybrid', 1.0, 0.0, 0.0, 0.2, 0.2), ('als_blend', 'hybrid_plus_ALS', 1.0, 0.35, 0.0, 0.2, 0.2),
        ('als_embedding_blend', 'hybrid_plus_ALS_context', 1.0, 0.3, 0.3, 0.25, 0.25)),
      o AS (SELECT c.*, round(coalesce(precision, 0.0), 6) AS precision, round(coalesce(recall, 0.0), 6) AS recall, coalesce(ndcg, 0.0) AS ndcg,
             round(coalesce(ndcg, 0.0) + 0.05::DOUBLE * diversity_weight + 0.03::DOUBLE * novelty_weight, 3) AS objective FROM c LEFT JOIN m USING (model))
      SELECT * REPLACE (round(ndcg, 6) AS ndcg), row_number() OVER (ORDER BY ndcg DESC, config) = 1 AS best_by_ndcg,
             row_number() OVER (ORDER BY objective DESC, ndcg DESC, config) = 1 AS best_by_objective FROM o""").replace("\n,", ",", 1),
    "model_verdicts": with_views("""
      , m AS (SELECT model, avg(g) AS ndcg FROM v_e_metrics GROUP BY 1),
      p(model, baseline) AS (VALUES ('collaborative_only', 'content_only'), ('hybrid', 'content_only'), ('hybrid', 'collaborative_only'))
      SELECT model, baseline, coalesce(a.ndcg, 0.0) > coalesce(b.ndcg, 0.0) AS improved
      FROM p LEFT JOIN m a USING (model) LEFT JOIN m b ON b.model = baseline""").replace("\n,", ",", 1),
}
