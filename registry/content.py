"""Content features, similarity and content ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import clusters as K
from cadenza.operators.candidates import dedupe_candidates, expand_candidates
from cadenza.operators.content import content_explain, content_scores, content_topk, with_display
from cadenza.operators.features import content_features, feature_table, top_genres
from cadenza.operators.similarity import cosine_topk
from registry import views as V
from registry.sql import dot, view, with_views

AUDIO = ["danceability", "energy", "valence", "tempo", "acousticness", "speechiness", "instrumentalness", "loudness"]
CATALOG = ["catalog_popularity"]
view("v_tokens", """
  SELECT track_id, unnest(list_distinct([replace(trim(lower(x)), ' ', '_') for x in string_split(artist_genres, ',')])) AS genre
  FROM v_tracks
""")
view("v_genres", """
  SELECT genre, n AS track_count, row_number() OVER (ORDER BY n DESC, genre) AS pos
  FROM (SELECT genre, count(*) AS n FROM v_tokens GROUP BY 1) ORDER BY n DESC, genre LIMIT 20
""")
view("v_raw_features", "\nUNION ALL ".join(
    [f"SELECT track_id, {i} AS pos, '{c}' AS feature_name, cast({'0' if c == 'speechiness' else c} AS DOUBLE) AS value FROM v_curated"
     for i, c in enumerate(AUDIO + CATALOG)]
    + [f"SELECT c.track_id, {len(AUDIO + CATALOG) - 1} + g.pos AS pos, 'genre_' || g.genre AS feature_name, "
       "CASE WHEN t.genre IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM v_curated c CROSS JOIN v_genres g "
       "LEFT JOIN v_tokens t ON t.track_id = c.track_id AND t.genre = g.genre"]
))
view("v_stats", """
  SELECT feature_name, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS s
  FROM v_raw_features GROUP BY 1
""")
view("v_z", "SELECT track_id, pos, feature_name, (value - m) / s AS z FROM v_raw_features JOIN v_stats USING (feature_name)")
view("v_vec", "SELECT track_id, list(z ORDER BY pos) AS v FROM v_z GROUP BY 1")
view("v_unit", f"SELECT track_id, CASE WHEN {dot('v', 'v')} > 0 THEN [x / sqrt({dot('v', 'v')}) for x in v] ELSE v END AS u FROM v_vec")
view("v_profile_z", "SELECT user_id, pos, feature_name, avg(z) AS z FROM v_interactions JOIN v_z USING (track_id) GROUP BY 1, 2, 3")
view("v_profile", "SELECT user_id, list(z ORDER BY pos) AS v FROM v_profile_z GROUP BY 1")
view("v_profile_unit", f"SELECT user_id, CASE WHEN {dot('v', 'v')} > 0 THEN [x / sqrt({dot('v', 'v')}) for x in v] ELSE v END AS u FROM v_profile")
view("v_content_all", f"""
  SELECT user_id, track_id, {dot('p.u', 't.u')} AS score FROM v_profile_unit p CROSS JOIN v_unit t
  WHERE NOT EXISTS (SELECT 1 FROM v_interactions i WHERE i.user_id = p.user_id AND i.track_id = t.track_id)
""")
view("v_content_top", """
  SELECT user_id, track_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
  FROM v_content_all WHERE score > 0 QUALIFY rank <= 10
""")


def features(spark, d):
    table, names = content_features(V.once(V.curated(spark, d)))
    return V.once(table), names


def genre_top(spark, d):
    return top_genres(V.tracks(spark, d))


def content_zscore(spark, d):
    f, names = features(spark, d)
    long = f.select("track_id", F.posexplode("features").alias("pos", "z"))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("pos"))
    return long.select("track_id", label.alias("feature_name"), F.round("z", 6).alias("z"))


def genre_multihot(spark, d):
    table, names = feature_table(V.tracks(spark, d))
    hot = [n for n in names if n.startswith("genre_")]
    return table.unpivot(["track_id"], hot, "feature_name", "value").where(F.col("value") > 0)


def embedding_cosine(spark, d):
    e = V.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features")
    )
    return cosine_topk(e, k=10).select(
        "track_a", "track_b", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank")
    )


def content_ranked(spark, d):
    f, names = features(spark, d)
    ranked = content_topk(f, V.interactions(spark, d), len(names), k=10)
    return ranked.select("user_id", "track_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def content_display(spark, d):
    f, names = features(spark, d)
    ranked = content_topk(f, V.interactions(spark, d), len(names), k=3)
    return with_display(ranked, V.tracks(spark, d)).select("user_id", "track_id", "track_name", "artist_name")


def content_candidates(spark, d):
    f, names = features(spark, d)
    pairs = dedupe_candidates(expand_candidates(V.once(V.recent(spark, d)), V.once(V.tracks(spark, d))))
    return content_scores(f, V.once(V.seeds(spark, d)), len(names), pairs).withColumn("score", F.round("score", 6))


def content_explained(spark, d):
    f, names = features(spark, d)
    i = V.interactions(spark, d)
    ranked = content_topk(f, i, len(names), k=3)
    out = content_explain(f, names, i, ranked, top_n=5)
    return out.select(
        "user_id", "track_id", "feature_name", F.round("contribution", 6).alias("contribution"),
        F.round("seed_value", 6).alias("seed_value"), F.round("candidate_value", 6).alias("candidate_value"),
    )


def taste_clusters(spark, d):
    f, _ = features(spark, d)
    return K.kmeans_labels(f)


def taste_map(spark, d):
    f, _ = features(spark, d)
    return K.project_2d(f)


def simple_map(spark, d):
    m = K.simple_map(V.tracks(spark, d))
    return m.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


QUERIES = {
    "genre_top": genre_top, "content_zscore": content_zscore, "genre_multihot": genre_multihot,
    "cosine_topk": embedding_cosine, "content_topk": content_ranked, "content_display": content_display,
    "content_candidates": content_candidates, "content_explain": content_explained,
    "taste_clusters": taste_clusters, "taste_map": taste_map, "simple_map": simple_map,
}
ORACLES = {
    "genre_top": with_views("SELECT genre, track_count FROM v_genres"),
    "content_zscore": with_views("SELECT track_id, feature_name, round(z, 6) AS z FROM v_z"),
    "genre_multihot": with_views(
        "SELECT track_id, 'genre_' || genre AS feature_name, 1.0::DOUBLE AS value FROM v_tokens JOIN v_genres USING (genre)"
    ),
    "cosine_topk": f"""
      WITH e AS (SELECT vec_id, [cast(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
      u AS (SELECT vec_id, [x / sqrt({dot('v', 'v')}) for x in v] AS u FROM e)
      SELECT a.vec_id AS track_a, b.vec_id AS track_b, round({dot('a.u', 'b.u')}, 6) AS similarity,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY round({dot('a.u', 'b.u')}, 9) DESC, b.vec_id) AS rank
      FROM u a JOIN u b ON a.vec_id <> b.vec_id QUALIFY rank <= 10""",
    "content_topk": with_views("SELECT user_id, track_id, round(score, 6) AS score, rank FROM v_content_top"),
    "content_display": with_views(
        "SELECT user_id, track_id, track_name, artist_name FROM v_content_top JOIN v_tracks USING (track_id) WHERE rank <= 3"
    ),
    "content_explain": with_views(f"""
      SELECT user_id, track_id, feature_name, round(c, 6) AS contribution, round(p, 6) AS seed_value, round(t, 6) AS candidate_value
      FROM (SELECT r.user_id, r.track_id, z.feature_name, pz.z AS p, z.z AS t,
                   pz.z * z.z / (sqrt({dot('pv.v', 'pv.v')}) * sqrt({dot('tv.v', 'tv.v')})) AS c
            FROM v_content_top r JOIN v_z z USING (track_id)
            JOIN v_profile_z pz ON pz.user_id = r.user_id AND pz.pos = z.pos
            JOIN v_profile pv ON pv.user_id = r.user_id JOIN v_vec tv ON tv.track_id = r.track_id
            WHERE r.rank <= 3 AND NOT (z.feature_name LIKE 'genre_%' AND pz.z <= 0 AND z.z <= 0))
      QUALIFY row_number() OVER (PARTITION BY user_id, track_id ORDER BY round(c, 9) DESC, feature_name) <= 5"""),
    "simple_map": with_views("""
      SELECT track_id, round(danceability, 6) AS x, round(energy, 6) AS y,
             upper(artist_genres[1]) || lower(split_part(artist_genres, ',', 1)[2:]) AS cluster_label FROM v_tracks"""),
}
