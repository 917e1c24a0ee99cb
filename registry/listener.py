"""Recent history, candidates, moods, reranking, playlists, profiles, explanations, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadenza.operators import candidates as G
from cadenza.operators import context as C
from cadenza.operators import mood as M
from cadenza.operators import playlist as P
from cadenza.operators import profile as T
from cadenza.operators import rerank as R
from cadenza.operators import union_match as U
from cadenza.operators.content import content_explain, content_topk
from cadenza.operators.factors import factor_scores, fit_factors
from cadenza.operators.features import AUDIO_COLUMNS as F_AUDIO
from cadenza.operators.history_view import history_ranking, listener_content, listener_features, mood_summary
from cadenza.plans.skew import salted_join
from registry import content  # (also defines SQL views used below)
from registry import views as V
from registry.sql import dot, view, with_views

MOOD, LEVEL = "happy", 0.6


def _long(df):
    return df.withColumn("rank", F.col("rank").cast("long")) if "rank" in df.columns else df


# --- recent history and candidates ----------------------------------------------------------------


def recent_plays(spark, d):
    return V.recent(spark, d).select("user_id", "track_id", F.unix_micros(F.col("played_at").cast("timestamp")).alias("played_at"), F.col("pos").cast("long").alias("pos"))


def seed_tracks(spark, d):
    return V.seeds(spark, d).withColumn("seed_pos", F.col("seed_pos").cast("long"))


def recent_distinct(spark, d):
    r = V.once(V.recent(spark, d)).withColumn("primary_artist_id", F.substring(F.md5("artist_name"), 1, 22))
    parts = [
        ("artist", G.recent_artists(r, limit=5), "artist_name"), ("genre", G.recent_genres(r, limit=2), "genre"),
        ("artist_id", G.recent_artist_ids(r, limit=5, only_catalog_ids=True), "primary_artist_id"),
    ]
    titles = G.recent_titles(r, limit=4).select(
        "user_id", F.lit("title").alias("kind"), F.concat_ws("/", "title", "artist").alias("value"), "value_pos"
    )
    out = titles
    for kind, df, column in parts:
        out = out.unionByName(df.select("user_id", F.lit(kind).alias("kind"), F.col(column).alias("value"), "value_pos"))
    return out.withColumn("value_pos", F.col("value_pos").cast("long"))


def _raw(spark, d):
    return G.expand_candidates(V.once(V.recent(spark, d)), V.once(V.tracks(spark, d)))


def deduped(spark, d):
    return G.dedupe_candidates(_raw(spark, d))


def candidate_expand(spark, d):
    return _raw(spark, d).select("user_id", "source", "value_pos", "rank", "track_id").withColumns(
        {c: F.col(c).cast("long") for c in ("source", "value_pos", "rank")}
    )


def candidate_dedup(spark, d):
    return deduped(spark, d).select(
        "user_id", "track_id", F.col("candidate_pos").cast("long").alias("candidate_pos"),
        F.array_join("candidate_sources", ", ").alias("candidate_sources"),
    )


def _candidates(spark, d, mode="audio-features"):
    """Candidate rows with catalog columns, sources and the user's artist affinity."""
    recent, tracks = V.once(V.recent(spark, d)), V.once(V.tracks(spark, d))
    rows = G.candidate_catalog(tracks, G.dedupe_candidates(G.expand_candidates(recent, tracks)), ranking_mode=mode)
    affinity = T.artist_affinity(recent).withColumnRenamed("affinity", "artist_affinity")
    return rows.join(affinity, ["user_id", "artist_name"], "left")


def pool_shares(spark, d):
    recent, tracks = V.once(V.recent(spark, d)), V.once(V.tracks(spark, d))
    rows = G.artist_pool_shares(G.candidate_catalog(tracks, G.dedupe_candidates(G.expand_candidates(recent, tracks))))
    return rows.select(
        "user_id", "track_id", "candidate_artist_pool_count",
        F.round("candidate_artist_pool_share", 6).alias("candidate_artist_pool_share"),
    )


def source_counts(spark, d):
    return G.source_counts(deduped(spark, d))


def pool_summary(spark, d):
    recent, tracks = V.once(V.recent(spark, d)), V.once(V.tracks(spark, d))
    raw = G.expand_candidates(recent, tracks)
    dedup = V.once(G.dedupe_candidates(raw))
    return G.pool_summary(raw, dedup, G.candidate_catalog(tracks, dedup))


def seed_match(spark, d):
    features, names = content.features(spark, d)
    vectors = salted_join(V.once(V.seeds(spark, d)), features, "track_id", spread=["user_id"], how="inner")
    out = G.match_seeds(vectors.select("user_id", "seed_pos", "features"), features, len(names))
    return _long(out.withColumn("score", F.round("score", 6)))


# --- affinities and profiles ----------------------------------------------------------------------


def artist_affinity(spark, d):
    return T.artist_affinity(V.recent(spark, d)).withColumn("affinity", F.round("affinity", 6))


def seed_affinity(spark, d):
    s, t = V.once(V.seeds(spark, d)), V.once(V.tracks(spark, d))
    a = T.seed_affinity(s, t).select("user_id", F.lit("artist").alias("kind"), F.col("artist_name").alias("name"), "affinity")
    g = T.seed_affinity(s, t, genres=True).select("user_id", F.lit("genre").alias("kind"), F.col("genre").alias("name"), "affinity")
    return a.unionByName(g).withColumn("affinity", F.round("affinity", 6))


def _means(spark, d):
    return T.taste_means(V.recent(spark, d), V.tracks(spark, d))


def taste_means(spark, d):
    m = _means(spark, d)
    return m.join(T.infer_mood(m), "user_id").select("user_id", "mood", *[F.round(c, 6).alias(c) for c in m.columns if c != "user_id"])


def top_artists(spark, d):
    return _long(T.top_artists(V.recent(spark, d)))


def top_genres(spark, d):
    return _long(T.top_genres(V.recent(spark, d)))


def personality(spark, d):
    rows = salted_join(
        V.recent(spark, d).select("user_id", "track_id"),
        V.curated(spark, d).select("track_id", "energy", "catalog_novelty", "album_release_date"), "track_id", spread=["user_id"],
    )
    out = T.personality(rows)
    return out.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("energy_score", "discovery_score", "favorite_decade")])


def profile_row_table(spark, d):
    plays, t = V.once(V.recent(spark, d)), V.once(V.tracks(spark, d))
    recent = salted_join(plays.select("user_id", "track_id").distinct(), t, "track_id", spread=["user_id"], how="inner")
    found = G.dedupe_candidates(G.expand_candidates(plays, t))
    candidates = salted_join(found.select("user_id", "track_id"), t, "track_id", spread=["user_id"], how="inner")
    return T.profile_rows(recent, candidates, V.seeds(spark, d))


def profile_rows(spark, d):
    return profile_row_table(spark, d).select("user_id", "track_id", "track_name", "artist_name", "is_recent")


def fixed_cluster_profile(spark, d):
    """Taste profile with fixed clusters (the track id modulo four), so that the rules can be checked."""
    t = V.tracks(spark, d)
    clusters = t.select("track_id", (F.col("track_id") % 4).cast("int").alias("cluster_id"))
    return T.taste_profile(V.once(profile_row_table(spark, d)), clusters).withColumn("cluster_id", F.col("cluster_id").cast("long"))


def mean_signals(spark, d):
    recent = salted_join(V.recent(spark, d).select("user_id", "track_id").distinct(), V.tracks(spark, d), "track_id", spread=["user_id"], how="inner")
    return T.mean_signals(recent).select("user_id", F.array_join("signals", "|").alias("signals"))


def _top(spark, d, k=3):
    features, names = content.features(spark, d)
    seen = V.once(V.interactions(spark, d).select("user_id", "track_id"))
    return V.once(content_topk(features, seen, len(names), k=k)), features, names, seen


def _signals(spark, d):
    return T.taste_signals(_means(spark, d), V.seeds(spark, d), V.tracks(spark, d))


def taste_signals(spark, d):
    return _signals(spark, d).select("user_id", F.array_join("signals", "|").alias("signals"))


def _as_references(seeds):
    return seeds.select("user_id", F.col("track_id").alias("reference_id"), F.col("seed_pos").alias("ref_pos"))


def nearest_references(spark, d):
    ranked, features, _, _ = _top(spark, d)
    near = T.nearest_references(ranked, _as_references(V.seeds(spark, d)), features, features)
    return _long(near.select("user_id", "track_id", "reference_id", F.round("similarity", 6).alias("similarity"), "rank"))


def first_labels(spark, d):
    r = V.recent(spark, d)
    plays = T.first_labels(r, T.play_label(), "pos", name="recent_labels")
    names = T.first_labels(r, F.col("artist_name"), "pos", name="artists")
    return plays.join(names, "user_id").select(
        "user_id", F.array_join("recent_labels", "|").alias("recent_labels"), F.array_join("artists", "|").alias("artists")
    )


def rationale(spark, d):
    ranked, _, _, _ = _top(spark, d)
    artists = T.first_labels(V.recent(spark, d), F.col("artist_name"), "pos", name="artists")
    moods = T.infer_mood(_means(spark, d))
    out = T.rationale(ranked, V.tracks(spark, d), artists, _signals(spark, d), moods)
    return out.select("user_id", "track_id", "reason", F.array_join("reason_values", "|").alias("reason_values"))


def explanation_labels(spark, d):
    ranked, features, _, _ = _top(spark, d)
    latest, given, t = V.once(V.recent(spark, d)), V.once(V.seeds(spark, d)), V.once(V.tracks(spark, d))
    plays = latest.groupBy("user_id", F.col("track_id").alias("reference_id")).agg(F.min("pos").alias("ref_pos"))
    near_recent = T.nearest_references(ranked, plays, features, features)
    near_seeds = T.nearest_references(ranked, _as_references(given), features, features)
    labels = t.select("track_id", T.play_label().alias("label"))
    recent = T.first_labels(latest, T.play_label(), "pos")
    seeds = T.first_labels(salted_join(given, labels, "track_id", spread=["user_id"]), F.col("label"), "seed_pos")
    out = T.enrich(ranked, near_recent, near_seeds, recent, seeds, labels)
    return out.select(
        "user_id", "track_id", F.array_join("recent_labels", "|").alias("recent_labels"),
        F.array_join("seed_labels", "|").alias("seed_labels"), "item_specific",
    )


def score_breakdown(spark, d):
    ranked, features, names, seen = _top(spark, d)
    explained = content_explain(features, names, seen, ranked, top_n=3)
    out = T.score_breakdown(ranked, explained)
    return _long(out.select("user_id", "track_id", "rank", F.round("score", 6).alias("score"), F.array_join("top_features", "|").alias("top_features")))


def _union_match(spark, d):
    t = V.once(V.tracks(spark, d))
    recent = V.recent(spark, d).select("user_id", "track_id").distinct()
    history = salted_join(recent, t, "track_id", spread=["user_id"], how="inner")
    return U.match_seeds_on_union(V.once(history), V.seeds(spark, d), t)


def union_seed_match(spark, d):
    """Closest catalog tracks by z-scores on the catalog and the listener's own rows together."""
    return _long(_union_match(spark, d).withColumn("score", F.round("score", 6)))


def history_profile(spark, d):
    matched = _union_match(spark, d)
    out = T.history_profile(V.recent(spark, d), matched, T.infer_mood(_means(spark, d)))
    return out.select(
        "user_id", F.array_join("recent_artists", "|").alias("recent_artists"),
        F.array_join(F.transform("seed_track_ids", lambda x: x.cast("string")), "|").alias("seed_track_ids"), "mood",
    )


# --- mood -----------------------------------------------------------------------------------------


def mood_relevance(spark, d):
    moods = F.explode(F.array(*[F.struct(F.lit(m).alias("mood"), M.mood_relevance(m).alias("score")) for m in M.SEQUENCING_MOODS]))
    return V.tracks(spark, d).select("track_id", moods.alias("m")).select("track_id", "m.mood", F.round("m.score", 6).alias("score"))


def mood_audio(spark, d):
    t = V.curated(spark, d)

    def row(m):
        score, mode, positive, penalty = M.mood_details(m, t.columns)
        return F.struct(
            F.lit(m).alias("mood"), F.round(score + 1e-11, 6).alias("score"), mode.alias("mode"),
            F.array_join(positive, "|").alias("positive"), F.array_join(penalty, "|").alias("penalty"),
            M.mood_fit_label(score).alias("fit"), M.rule_mood_match(F.lit(m)).alias("rule"),
        )

    return t.select("track_id", F.explode(F.array(*[row(m) for m in M.SCORING_MOODS])).alias("m")).select("track_id", "m.*")


def mood_keyword(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("track_name"), F.col("source").alias("artist_name"), F.lit(M.METADATA_ONLY).alias("ranking_mode")
    )

    def row(m):
        score, mode, positive, penalty = M.mood_details(m, docs.columns)
        return F.struct(
            F.lit(m).alias("mood"), F.round(score, 6).alias("score"), mode.alias("mode"),
            F.array_join(positive, "|").alias("positive"), F.array_join(penalty, "|").alias("penalty"),
        )

    return docs.select("doc_id", F.explode(F.array(*[row(m) for m in M.SCORING_MOODS])).alias("m")).select("doc_id", "m.*")


def exploration_labels(spark, d):
    t = V.curated(spark, d)
    return t.select("track_id", M.exploration_label(F.round("catalog_novelty", 3)).alias("label"))


# --- ranking --------------------------------------------------------------------------------------


def bucket_topk(spark, d):
    scored = R.bucket_scores(_candidates(spark, d), exploration=LEVEL, mood=MOOD)
    return _long(R.rank_buckets(scored, k=10).select("user_id", "bucket", "rank", "track_id", F.round("score", 6).alias("score")))


def buckets(spark, d):
    return R.buckets(_candidates(spark, d), exploration=LEVEL, mood=MOOD, k=10)


def keyword_buckets(spark, d):
    """Buckets when no audio features exist: the mood comes from names, genres and source labels."""
    scored = R.bucket_scores(_candidates(spark, d, M.METADATA_ONLY), exploration=LEVEL, mood="party")
    return _long(R.rank_buckets(scored, k=5).select("user_id", "bucket", "rank", "track_id", F.round("score", 6).alias("score")))


def adjusted_scores(spark, d):
    rows = _candidates(spark, d).withColumn("score", F.col("catalog_popularity") * 2.0 + F.col("energy"))
    out = R.adjust_scores(rows, exploration=LEVEL, mood=MOOD, focus="Discovery")
    return out.select("user_id", "track_id", F.round("score", 6).alias("score"))


def artist_penalty(spark, d):
    rows = _candidates(spark, d).withColumn("score", F.col("catalog_popularity"))
    out = R.penalize_artist(rows.select("user_id", "track_id", "artist_name", "score"))
    return out.select("user_id", "track_id", F.round("score", 6).alias("score"), F.round("artist_penalty", 6).alias("artist_penalty"))


def profile_rerank(spark, d):
    ranked, _, _, _ = _top(spark, d, 10)
    t = V.once(V.tracks(spark, d))
    out = V.once(R.rerank_profile(ranked, t, T.user_signals(V.once(V.recent(spark, d)), V.once(V.seeds(spark, d)), t)))
    audit = R.audit_columns(ranked.select("user_id", "track_id"), out)
    joined = out.join(audit.select("user_id", "track_id", "has_note"), ["user_id", "track_id"])
    return _long(joined.select(
        "user_id", "track_id", "rank", F.round("score", 6).alias("score"), F.round("adjustment", 6).alias("adjustment"),
        F.array_join("reasons", "|").alias("reasons"), "has_note",
    ))


def diversity_rerank(spark, d):
    rows = _candidates(spark, d).withColumn("score", F.round(F.col("catalog_popularity") * 3.0, 6))
    return R.rerank_diversity(rows, exploration=0.7, strength=0.8)


def _listener_rows(spark, d):
    """Candidates, recent plays with catalog columns, seeds."""
    rows = V.once(_candidates(spark, d))
    tracks = V.once(V.curated(spark, d)).drop("track_name", "artist_name", "artist_genres")
    recent = V.once(V.recent(spark, d)).join(tracks, "track_id")
    return rows, recent, V.once(V.seeds(spark, d))


def _full_ranking(spark, d):
    """History view with the scores of fitted ALS and context models."""
    rows, recent, seeds = _listener_rows(spark, d)
    i = V.once(V.interactions(spark, d))
    pairs = rows.select("user_id", "track_id")
    als = factor_scores(*fit_factors(i), pairs)
    near = V.once(C.cooccurrence(C.build_sequences(i)))
    context = C.context_scores(near, C.truncated_svd(C.ppmi(near), dim=8), seeds, pairs, 8)
    before, after = history_ranking(rows, recent, seeds, exploration=LEVEL, mood=MOOD, als=als, embedding=context, limit=20)
    return V.once(before), V.once(after)


def listener_content_scores(spark, d):
    """Content scores of the candidates in each listener's own feature space."""
    rows, recent, seeds = _listener_rows(spark, d)
    return listener_content(listener_features(recent, rows), seeds, rows).withColumn("score", F.round("score", 6))


def top_moods(spark, d):
    """Mood scores and signals of the first ten tracks of the history view without model scores."""
    rows, recent, seeds = _listener_rows(spark, d)
    _, after = history_ranking(rows, recent, seeds, exploration=LEVEL, mood=MOOD, limit=10)
    out = mood_summary(after, rows, MOOD)
    return out.withColumns({"mood_score": F.round("mood_score", 6), "positive_signals": F.array_join("positive_signals", "|"), "penalty_signals": F.array_join("penalty_signals", "|")})


def full_ranking(spark, d):
    return R.rounded(_full_ranking(spark, d)[1], ["score"])


def rank_diagnostics(spark, d):
    before, after = _full_ranking(spark, d)
    return R.position_changes(before, after).join(R.top_overlap(before, after), "user_id")


def bucket_overlap(spark, d):
    b = _bucket_lists(spark, d)
    f, m = b.where(F.col("bucket") == "familiar"), b.where(F.col("bucket") == "mood_based")
    out = R.top_overlap(f, m).join(R.position_changes(f, m), "user_id")
    return out.select("user_id", F.round("overlap", 6).alias("overlap"), F.col("positions_changed").cast("long").alias("positions_changed"))


# --- playlists ------------------------------------------------------------------------------------


def _bucket_lists(spark, d):
    scored = R.bucket_scores(_candidates(spark, d), exploration=LEVEL, mood=MOOD)
    return R.rank_buckets(scored, k=10)


def _playlist_rows(spark, d):
    ranked = _bucket_lists(spark, d).where(F.col("bucket") == "mood_based")
    return P.playlist_candidates(V.tracks(spark, d), ranked)


def playlist_opener(spark, d):
    return P.best_opener(_playlist_rows(spark, d), "workout").withColumn("mood_relevance", F.round("mood_relevance", 6))


def playlist_sequence(spark, d):
    rows = V.once(_playlist_rows(spark, d))
    return P.sequence_reasons(P.sequence_playlist(rows, "workout", max_items=8), rows, "workout")


def playlist_export(spark, d):
    b = V.once(_bucket_lists(spark, d))
    main = b.where(F.col("bucket") == "familiar").drop("bucket")
    out = P.export_tracks(b, main, ["familiar", "discovery", "mood_based"])
    return out.withColumn("position", F.col("position").cast("long"))


def playlist_duration(spark, d):
    return P.playlist_duration(_playlist_rows(spark, d))


# --- streaming ------------------------------------------------------------------------------------


def stream_listens(spark, d):
    """The events table as a stream of several micro-batches, compacted: equal to the batch aggregation."""
    from cadenza.session import ensure_checkpoint_dir
    from cadenza.sources.listens import LogColumns, clean_listens
    from cadenza.streaming.incremental import compact_interactions, read_interactions, stream_interactions

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = V.table(spark, d, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    raw = source.select(
        F.col("user_id").cast("string").alias("user"), F.concat(F.lit("  The "), F.col("event_type")).alias("artist"),
        F.concat(F.lit("Song No. "), F.get_json_object("props", "$.k")).alias("track"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    listens = clean_listens(raw, LogColumns("user", "artist", "track", "timestamp"))
    stream_interactions(listens, f"{base}/table", f"{base}/log", availableNow=True).awaitTermination()
    compact_interactions(spark, f"{base}/table")
    out = read_interactions(spark, f"{base}/table")
    return out.withColumn("first_timestamp", F.unix_micros("first_timestamp")).withColumn("last_timestamp", F.unix_micros("last_timestamp"))


# --- SQL ------------------------------------------------------------------------------------------

view("v_r_artist", "SELECT user_id, artist_name AS v, min(pos) AS ord FROM v_recent GROUP BY 1, 2")
view("v_r_title", "SELECT user_id, lower(track_name) AS t, lower(artist_name) AS a, min(pos) AS ord FROM v_recent GROUP BY 1, 2, 3")
view("v_r_genre", """
  SELECT user_id, v, min(ord) AS ord FROM (
    SELECT user_id, split_part(artist_genres, ', ', 1) AS v, pos * 2 AS ord FROM v_recent UNION ALL
    SELECT user_id, split_part(artist_genres, ', ', 2), pos * 2 + 1 FROM v_recent) GROUP BY 1, 2
""")
view("v_k_artist", "SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY ord) - 1 AS p FROM v_r_artist QUALIFY p < 5")
view("v_k_title", "SELECT user_id, t, a, row_number() OVER (PARTITION BY user_id ORDER BY ord) - 1 AS p FROM v_r_title QUALIFY p < 4")
view("v_k_genre", "SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY ord) - 1 AS p FROM v_r_genre QUALIFY p < 2")
view("v_expand", """
  SELECT k.user_id, s AS source, k.p AS value_pos, b.r AS rank, b.track_id, b.track_name, b.artist_name
  FROM v_k_artist k JOIN (SELECT *, row_number() OVER (PARTITION BY artist_name ORDER BY popularity DESC, track_id) AS r FROM v_tracks) b ON b.artist_name = k.v
  JOIN (VALUES (0, 6), (1, 4)) x(s, n) ON b.r <= x.n
  UNION ALL
  SELECT k.user_id, 2, k.p, b.r, b.track_id, b.track_name, b.artist_name
  FROM v_k_title k JOIN (SELECT *, row_number() OVER (PARTITION BY lower(track_name), lower(artist_name) ORDER BY popularity DESC, track_id) AS r FROM v_tracks) b
    ON lower(b.track_name) = k.t AND lower(b.artist_name) = k.a WHERE b.r <= 2
  UNION ALL
  SELECT k.user_id, 3, k.p, b.r, b.track_id, b.track_name, b.artist_name
  FROM v_k_genre k JOIN (SELECT *, row_number() OVER (PARTITION BY g ORDER BY popularity DESC, track_id) AS r
    FROM (SELECT *, unnest(string_split(artist_genres, ', ')) AS g FROM v_tracks)) b ON b.g = k.v WHERE b.r <= 2
""")
view("v_key", """
  SELECT *, trim(regexp_replace(lower(track_name), '[^a-z0-9]+', ' ', 'g')) || '/' || trim(regexp_replace(lower(artist_name), '[^a-z0-9]+', ' ', 'g')) AS key,
         (source, value_pos, rank, track_id) AS ord FROM v_expand
""")
view("v_label", """
  SELECT * FROM (VALUES (0, 'recent artist top track'), (1, 'recent artist search match'), (2, 'recent track search match'), (3, 'genre search match')) x(source, label)
""")
view("v_dedup", """
  SELECT user_id, arg_min(track_id, ord) AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY min(ord)) - 1 AS candidate_pos,
         list_sort(list(DISTINCT source)) AS sources
  FROM v_key GROUP BY user_id, key QUALIFY candidate_pos < 80
""")
view("v_aff", """
  SELECT user_id, artist_name, sum(w) / sum(sum(w)) OVER (PARTITION BY user_id) AS affinity
  FROM (SELECT user_id, artist_name, max(pos) OVER (PARTITION BY user_id) + 1 - pos AS w FROM v_recent) GROUP BY 1, 2
""")
view("v_candidates", """
  SELECT d.user_id, d.candidate_pos, d.sources, c.*, coalesce(a.affinity, 0.0) AS aff,
         list_has_any(d.sources, [1, 2, 3]) AS search, list_contains(d.sources, 0) AS top
  FROM v_dedup d JOIN v_curated c USING (track_id) LEFT JOIN v_aff a ON a.user_id = d.user_id AND a.artist_name = c.artist_name
""")
view("v_means", """
  SELECT user_id, avg(danceability) AS danceability, avg(energy) AS energy, avg(valence) AS valence, avg(acousticness) AS acousticness,
         avg(instrumentalness) AS instrumentalness
  FROM (SELECT DISTINCT user_id, track_id FROM v_recent) JOIN v_tracks USING (track_id) GROUP BY 1
""")
PREFERRED = """CASE WHEN energy >= 0.72 AND danceability >= 0.68 THEN 'workout' WHEN valence >= 0.68 THEN 'happy'
  WHEN valence <= 0.35 AND energy <= 0.45 THEN 'melancholic' WHEN acousticness >= 0.55 AND instrumentalness >= 0.08 THEN 'study' ELSE 'calm' END"""
view("v_mood", f"SELECT user_id, {PREFERRED} AS mood FROM v_means")
view("v_seed_w", """
  SELECT s.user_id, s.track_id, s.seed_pos, t.artist_name, t.artist_genres,
         max(seed_pos) OVER (PARTITION BY s.user_id) + 1 - seed_pos AS w FROM v_seeds s JOIN v_tracks t USING (track_id)
""")
view("v_seed_genre", """
  SELECT user_id, genre, sum(w) / sum(sum(w)) OVER (PARTITION BY user_id) AS affinity, count(*) AS n
  FROM (SELECT user_id, w, unnest(string_split(artist_genres, ', ')) AS genre FROM v_seed_w) GROUP BY 1, 2
""")
view("v_seed_artist", """
  SELECT user_id, artist_name, sum(w) / sum(sum(w)) OVER (PARTITION BY user_id) AS affinity FROM v_seed_w GROUP BY 1, 2
""")

_SIGNALS = """
  SELECT *, greatest(least(energy, 1.0), 0.0) AS en, greatest(least(danceability, 1.0), 0.0) AS da, greatest(least(valence, 1.0), 0.0) AS va,
         greatest(least(acousticness, 1.0), 0.0) AS ac, greatest(least(instrumentalness, 1.0), 0.0) AS ins,
         greatest(least((tempo - 90.0) / 70.0::DOUBLE, 1.0), 0.0) AS tf, 1.0::DOUBLE - greatest(least((tempo - 70.0) / 80.0::DOUBLE, 1.0), 0.0) AS ts,
         greatest(least(catalog_popularity, 1.0), 0.0) AS po FROM {0}
"""
_NAMES = {
    "energy": "en", "danceability": "da", "valence": "va", "acousticness": "ac", "instrumentalness": "ins", "tempo_fast": "tf",
    "tempo_slow": "ts", "popularity": "po", "not_acoustic": "(1.0::DOUBLE - ac)", "low_energy": "(1.0::DOUBLE - en)",
    "medium_low_energy": "(1.0::DOUBLE - abs(en - 0.35::DOUBLE))", "low_valence": "(1.0::DOUBLE - va)",
}


def _weighted(weights: dict) -> str:
    parts = " + ".join(f"{_NAMES[n]} * {w!r}::DOUBLE" for n, w in weights.items())
    return f"greatest(least(({parts}) / {sum(weights.values())!r}::DOUBLE, 1.0), 0.0)"


def _mood_sql(m: str) -> str:
    return f"(0.72::DOUBLE * {_weighted(M.POSITIVE_SIGNALS[m])} + 0.28::DOUBLE * (1.0::DOUBLE - {_weighted(M.PENALTY_SIGNALS[m])}))"


def _top_sql(weights: dict) -> str:
    rows = ", ".join(f"{{'o': -({_NAMES[n]} * {w!r}::DOUBLE), 'n': '{n}'}}" for n, w in weights.items())
    return (
        f"list_aggregate([replace(r.n, '_', ' ') for r in list_filter(list_slice(list_sort([{rows}]), 1, 3), lambda r: r.o < -0.05)], 'string_agg', '|')"
    )


RULE = """CASE WHEN (mood = 'workout' AND energy >= 0.72 AND danceability >= 0.68) OR (mood = 'happy' AND valence >= 0.68)
  OR (mood = 'melancholic' AND valence <= 0.35 AND energy <= 0.45) OR (mood = 'study' AND acousticness >= 0.55 AND instrumentalness >= 0.08)
  OR (mood = 'calm' AND energy <= 0.45) THEN 1.0::DOUBLE ELSE 0.0 END"""
MOOD_AUDIO_SQL = " UNION ALL ".join(
    f"""SELECT track_id, mood, round(s + 1e-11, 6) AS score, 'audio_features' AS mode, coalesce(p, '') AS positive, coalesce(q, '') AS penalty,
      CASE WHEN s >= 0.7 THEN 'High' WHEN s >= 0.4 THEN 'Medium' ELSE 'Low' END AS fit, {RULE} AS rule
      FROM (SELECT *, '{m}' AS mood, {_mood_sql(m)} AS s, {_top_sql(M.POSITIVE_SIGNALS[m])} AS p, {_top_sql(M.PENALTY_SIGNALS[m])} AS q
            FROM ({_SIGNALS.format('v_curated')}))"""
    for m in M.SCORING_MOODS
)
MOOD_RELEVANCE_SQL = " UNION ALL ".join(
    f"SELECT track_id, '{m}' AS mood, round(("
    + " + ".join(f"greatest(0.0, 1.0::DOUBLE - abs({n} - {t!r}::DOUBLE) / {tol!r}::DOUBLE)" for n, (t, tol) in p["features"].items())
    + ") / 5, 6) AS score FROM v_tracks"
    for m, p in M.MOOD_PROFILES.items()
)


def _hits(text: str, terms: list[str]) -> str:
    return " + ".join(f"CAST(contains({text}, '{t}') AS INT)" for t in terms)


def _first4(text: str, terms: list[str]) -> str:
    rows = ", ".join(f"CASE WHEN contains({text}, '{t}') THEN '{t}' END" for t in terms)
    return f"coalesce(list_aggregate(list_slice(list_filter([{rows}], lambda x: x IS NOT NULL), 1, 4), 'string_agg', '|'), '')"


def _keyword_sql(text: str, m: str) -> str:
    w, b = M.MOOD_WORDS[m], M.BLOCKED_WORDS[m]
    positive = (
        f"least(1.0, 0.22::DOUBLE * ({_hits(text, w)}) + CASE WHEN contains({text}, 'search') THEN 0.12::DOUBLE ELSE 0.0 END"
        f" + CASE WHEN {_hits(text, w[:4])} > 0 THEN 0.15::DOUBLE ELSE 0.0 END)"
    )
    return f"(0.72::DOUBLE * {positive} + 0.28::DOUBLE * (1.0::DOUBLE - least(1.0, 0.28::DOUBLE * ({_hits(text, b)}))))"


MOOD_KEYWORD_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS mood, round({_keyword_sql('x', m)}, 6) AS score, 'metadata_only' AS mode, "
    f"{_first4('x', M.MOOD_WORDS[m])} AS positive, {_first4('x', M.BLOCKED_WORDS[m])} AS penalty "
    "FROM (SELECT doc_id, lower(text || ' ' || source || '   ') AS x FROM documents)"
    for m in M.SCORING_MOODS
)


def _bucket_sql(prefix: str, mood_sql: str, source: str) -> None:
    e, f = LEVEL, 1.0 - LEVEL
    view(f"{prefix}scores", f"""
      SELECT user_id, track_id, {3.4 + 1.8 * f!r}::DOUBLE * aff + CASE WHEN top THEN {1.8 + 0.9 * f!r}::DOUBLE ELSE 0.0 END
               + {1.7 + 0.8 * f!r}::DOUBLE * catalog_popularity + 0.2::DOUBLE * fit - {0.65 * e!r}::DOUBLE * catalog_novelty AS familiar,
             {2.4 + 2.1 * e!r}::DOUBLE * catalog_novelty + CASE WHEN search THEN {1.8 + 1.3 * e!r}::DOUBLE ELSE 0.0 END + 0.35::DOUBLE * fit
               - {1.2 + 0.9 * e!r}::DOUBLE * aff - 0.75::DOUBLE * catalog_popularity
               - 0.75::DOUBLE * (row_number() OVER (PARTITION BY user_id, artist_name ORDER BY candidate_pos) - 1) AS discovery,
             8.0::DOUBLE * fit + 0.08::DOUBLE * catalog_novelty + 0.03::DOUBLE * catalog_popularity + CASE WHEN search THEN 0.08::DOUBLE ELSE 0.0 END AS mood_based
      FROM (SELECT *, {mood_sql} AS fit FROM ({source}))""")
    view(f"{prefix}ranked", f"""
      SELECT user_id, bucket, track_id, score, row_number() OVER (PARTITION BY user_id, bucket ORDER BY round(score, 9) DESC, track_id) AS rank
      FROM (UNPIVOT {prefix}scores ON familiar, discovery, mood_based INTO NAME bucket VALUE score)""")


_bucket_sql("v_b_", _mood_sql(MOOD), _SIGNALS.format("v_candidates"))
_LABELS = "list_aggregate([['recent artist top track', 'recent artist search match', 'recent track search match', 'genre search match'][s + 1] for s in sources], 'string_agg', ', ')"
_bucket_sql(
    "v_bk_", _keyword_sql("x", "party"),
    f"SELECT *, lower(track_name || ' ' || artist_name || ' ' || artist_genres || ' ' || {_LABELS} || ' ') AS x FROM v_candidates",
)
_E, _FW = LEVEL, R.FOCUS_WEIGHTS["discovery"]
ADJUST_SQL = f"""
  , b AS (SELECT *, catalog_popularity * 2.0::DOUBLE + energy AS sc, {_mood_sql(MOOD)} AS fit FROM ({_SIGNALS.format('v_candidates')})),
  s AS (SELECT *, {_FW['base']!r}::DOUBLE * CASE WHEN max(sc) OVER w = min(sc) OVER w THEN 0.5 ELSE (sc - min(sc) OVER w) / (max(sc) OVER w - min(sc) OVER w) END
      + {2.35 * _FW['familiar'] * (1 - _E)!r}::DOUBLE * aff + {1.4 * _FW['familiar'] * (1 - _E)!r}::DOUBLE * catalog_popularity
      + CASE WHEN top THEN {2.1 * _FW['familiar'] * (1 - _E)!r}::DOUBLE ELSE 0.0 END + {3.25 * _FW['mood']!r}::DOUBLE * fit
      + {2.45 * _FW['discovery'] * _E!r}::DOUBLE * catalog_novelty + CASE WHEN search THEN {2.05 * _FW['discovery'] * _E!r}::DOUBLE ELSE 0.0 END
      - {1.35 * _FW['discovery'] * _E!r}::DOUBLE * aff - {1.05 * _FW['discovery'] * _E!r}::DOUBLE * catalog_popularity
      - CASE WHEN top THEN {1.15 * _FW['discovery'] * _E!r}::DOUBLE ELSE 0.0 END AS score FROM b WINDOW w AS (PARTITION BY user_id))
  SELECT user_id, track_id, round(score - {0.55 * 1.85 * _E!r}::DOUBLE * (row_number() OVER (
           PARTITION BY user_id, artist_name ORDER BY round(score, 9) DESC, track_id) - 1), 6) AS score FROM s
"""
RERANK_SQL = f"""
  , r AS (SELECT c.user_id, c.track_id, c.score AS before, t.artist_name, t.artist_genres, t.danceability, t.energy, t.valence, t.acousticness, t.instrumentalness,
      0.025::DOUBLE * least(greatest(coalesce(a.affinity, 0.0), coalesce(sa.affinity, 0.0)) * 4.0, 1.0) AS ab,
      0.025::DOUBLE * least((SELECT coalesce(sum(g.affinity), 0.0) FROM v_seed_genre g WHERE g.user_id = c.user_id
        AND list_contains(string_split(t.artist_genres, ', '), g.genre)) * 3.0, 1.0) AS gb,
      0.04::DOUBLE * greatest(0.0, 1.0 - (abs(t.danceability - m.danceability) + abs(t.energy - m.energy) + abs(t.valence - m.valence)
        + abs(t.acousticness - m.acousticness)) / 4.0::DOUBLE) AS tb, mo.mood
    FROM v_content_top c JOIN v_tracks t USING (track_id) JOIN v_means m USING (user_id) JOIN v_mood mo USING (user_id)
    LEFT JOIN v_aff a ON a.user_id = c.user_id AND a.artist_name = t.artist_name
    LEFT JOIN v_seed_artist sa ON sa.user_id = c.user_id AND sa.artist_name = t.artist_name),
  q AS (SELECT *, 0.015::DOUBLE * {RULE} AS mb FROM r),
  p AS (SELECT *, 0.01::DOUBLE * (row_number() OVER (PARTITION BY user_id, artist_name ORDER BY round(before + ab + gb + tb + mb, 9) DESC, track_id) - 1) AS pen FROM q)
  SELECT user_id, track_id, round(before + ab + gb + tb + mb - pen, 6) AS score, round(ab + gb + tb + mb - pen, 6) AS adjustment,
    concat_ws('|', CASE WHEN ab > 0 THEN 'recent_artist' END, CASE WHEN gb > 0 THEN 'seed_genre' END, CASE WHEN tb > 0 THEN 'taste_profile' END,
      CASE WHEN mb > 0 THEN 'recent_mood' END, CASE WHEN pen > 0 THEN 'artist_repetition' END) AS reasons,
    abs(ab + gb + tb + mb - pen) > 1e-9 AS has_note,
    row_number() OVER (PARTITION BY user_id ORDER BY round(before + ab + gb + tb + mb - pen, 9) DESC, track_id) AS rank
  FROM p
"""
view("v_prof", """
  SELECT user_id, track_id, max(r) = 1 OR max(s) = 1 AS is_recent FROM (
    SELECT DISTINCT user_id, track_id, 1 AS r, 0 AS s FROM v_recent UNION ALL
    SELECT d.user_id, d.track_id, 0, CASE WHEN x.track_id IS NULL THEN 0 ELSE 1 END
    FROM v_dedup d LEFT JOIN v_seeds x ON x.user_id = d.user_id AND x.track_id = d.track_id) GROUP BY 1, 2
""")
FIXED_SQL = """
  , c AS (SELECT user_id, track_id, is_recent, cast(track_id % 4 AS BIGINT) AS cl FROM v_prof),
  n AS (SELECT user_id, cl, count(*) AS n, count(*) FILTER (is_recent) AS r, sum(count(*) FILTER (is_recent)) OVER (PARTITION BY user_id) AS rs FROM c GROUP BY 1, 2),
  dom AS (SELECT user_id, cl FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rs > 0 THEN r ELSE n END DESC, cl) = 1),
  i AS (SELECT c.user_id, c.cl, t.* FROM c JOIN dom USING (user_id, cl) JOIN v_tracks t USING (track_id)),
  m AS (SELECT user_id, any_value(cl) AS cl, avg(energy) AS e, avg(danceability) AS d, avg(acousticness) AS a, avg(valence) AS v FROM i GROUP BY 1)
  SELECT user_id, (SELECT count(*) FROM c WHERE c.user_id = m.user_id) AS tracks, cl AS cluster_id,
    CASE WHEN e >= 0.72 AND d >= 0.62 THEN 'Dance / Workout Mix' WHEN a >= 0.62 OR (e <= 0.42 AND v <= 0.55) THEN 'Chill Acoustic Listening'
         WHEN e >= 0.65 THEN 'High-Energy Discovery' ELSE 'Balanced Listener' END AS cluster_label FROM m
"""
view("v_signal", """
  SELECT m.user_id, list_concat(list_filter([CASE WHEN energy >= 0.72 THEN 'high-energy' END, CASE WHEN danceability >= 0.68 THEN 'dance-forward' END,
      CASE WHEN valence >= 0.68 THEN 'feel-good' WHEN valence <= 0.35 THEN 'moody' END, CASE WHEN acousticness >= 0.55 THEN 'acoustic-leaning' END],
      lambda x: x IS NOT NULL), g.gs) AS signals
  FROM v_means m JOIN (SELECT user_id, list(genre ORDER BY n DESC, genre) AS gs FROM (
    SELECT * FROM v_seed_genre QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) <= 2) GROUP BY 1) g USING (user_id)
""")
view("v_near", f"""
  SELECT c.user_id, c.track_id, s.track_id AS reference_id, {dot('a.u', 'b.u')} AS similarity,
         row_number() OVER (PARTITION BY c.user_id, c.track_id ORDER BY round({dot('a.u', 'b.u')}, 9) DESC, s.seed_pos) AS place
  FROM v_content_top c JOIN v_seeds s USING (user_id) JOIN v_unit a ON a.track_id = c.track_id JOIN v_unit b ON b.track_id = s.track_id
  WHERE c.rank <= 3 QUALIFY place <= 2
""")
view("v_near_recent", f"""
  SELECT c.user_id, c.track_id, s.track_id AS reference_id,
         row_number() OVER (PARTITION BY c.user_id, c.track_id ORDER BY round({dot('a.u', 'b.u')}, 9) DESC, s.pos) AS place
  FROM v_content_top c JOIN (SELECT user_id, track_id, min(pos) AS pos FROM v_recent GROUP BY 1, 2) s USING (user_id)
  JOIN v_unit a ON a.track_id = c.track_id JOIN v_unit b ON b.track_id = s.track_id
  WHERE c.rank <= 3 QUALIFY place <= 2
""")
view("v_first", """
  SELECT a.user_id, recent_labels, artists FROM
    (SELECT user_id, string_agg(l, '|' ORDER BY ord) AS recent_labels FROM (SELECT user_id, track_name || ' - ' || artist_name AS l, min(pos) AS ord
      FROM v_recent GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(pos)) <= 3) GROUP BY 1) a
  JOIN (SELECT user_id, string_agg(l, '|' ORDER BY ord) AS artists FROM (SELECT user_id, artist_name AS l, min(pos) AS ord
      FROM v_recent GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(pos)) <= 3) GROUP BY 1) b USING (user_id)
""")
view("v_match", f"""
  SELECT q.user_id, t.track_id, sum(q.w * {dot('b.u', 't.u')}) AS score,
         row_number() OVER (PARTITION BY q.user_id ORDER BY round(sum(q.w * {dot('b.u', 't.u')}), 9) DESC, t.track_id) AS rank
  FROM (SELECT user_id, track_id, w / sum(w) OVER (PARTITION BY user_id) AS w FROM v_seed_w) q
  JOIN v_unit b USING (track_id) CROSS JOIN v_unit t GROUP BY 1, 2 QUALIFY rank <= 5
""")
# The union of the catalog and one listener's tracks: sums of both, then z-scores of every catalog track for every listener.
view("v_um_own", "SELECT DISTINCT user_id, track_id FROM v_recent")
view("v_um_values", f"""
  SELECT track_id, f, value FROM (SELECT track_id, unnest([{', '.join('0.0::DOUBLE' if c == 'speechiness' else f'cast({c} AS DOUBLE)' for c in F_AUDIO)}]) AS value,
    unnest(range({len(F_AUDIO)})) AS f FROM v_tracks)
""")
view("v_um_numbers", """
  SELECT user_id, f, m, CASE WHEN s <= 1e-12 * greatest(abs(m), 1.0) THEN 1.0::DOUBLE ELSE s END AS s FROM (
    SELECT user_id, f, avg(value) AS m, stddev_pop(value) AS s FROM (
      SELECT user_id, f, value FROM v_um_own JOIN v_um_values USING (track_id)
      UNION ALL SELECT u.user_id, f, value FROM (SELECT DISTINCT user_id FROM v_um_own) u CROSS JOIN v_um_values) GROUP BY 1, 2)
""")
view("v_um_genres", """
  SELECT user_id, genre, n / cast(total AS DOUBLE) AS p FROM (
    SELECT user_id, genre, sum(n) AS n FROM (
      SELECT user_id, genre, count(*) AS n FROM v_um_own JOIN v_tokens USING (track_id) GROUP BY 1, 2
      UNION ALL SELECT u.user_id, genre, n FROM (SELECT DISTINCT user_id FROM v_um_own) u CROSS JOIN (SELECT genre, count(*) AS n FROM v_tokens GROUP BY 1)) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(n) DESC, genre) <= 20)
  JOIN (SELECT user_id, count(*) + (SELECT count(*) FROM v_tracks) AS total FROM v_um_own GROUP BY 1) USING (user_id)
""")
view("v_um_z", """
  SELECT user_id, track_id, list(z ORDER BY o) AS z FROM (
    SELECT user_id, track_id, cast(f AS VARCHAR) AS o, (value - m) / s AS z FROM v_um_numbers JOIN v_um_values USING (f)
    UNION ALL SELECT g.user_id, t.track_id, 'g' || g.genre, (CASE WHEN k.genre IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END - p)
        / CASE WHEN sqrt(p * (1 - p)) <= 1e-12 THEN 1.0::DOUBLE ELSE sqrt(p * (1 - p)) END
      FROM v_um_genres g CROSS JOIN v_tracks t LEFT JOIN v_tokens k ON k.track_id = t.track_id AND k.genre = g.genre) GROUP BY 1, 2
""")
view("v_um_unit", f"SELECT user_id, track_id, [x / CASE WHEN {dot('z', 'z')} > 0 THEN sqrt({dot('z', 'z')}) ELSE 1.0 END for x in z] AS u FROM v_um_z")
view("v_um_match", f"""
  SELECT q.user_id, t.track_id, sum(q.w * {dot('b.u', 't.u')}) AS score,
         row_number() OVER (PARTITION BY q.user_id ORDER BY round(sum(q.w * {dot('b.u', 't.u')}), 9) DESC, t.track_id) AS rank
  FROM (SELECT user_id, track_id, w / sum(w) OVER (PARTITION BY user_id) AS w FROM v_seed_w) q
  JOIN v_um_unit b USING (user_id, track_id) JOIN v_um_unit t ON t.user_id = q.user_id GROUP BY 1, 2 QUALIFY rank <= 5
""")
view("v_play_rows", "SELECT b.user_id, t.* FROM v_b_ranked b JOIN v_tracks t USING (track_id) WHERE bucket = 'mood_based' AND rank <= 10")
_WORKOUT = " + ".join(
    f"greatest(0.0, 1.0::DOUBLE - abs({n} - {t!r}::DOUBLE) / {tol!r}::DOUBLE)" for n, (t, tol) in M.MOOD_PROFILES["workout"]["features"].items()
)


def _chain(names: str, body: str) -> str:
    return with_views(f"SELECT 1 FROM {names}").rsplit("\nSELECT 1", 1)[0] + body


LISTENER_SQL = """
  , ut AS (SELECT user_id, track_id FROM v_recent UNION SELECT user_id, track_id FROM v_dedup),
  ug AS (SELECT user_id, genre, count(*) AS n FROM ut JOIN v_tokens USING (track_id) GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) <= 20),
  v AS (SELECT user_id, track_id, feature_name AS f, value FROM ut JOIN v_raw_features USING (track_id) WHERE pos < 9
        UNION ALL
        SELECT ut.user_id, ut.track_id, 'genre ' || ug.genre, CASE WHEN t.genre IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
        FROM ut JOIN ug USING (user_id) LEFT JOIN v_tokens t ON t.track_id = ut.track_id AND t.genre = ug.genre),
  st AS (SELECT user_id, f, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY 1, 2),
  z AS (SELECT user_id, track_id, f, (value - m) / CASE WHEN s <= 1e-12 * greatest(abs(m), 1.0) THEN 1.0 ELSE s END AS z FROM v JOIN st USING (user_id, f)),
  p AS (SELECT user_id, f, avg(z) AS p FROM z JOIN (SELECT DISTINCT user_id, track_id FROM v_seeds) USING (user_id, track_id) GROUP BY 1, 2),
  c AS (SELECT user_id, track_id, sum(p * z) / nullif(sqrt(sum(p * p)) * sqrt(sum(z * z)), 0) AS score
        FROM z JOIN p USING (user_id, f) SEMI JOIN v_dedup USING (user_id, track_id) ANTI JOIN v_seeds USING (user_id, track_id) GROUP BY 1, 2)
  SELECT user_id, track_id, round(score, 6) AS score FROM c WHERE score > 0
"""
def stream_counts(spark, d):
    """Upserted running counts of a stream of several micro-batches; the watermark is long enough for its disorder."""
    from cadenza.session import ensure_checkpoint_dir
    from cadenza.streaming.incremental import read_running_counts, upsert_running_counts

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/counts-{uuid.uuid4().hex}"
    plays = V.event_plays(spark, d).select("user_id", "track_id", F.col("timestamp").cast("timestamp").alias("ts"))
    plays.repartition(3).write.parquet(f"{base}/in")
    source = spark.readStream.schema(plays.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    upsert_running_counts(source, f"{base}/table", f"{base}/log", watermark="40000 days", bucket="30 days", availableNow=True).awaitTermination()
    out = read_running_counts(spark, f"{base}/table")
    return out.select("user_id", "track_id", "listen_count", F.unix_micros("first_timestamp").alias("first"), F.unix_micros("last_timestamp").alias("last"))


QUERIES = {
    "recent_plays": recent_plays, "seed_tracks": seed_tracks, "recent_distinct": recent_distinct,
    "candidate_expand": candidate_expand, "candidate_dedup": candidate_dedup, "pool_shares": pool_shares,
    "source_counts": source_counts, "pool_summary": pool_summary, "seed_match": seed_match,
    "artist_affinity": artist_affinity, "seed_affinity": seed_affinity, "taste_means": taste_means,
    "top_artists": top_artists, "top_genres": top_genres, "personality": personality, "profile_rows": profile_rows,
    "fixed_cluster_profile": fixed_cluster_profile,
    "taste_signals": taste_signals, "mean_signals": mean_signals, "nearest_references": nearest_references, "first_labels": first_labels,
    "rationale": rationale, "explanation_labels": explanation_labels, "score_breakdown": score_breakdown,
    "union_seed_match": union_seed_match, "history_profile": history_profile, "mood_relevance": mood_relevance, "mood_audio": mood_audio,
    "mood_keyword": mood_keyword, "exploration_labels": exploration_labels, "bucket_topk": bucket_topk,
    "buckets": buckets, "keyword_buckets": keyword_buckets, "adjusted_scores": adjusted_scores,
    "artist_penalty": artist_penalty, "profile_rerank": profile_rerank, "diversity_rerank": diversity_rerank,
    "full_ranking": full_ranking, "listener_content_scores": listener_content_scores, "top_moods": top_moods, "rank_diagnostics": rank_diagnostics, "bucket_overlap": bucket_overlap,
    "playlist_opener": playlist_opener, "playlist_sequence": playlist_sequence, "playlist_export": playlist_export,
    "playlist_duration": playlist_duration, "stream_listens": stream_listens, "stream_counts": stream_counts,
}
ORACLES = {
    "recent_plays": with_views("SELECT user_id, track_id, epoch_us(played_at) AS played_at, pos FROM v_recent"),
    "seed_tracks": with_views("SELECT user_id, track_id, seed_pos FROM v_seeds"),
    "recent_distinct": with_views("""
      SELECT user_id, 'artist' AS kind, v AS value, p AS value_pos FROM v_k_artist UNION ALL SELECT user_id, 'genre', v, p FROM v_k_genre
      UNION ALL SELECT user_id, 'title', t || '/' || a, p FROM v_k_title
      UNION ALL SELECT user_id, 'artist_id', substr(md5(v), 1, 22), p FROM v_k_artist"""),
    "candidate_expand": with_views("SELECT user_id, cast(source AS BIGINT) AS source, value_pos, rank, track_id FROM v_expand"),
    "candidate_dedup": with_views(f"SELECT user_id, track_id, candidate_pos, {_LABELS} AS candidate_sources FROM v_dedup"),
    "pool_shares": with_views("""
      SELECT user_id, track_id, count(*) OVER (PARTITION BY user_id, artist_name) AS candidate_artist_pool_count,
             round(count(*) OVER (PARTITION BY user_id, artist_name) / cast(count(*) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS candidate_artist_pool_share
      FROM v_candidates"""),
    "source_counts": with_views("""
      SELECT user_id, label AS source_label, count(*) AS candidates FROM (SELECT user_id, unnest(sources) AS source FROM v_dedup)
      JOIN v_label USING (source) GROUP BY 1, 2"""),
    "pool_summary": with_views("""
      SELECT r.*, unique_candidates, candidate_artists, max_from_one_artist, raw_candidates - unique_candidates AS duplicates_removed FROM
        (SELECT user_id, count(*) AS raw_candidates, count(*) FILTER (source = 0) AS top_track_candidates, count(*) FILTER (source > 0) AS search_candidates FROM v_expand GROUP BY 1) r
      JOIN (SELECT user_id, count(*) AS unique_candidates FROM v_dedup GROUP BY 1) USING (user_id)
      JOIN (SELECT user_id, count(*) AS candidate_artists, max(n) AS max_from_one_artist FROM
        (SELECT user_id, artist_name, count(*) AS n FROM v_candidates GROUP BY 1, 2) GROUP BY 1) USING (user_id)"""),
    "seed_match": with_views("SELECT user_id, track_id, round(score, 6) AS score, rank FROM v_match"),
    "artist_affinity": with_views("SELECT user_id, artist_name, round(affinity, 6) AS affinity FROM v_aff"),
    "seed_affinity": with_views("""
      SELECT user_id, 'artist' AS kind, artist_name AS name, round(affinity, 6) AS affinity FROM v_seed_artist
      UNION ALL SELECT user_id, 'genre', genre, round(affinity, 6) FROM v_seed_genre"""),
    "taste_means": with_views("""
      SELECT user_id, mood, round(danceability, 6) AS danceability, round(energy, 6) AS energy, round(valence, 6) AS valence,
             round(acousticness, 6) AS acousticness, round(instrumentalness, 6) AS instrumentalness FROM v_means JOIN v_mood USING (user_id)"""),
    "top_artists": with_views("""
      SELECT user_id, artist_name, count(*) AS plays, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, artist_name) AS rank
      FROM v_recent GROUP BY 1, 2 QUALIFY rank <= 5"""),
    "top_genres": with_views("""
      SELECT user_id, genre, count(*) AS tracks, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS rank FROM (
        SELECT user_id, upper(g[1]) || lower(g[2:]) AS genre FROM (SELECT user_id, unnest(string_split(artist_genres, ', ')) AS g FROM v_recent))
      GROUP BY 1, 2 QUALIFY rank <= 5"""),
    "personality": with_views("""
      SELECT user_id, cast(round_even(avg(energy) * 100, 0) AS BIGINT) AS energy_score, cast(round_even(avg(catalog_novelty) * 100, 0) AS BIGINT) AS discovery_score,
             (SELECT d FROM (SELECT x.user_id AS uid, cast(left(y.album_release_date, 4) AS BIGINT) // 10 * 10 AS d FROM v_recent x JOIN v_tracks y USING (track_id)) z
              WHERE z.uid = r.user_id GROUP BY d ORDER BY count(*) DESC, d LIMIT 1) AS favorite_decade
      FROM v_recent r JOIN v_curated USING (track_id) GROUP BY 1"""),
    "profile_rows": with_views("SELECT user_id, track_id, track_name, artist_name, is_recent FROM v_prof JOIN v_tracks USING (track_id)"),
    "fixed_cluster_profile": _chain("v_prof, v_tracks", FIXED_SQL),
    "taste_signals": with_views("SELECT user_id, list_aggregate(signals, 'string_agg', '|') AS signals FROM v_signal"),
    # Two decimals, half to even, of the mean rounded to nine: by whole numbers, as printf would go by the binary value.
    "mean_signals": with_views("""
      SELECT user_id, string_agg(name || ' ' || (h // 100) || '.' || lpad(cast(h % 100 AS VARCHAR), 2, '0'), '|' ORDER BY o) AS signals FROM (
        SELECT user_id, o, name, v // 10000000 + CASE WHEN v % 10000000 > 5000000 OR (v % 10000000 = 5000000 AND (v // 10000000) % 2 = 1) THEN 1 ELSE 0 END AS h FROM (
          SELECT user_id, unnest([0, 1, 2]) AS o, unnest(['energy', 'valence', 'danceability']) AS name,
                 unnest([cast(round(avg(energy) * 1e9) AS BIGINT), cast(round(avg(valence) * 1e9) AS BIGINT), cast(round(avg(danceability) * 1e9) AS BIGINT)]) AS v
          FROM (SELECT DISTINCT user_id, track_id FROM v_recent) JOIN v_tracks USING (track_id) GROUP BY 1)) GROUP BY 1"""),
    "nearest_references": with_views("SELECT user_id, track_id, reference_id, round(similarity, 6) AS similarity, place AS rank FROM v_near"),
    "first_labels": with_views("SELECT user_id, recent_labels, artists FROM v_first"),
    "rationale": with_views("""
      SELECT user_id, track_id, CASE WHEN a THEN 'recent_artist' WHEN len(sh) > 0 THEN 'shared_genre' WHEN len(signals) > 0 THEN 'taste_signals' ELSE 'mood' END AS reason,
             CASE WHEN a THEN artist_name WHEN len(sh) > 0 THEN list_aggregate(sh[1:2], 'string_agg', '|') WHEN len(signals) > 0
                  THEN list_aggregate(signals[1:2], 'string_agg', '|') ELSE mood END AS reason_values
      FROM (SELECT c.user_id, c.track_id, t.artist_name, list_contains(string_split(f.artists, '|'), t.artist_name) AS a, s.signals, m.mood,
                   list_filter(string_split(t.artist_genres, ', '), lambda g: list_contains(s.signals, g)) AS sh
            FROM v_content_top c JOIN v_tracks t USING (track_id) JOIN v_first f USING (user_id) JOIN v_signal s USING (user_id) JOIN v_mood m USING (user_id)
            WHERE c.rank <= 3)"""),
    "explanation_labels": with_views("""
      SELECT user_id, track_id, r.labels AS recent_labels, s.labels AS seed_labels, true AS item_specific FROM
        (SELECT user_id, track_id, string_agg(track_name || ' - ' || artist_name, '|' ORDER BY place) AS labels
         FROM v_near_recent JOIN (SELECT track_id AS reference_id, track_name, artist_name FROM v_tracks) USING (reference_id) GROUP BY 1, 2) r
      JOIN (SELECT user_id, track_id, string_agg(track_name || ' - ' || artist_name, '|' ORDER BY place) AS labels
         FROM v_near JOIN (SELECT track_id AS reference_id, track_name, artist_name FROM v_tracks) USING (reference_id) GROUP BY 1, 2) s USING (user_id, track_id)"""),
    "score_breakdown": with_views(f"""
      SELECT user_id, track_id, any_value(rank) AS rank, round(any_value(score), 6) AS score, string_agg(feature_name, '|' ORDER BY o) AS top_features
      FROM (SELECT r.user_id, r.track_id, r.rank, r.score, z.feature_name,
                   row_number() OVER (PARTITION BY r.user_id, r.track_id ORDER BY
                     round(pz.z * z.z / (sqrt({dot('pv.v', 'pv.v')}) * sqrt({dot('tv.v', 'tv.v')})), 9) DESC, z.feature_name) AS o
            FROM v_content_top r JOIN v_z z USING (track_id)
            JOIN v_profile_z pz ON pz.user_id = r.user_id AND pz.pos = z.pos
            JOIN v_profile pv ON pv.user_id = r.user_id JOIN v_vec tv ON tv.track_id = r.track_id
            WHERE r.rank <= 3 AND NOT (z.feature_name LIKE 'genre_%' AND pz.z <= 0 AND z.z <= 0) QUALIFY o <= 3) GROUP BY 1, 2"""),
    "union_seed_match": with_views("SELECT user_id, track_id, round(score, 6) AS score, rank FROM v_um_match"),
    "history_profile": with_views("""
      SELECT user_id, artists AS recent_artists, (SELECT string_agg(cast(track_id AS VARCHAR), '|' ORDER BY rank) FROM v_um_match WHERE v_um_match.user_id = v_first.user_id) AS seed_track_ids, mood
      FROM v_first JOIN v_mood USING (user_id)"""),
    "mood_relevance": with_views(MOOD_RELEVANCE_SQL),
    "mood_audio": with_views(MOOD_AUDIO_SQL),
    "mood_keyword": MOOD_KEYWORD_SQL,
    "exploration_labels": with_views("""
      SELECT track_id, CASE WHEN x <= 0.25 THEN 'Familiar' WHEN x >= 0.7 THEN 'Exploratory' ELSE 'Balanced' END || ' ' || cast(round_even(x * 100, 0) AS INT) || '%' AS label
      FROM (SELECT track_id, round(catalog_novelty, 3) AS x FROM v_curated)"""),
    "bucket_topk": with_views("SELECT user_id, bucket, rank, track_id, round(score, 6) AS score FROM v_b_ranked WHERE rank <= 10"),
    "keyword_buckets": with_views("SELECT user_id, bucket, rank, track_id, round(score, 6) AS score FROM v_bk_ranked WHERE rank <= 5"),
    "adjusted_scores": _chain("v_candidates", ADJUST_SQL),
    "listener_content_scores": _chain("v_recent, v_dedup, v_seeds, v_raw_features, v_tokens", LISTENER_SQL),
    "artist_penalty": with_views("""
      SELECT user_id, track_id, round(catalog_popularity - p, 6) AS score, round(p, 6) AS artist_penalty FROM (
        SELECT *, 0.01::DOUBLE * (row_number() OVER (PARTITION BY user_id, artist_name ORDER BY round(catalog_popularity, 9) DESC, track_id) - 1) AS p FROM v_candidates)"""),
    "profile_rerank": _chain("v_content_top, v_tracks, v_means, v_mood, v_aff, v_seed_artist, v_seed_genre", RERANK_SQL),
    "bucket_overlap": with_views("""
      , f AS (SELECT user_id, rank, track_id FROM v_b_ranked WHERE bucket = 'familiar' AND rank <= 10),
      m AS (SELECT user_id, rank, track_id FROM v_b_ranked WHERE bucket = 'mood_based' AND rank <= 10)
      SELECT user_id, round(coalesce(s, 0) / cast(n AS DOUBLE), 6) AS overlap, c AS positions_changed FROM
        (SELECT user_id, count(*) AS n FROM f GROUP BY 1) LEFT JOIN (SELECT f.user_id, count(*) AS s FROM f JOIN m USING (user_id, track_id) GROUP BY 1) USING (user_id)
        JOIN (SELECT f.user_id, cast(sum(CASE WHEN f.track_id <> m.track_id THEN 1 ELSE 0 END) AS BIGINT) AS c FROM f JOIN m USING (user_id, rank) GROUP BY 1) USING (user_id)""").replace("\n,", ",", 1),
    "playlist_opener": with_views(f"""
      SELECT user_id, arg_min(track_id, (-round(r, 9), track_id)) AS track_id, round(max(r), 6) AS mood_relevance
      FROM (SELECT *, ({_WORKOUT}) / 5 AS r FROM v_play_rows) GROUP BY 1"""),
    "playlist_export": with_views("""
      SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY ord, track_id) AS position FROM (
        SELECT user_id, track_id, min((CASE bucket WHEN 'familiar' THEN 1 WHEN 'discovery' THEN 2 ELSE 3 END, rank)) AS ord FROM v_b_ranked WHERE rank <= 10 GROUP BY 1, 2)"""),
    "playlist_duration": with_views("""
      SELECT user_id, s AS total_seconds, cast(s // 60 AS VARCHAR) || ':' || lpad(cast(s % 60 AS VARCHAR), 2, '0') AS duration_label
      FROM (SELECT user_id, cast(round_even(sum(duration_ms) / 1000.0, 0) AS BIGINT) AS s FROM v_play_rows GROUP BY 1)"""),
    "stream_counts": with_views("""
      SELECT user_id, track_id, count(*) AS listen_count, epoch_us(min(ts)) AS "first", epoch_us(max(ts)) AS "last" FROM v_event_plays GROUP BY 1, 2"""),
    "stream_listens": with_views("""
      SELECT user_id, track_id, count(*) AS listen_count, cast(count(*) AS DOUBLE) AS interaction_strength,
             arg_min(artist_name, (ts, artist_name)) AS artist_name, arg_min(track_name, (ts, track_name)) AS track_name,
             epoch_us(min(ts)) AS first_timestamp, epoch_us(max(ts)) AS last_timestamp FROM v_listens GROUP BY 1, 2"""),
}
ORACLES["content_candidates"] = with_views(f"""
  , p AS (SELECT user_id, list(z ORDER BY pos) AS v FROM (
      SELECT user_id, pos, avg(z) AS z FROM v_seeds JOIN v_z USING (track_id) GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT d.user_id, d.track_id, {dot('p.v', 't.v')} / (sqrt({dot('p.v', 'p.v')}) * sqrt({dot('t.v', 't.v')})) AS score
        FROM v_dedup d JOIN p USING (user_id) JOIN v_vec t USING (track_id)
        WHERE NOT EXISTS (SELECT 1 FROM v_seeds x WHERE x.user_id = d.user_id AND x.track_id = d.track_id))
  SELECT user_id, track_id, round(score, 6) AS score FROM s WHERE score > 0""").replace("\n,", ",", 1)
