"""Listener profiles: affinities, taste means, clusters, labels, and the facts behind an explanation.

Everything per user starts from recent plays (at most 20) and seeds, so the per-user windows and maps
below are bounded for every listener.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.columns import dot, labels_where, rank_key, try_double, unit
from cadenza.functions.text import (
    first_non_blank, genre_labels, is_blank, non_blank, release_decade, split_list, strip, track_label,
)
from cadenza.operators.mood import preferred_mood
from cadenza.operators.rerank import TASTE_COLUMNS
from cadenza.plans.skew import salted_join, top_k

MIN_TRACKS_FOR_MAP = 3


# --- affinities -----------------------------------------------------------------------------------


def _shares(rows: DataFrame, name: str) -> DataFrame:
    """Sum of weights per (user, name) over the user's total."""
    sums = rows.groupBy("user_id", name).agg(F.sum("w").alias("w"))
    return sums.select("user_id", name, (F.col("w") / F.sum("w").over(W.partitionBy("user_id"))).alias("affinity"))


def _weight(pos: str) -> Column:
    """Linear recency weight: length of the user's list minus the position, at least 1."""
    n = F.max(pos).over(W.partitionBy("user_id")) + 1
    return F.greatest(n - F.col(pos), F.lit(1)).cast("double")


def artist_affinity(recent: DataFrame, *, split: bool = True) -> DataFrame:
    """(user_id, artist_name, affinity): recency-weighted share of each recent artist.

    With ``split`` every artist of a multi-artist text counts; without it the whole text is one name.
    """
    names = split_list(F.col("artist_name")) if split else F.array(strip(F.col("artist_name")))
    rows = recent.select("user_id", _weight("pos").alias("w"), F.explode(names).alias("artist_name"))
    return _shares(rows.where(F.col("artist_name") != ""), "artist_name")


def seed_affinity(seeds: DataFrame, catalog: DataFrame, *, genres: bool = False) -> DataFrame:
    """Same share over seed rank: by catalog artist, or by genre label."""
    info = catalog.select("track_id", "artist_name", "artist_genres")
    joined = salted_join(seeds, info, "track_id", spread=["user_id"]).withColumn("w", _weight("seed_pos"))
    if genres:
        rows = joined.select("user_id", "w", F.explode(genre_labels(F.col("artist_genres"))).alias("genre"))
        return _shares(rows, "genre")
    rows = joined.select("user_id", "w", strip(F.coalesce("artist_name", F.lit(""))).alias("artist_name"))
    return _shares(rows.where(F.col("artist_name") != ""), "artist_name")


def taste_means(recent: DataFrame, tracks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(user_id, mean per column) over the user's distinct recent tracks; missing values are ignored."""
    columns = columns or [*TASTE_COLUMNS, "instrumentalness"]
    distinct = recent.select("user_id", "track_id").distinct()
    joined = salted_join(distinct, tracks.select("track_id", *columns), "track_id", spread=["user_id"], how="inner")
    return joined.groupBy("user_id").agg(*[F.avg(try_double(F.col(c), None)).alias(c) for c in columns])


def infer_mood(means: DataFrame) -> DataFrame:
    """(user_id, mood) from the mean features; missing means are neutral."""
    value = {c: F.coalesce(F.col(c), F.lit(0.5)) for c in TASTE_COLUMNS}
    mood = preferred_mood(
        value["energy"], value["danceability"], value["valence"], value["acousticness"],
        F.coalesce("instrumentalness", F.lit(0.0)),
    )
    return means.select("user_id", mood.alias("mood"))


def user_signals(recent: DataFrame, seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per user with the affinity maps, taste means and mood that ``rerank_profile`` reads."""

    def as_map(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "affinity"))).alias(name))

    means = taste_means(recent, catalog)
    parts = [
        as_map(artist_affinity(recent, split=False), "artist_name", "recent_artists"),
        as_map(seed_affinity(seeds, catalog), "artist_name", "seed_artists"),
        as_map(seed_affinity(seeds, catalog, genres=True), "genre", "genres"),
        means.select("user_id", F.array(*TASTE_COLUMNS).alias("taste")),
        infer_mood(means),
    ]
    out = recent.select("user_id").distinct()
    for p in parts:
        out = out.join(p, "user_id", "left")
    return out


# --- tops and summary values ----------------------------------------------------------------------


def top_artists(recent: DataFrame, *, limit: int = 5) -> DataFrame:
    """(user_id, rank, artist_name, plays) by count, ties by name."""
    rows = recent.select("user_id", F.explode(split_list(F.col("artist_name"))).alias("artist_name"))
    counts = rows.groupBy("user_id", "artist_name").agg(F.count(F.lit(1)).alias("plays"))
    return top_k(counts, ["user_id"], [F.desc("plays"), F.col("artist_name")], limit)


def top_genres(tracks: DataFrame, *, limit: int = 5) -> DataFrame:
    """(user_id, rank, genre, tracks) over per-user track rows, title-cased labels, ties by name."""
    labels = split_list(F.replace(F.col("artist_genres"), F.lit("|"), F.lit(",")))
    rows = tracks.select("user_id", F.explode(labels).alias("g")).select(
        "user_id", F.initcap(F.replace("g", F.lit("_"), F.lit(" "))).alias("genre")
    )
    counts = rows.groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("tracks"))
    return top_k(counts, ["user_id"], [F.desc("tracks"), F.col("genre")], limit)


def personality(rows: DataFrame) -> DataFrame:
    """(user_id, favorite_decade, energy_score, discovery_score) over recent and candidate rows.

    Discovery is the mean novelty, or the share of search-found candidates when novelty is absent.
    """
    decade = release_decade(F.col("album_release_date")) if "album_release_date" in rows.columns else F.lit(None).cast("int")
    if "catalog_novelty" in rows.columns:
        discovery = F.avg(try_double(F.col("catalog_novelty"), None))
    elif "candidate_sources" in rows.columns:
        discovery = F.avg(F.lower(F.coalesce("candidate_sources", F.lit(""))).contains("search").cast("double"))
    else:
        discovery = F.lit(None).cast("double")
    values = rows.withColumn("_decade", decade)
    scores = values.groupBy("user_id").agg(
        F.bround(F.avg(try_double(F.col("energy"), None)) * 100, 0).cast("int").alias("energy_score"),
        F.bround(discovery * 100, 0).cast("int").alias("discovery_score"),
    )
    decades = values.where(F.col("_decade").isNotNull()).groupBy("user_id", "_decade").agg(F.count(F.lit(1)).alias("n"))
    favorite = decades.groupBy("user_id").agg(
        F.min_by("_decade", F.struct(-F.col("n"), "_decade")).alias("favorite_decade")
    )
    return scores.join(favorite, "user_id", "left")


# --- taste profile --------------------------------------------------------------------------------


def profile_rows(recent_tracks: DataFrame, candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Recent and candidate tracks per user, first occurrence kept (recent before candidate).

    ``map_order`` is the place of a row in the listener's list: recent rows by ``pos``, then candidates by ``candidate_pos``.
    """

    def placed(df: DataFrame, source: int, pos: str) -> DataFrame:
        at = F.col(pos).cast("long") if pos in df.columns else F.lit(0).cast("long")
        return df.withColumn("map_order", F.struct(F.lit(source).alias("source"), at.alias("pos"))).drop(pos)

    marked = candidates.join(seeds.select("user_id", "track_id", F.lit(True).alias("s")), ["user_id", "track_id"], "left")
    a = placed(recent_tracks.withColumn("is_recent", F.lit(True)), 0, "pos")
    b = placed(marked.withColumn("is_recent", F.coalesce("s", F.lit(False))).drop("s"), 1, "candidate_pos")
    both = a.unionByName(b, allowMissingColumns=True)
    first = top_k(both, ["user_id", "track_id"], [F.col("map_order")], 1).drop("rank")

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in first.columns else F.lit(None).cast("string")

    return first.withColumns(
        {
            "track_name": F.coalesce(text("track_name"), F.col("track_id").cast("string")),
            "artist_name": first_non_blank(text("artist_name"), text("primary_artist_name"), text("artist_names")),
            "artist_genres": F.coalesce(text("artist_genres"), F.lit("")),
        }
    )


def dominant_cluster(rows: DataFrame) -> DataFrame:
    """(user_id, cluster_id): most common cluster among recent rows, else among all; ties by id."""
    counts = rows.groupBy("user_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_recent"), 1)).alias("r")
    )
    recents = F.sum("r").over(W.partitionBy("user_id"))
    votes = counts.withColumn("votes", F.when(recents > 0, F.col("r")).otherwise(F.col("n")))
    return votes.groupBy("user_id").agg(
        F.min_by("cluster_id", F.struct(-F.col("votes"), "cluster_id")).alias("cluster_id")
    )


def cluster_label(rows: DataFrame, dominant: DataFrame) -> DataFrame:
    """(user_id, cluster_id, cluster_label) from the means and top five genres of the dominant cluster."""
    inside = rows.join(dominant, ["user_id", "cluster_id"], "left_semi")
    means = inside.groupBy("user_id").agg(
        *[(F.coalesce(F.avg(try_double(F.col(c), None)), F.lit(0.5)) if c in rows.columns else F.lit(0.5)).alias(c) for c in TASTE_COLUMNS]
    )
    genres = top_genres(inside).groupBy("user_id").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "genre"))), lambda x: x["genre"]), " ")).alias("g")
    )
    g = F.coalesce("g", F.lit(""))
    label = (
        F.when((F.col("energy") >= 0.72) & (F.col("danceability") >= 0.62), "Dance / Workout Mix")
        .when((F.col("acousticness") >= 0.62) | ((F.col("energy") <= 0.42) & (F.col("valence") <= 0.55)), "Chill Acoustic Listening")
        .when(g.contains("indie") | g.contains("alternative") | g.contains("bedroom"), "Indie / Alternative Discovery")
        .when(g.contains("pop"), "Pop Familiarity")
        .when(F.col("energy") >= 0.65, "High-Energy Discovery")
        .otherwise("Balanced Listener")
    )
    return means.join(genres, "user_id", "left").join(dominant, "user_id").select(
        "user_id", "cluster_id", label.alias("cluster_label")
    )


def taste_points(rows: DataFrame, map_2d: DataFrame, clusters: DataFrame) -> DataFrame:
    """Point per (user, track): coordinates, cluster and whether it is recent."""
    at = map_2d.join(clusters, "track_id")
    joined = salted_join(rows, at, "track_id", spread=["user_id"], how="inner")
    return joined.select("user_id", "track_id", "track_name", "artist_name", "x", "y", "cluster_id", "is_recent")


def taste_profile(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(user_id, tracks, cluster_id, cluster_label); fewer than three tracks give "Not enough data".

    The clusters are one model over the catalog that all listeners share.
    """
    labelled = salted_join(rows, clusters, "track_id", spread=["user_id"], how="inner")
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("tracks"))
    labels = cluster_label(labelled, dominant_cluster(labelled))
    enough = F.col("tracks") >= MIN_TRACKS_FOR_MAP
    return sizes.join(labels, "user_id", "left").select(
        "user_id", "tracks", F.when(enough, F.col("cluster_id")).alias("cluster_id"),
        F.when(enough, F.col("cluster_label")).otherwise("Not enough data").alias("cluster_label"),
    )


# --- explanation facts ----------------------------------------------------------------------------


def first_labels(rows: DataFrame, label: Column, pos: str, *, limit: int = 3, name: str = "labels") -> DataFrame:
    """(user_id, labels): first distinct non-empty labels in order."""
    first = rows.select("user_id", label.alias("l"), pos).where(~is_blank(F.col("l"))).groupBy("user_id", "l").agg(
        F.min(pos).alias("at")
    )
    kept = top_k(first, ["user_id"], [F.col("at"), F.col("l")], limit)
    return kept.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "l"))), lambda x: x["l"]).alias(name)
    )


def taste_signals(means: DataFrame, seeds: DataFrame, catalog: DataFrame, *, genres: int = 2) -> DataFrame:
    """(user_id, signals): threshold labels, then the top seed genres."""
    m = {c: F.coalesce(F.col(c), F.lit(0.5)) for c in TASTE_COLUMNS}
    labels = labels_where(
        [
            (m["energy"] >= 0.72, "high-energy"), (m["danceability"] >= 0.68, "dance-forward"),
            (m["valence"] >= 0.68, "feel-good"), (m["valence"] <= 0.35, "moody"),
            (m["acousticness"] >= 0.55, "acoustic-leaning"),
        ]
    )
    info = catalog.select("track_id", genre_labels(F.col("artist_genres")).alias("g"))
    rows = salted_join(seeds, info, "track_id", spread=["user_id"], how="inner").select("user_id", F.explode("g").alias("genre"))
    counts = rows.groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    top = top_k(counts, ["user_id"], [F.desc("n"), F.col("genre")], genres)
    names = top.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "genre"))), lambda x: x["genre"]).alias("g")
    )
    base = means.select("user_id", labels.alias("t"))
    both = base.join(names, "user_id", "full")
    none = F.array().cast("array<string>")
    return both.select(
        "user_id", F.array_distinct(F.concat(F.coalesce("t", none), F.coalesce("g", none))).alias("signals")
    )


# The columns of the short signal list, and what stands for a listener without any.
MEAN_SIGNALS, NO_SIGNALS = ["energy", "valence", "danceability"], "metadata-only recent listening"


def mean_signals(recent_tracks: DataFrame) -> DataFrame:
    """(user_id, signals): each of three columns with its mean over the listener's rows, two decimals, where it has one."""
    present = [c for c in MEAN_SIGNALS if c in recent_tracks.columns]
    means = recent_tracks.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(try_double(F.col(c), None)).alias(c) for c in present])
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} "), F.format_string("%.2f", F.bround(F.round(c, 9), 2)))) for c in present]
    signals = F.array_compact(F.array(*parts).cast("array<string>"))
    return means.select("user_id", F.when(F.size(signals) > 0, signals).otherwise(F.array(F.lit(NO_SIGNALS))).alias("signals"))


def nearest_references(
    ranked: DataFrame, references: DataFrame, ranked_vectors: DataFrame, reference_vectors: DataFrame, *, k: int = 2
) -> DataFrame:
    """(user_id, track_id, reference_id, similarity, rank): closest of the user's references per recommendation.

    ``references`` is (user_id, reference_id, ref_pos), a short list per user; ties go to the earlier one. Vectors are
    fetched for the two lists and the pairs made beside them, user by user, so no pair carries vectors through a shuffle.
    """

    def fetched(rows: DataFrame, key: str, vectors: DataFrame, name: str) -> DataFrame:
        units = vectors.select(F.col(vectors.columns[0]).alias(key), unit(F.col("features")).alias(name))
        return salted_join(rows, units, key, spread=["user_id"], how="inner")

    left = fetched(ranked.select("user_id", F.col("track_id").alias("left_id")), "left_id", ranked_vectors, "lu")
    right = references.select("user_id", F.col("reference_id").alias("right_id"), "ref_pos")
    pairs = left.join(fetched(right, "right_id", reference_vectors, "ru"), "user_id").where(F.col("left_id") != F.col("right_id"))
    scored = pairs.select("user_id", "left_id", "right_id", "ref_pos", dot(F.col("lu"), F.col("ru")).alias("similarity"))
    best = top_k(
        scored, ["user_id", "left_id"], [rank_key(F.col("similarity")).desc(), F.col("ref_pos")], k
    )
    return best.select(
        "user_id", F.col("left_id").alias("track_id"), F.col("right_id").alias("reference_id"), "ref_pos", "similarity", "rank"
    )


def rationale(
    ranked: DataFrame, catalog: DataFrame, artists: DataFrame, signals: DataFrame, moods: DataFrame, *, genres: int = 2
) -> DataFrame:
    """(user_id, track_id, reason, reason_values): artist match, else shared genre, else signals, else mood.

    ``artists`` is (user_id, artists array of recent names), ``signals`` (user_id, signals array).
    """
    info = catalog.select("track_id", strip(F.coalesce("artist_name", F.lit(""))).alias("artist"), genre_labels(F.col("artist_genres")).alias("g"))
    rows = salted_join(ranked.select("user_id", "track_id"), info, "track_id", spread=["user_id"])
    for part in (artists, signals, moods):
        rows = rows.join(part, "user_id", "left")
    none = F.array().cast("array<string>")
    sig = F.coalesce("signals", none)
    shared = F.array_intersect(F.coalesce("g", none), sig)
    by_artist = (F.col("artist") != "") & F.array_contains(F.coalesce("artists", none), F.col("artist"))
    return rows.select(
        "user_id", "track_id",
        F.when(by_artist, "recent_artist").when(F.size(shared) > 0, "shared_genre")
        .when(F.size(sig) > 0, "taste_signals").when(non_blank(F.col("mood")).isNotNull(), "mood")
        .otherwise("general").alias("reason"),
        F.when(by_artist, F.array("artist")).when(F.size(shared) > 0, F.slice(shared, 1, genres))
        .when(F.size(sig) > 0, F.slice(sig, 1, genres)).when(non_blank(F.col("mood")).isNotNull(), F.array("mood"))
        .otherwise(none).alias("reason_values"),
    )


def enrich(
    ranked: DataFrame, nearest_recent: DataFrame, nearest_seeds: DataFrame, recent_labels: DataFrame,
    seed_labels: DataFrame, labels: DataFrame,
) -> DataFrame:
    """Each recommendation with the labels of its own nearest recents and seeds, else the user's lists.

    ``labels`` is (track_id, label).
    """

    def own(nearest: DataFrame, name: str) -> DataFrame:
        ids = labels.select(F.col("track_id").alias("reference_id"), "label")
        named = salted_join(nearest, ids, "reference_id", spread=["user_id", "track_id"], how="inner")
        return named.groupBy("user_id", "track_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias(name)
        )

    rows = ranked.select("user_id", "track_id")
    rows = rows.join(own(nearest_recent, "own_recent"), ["user_id", "track_id"], "left")
    rows = rows.join(own(nearest_seeds, "own_seeds"), ["user_id", "track_id"], "left")
    rows = rows.join(recent_labels.withColumnRenamed("labels", "all_recent"), "user_id", "left")
    rows = rows.join(seed_labels.withColumnRenamed("labels", "all_seeds"), "user_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "user_id", "track_id",
        F.coalesce("own_recent", "all_recent", none).alias("recent_labels"),
        F.coalesce("own_seeds", "all_seeds", none).alias("seed_labels"),
        F.col("own_recent").isNotNull().alias("item_specific"),
    )


def score_breakdown(ranked: DataFrame, explained: DataFrame, *, features: int = 3) -> DataFrame:
    """Ranked rows with their component scores and the names of the top content features."""
    top = explained.where(F.col("rank") <= features).groupBy("user_id", "track_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature_name"))), lambda x: x["feature_name"]).alias("top_features")
    )
    return ranked.join(top, ["user_id", "track_id"], "left")


def history_profile(recent: DataFrame, matched: DataFrame, moods: DataFrame) -> DataFrame:
    """(user_id, recent_artists, seed_track_ids, mood): the profile row made from recent history."""
    artists = first_labels(recent, strip(F.col("artist_name")), "pos", name="recent_artists")
    seeds = matched.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "track_id"))), lambda x: x["track_id"]).alias("seed_track_ids")
    )
    return artists.join(seeds, "user_id", "left").join(moods, "user_id", "left")


def play_label() -> Column:
    return track_label(F.col("track_name"), F.col("artist_name"))
