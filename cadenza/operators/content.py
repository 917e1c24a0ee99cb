"""Content ranking: a user's seed profile against track vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import dot, mean_vector, norm, rank_key, unit
from cadenza.plans.skew import salted_join
from cadenza.plans.tiles import TILE_ROWS, inner_products


def seed_profiles(features: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """(user_id, profile): mean vector of each user's known seed tracks.

    ``size`` is the vector length. A track that many users share is spread over tasks, and the mean is
    a partial aggregate, so neither a hot track nor a hot user gathers its rows.
    """
    joined = salted_join(seeds.select("user_id", "track_id"), features, "track_id", spread=["user_id"], how="inner")
    return joined.groupBy("user_id").agg(mean_vector("features", size).alias("profile"))


def content_topk(
    features: DataFrame,
    seeds: DataFrame,
    size: int,
    *,
    k: int | None = 10,
    seen: DataFrame | None = None,
    pool: DataFrame | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(user_id, track_id, score, rank): cosine above 0, seeds and seen tracks excluded, top k.

    ``pool`` limits the candidate tracks; ``k=None`` returns every positive score.
    """
    profiles = seed_profiles(features, seeds, size).select("user_id", unit(F.col("profile")).alias("u"))
    tracks = features if pool is None else features.join(pool.select("track_id").distinct(), "track_id", "left_semi")
    excluded = seeds.select("user_id", "track_id")
    if seen is not None:
        excluded = excluded.unionByName(seen.select("user_id", "track_id"))
    return inner_products(
        profiles, tracks.select("track_id", unit(F.col("features")).alias("u")),
        query="user_id", item="track_id", vector="u", k=k, floor=0.0, exclude=excluded, tile_rows=tile_rows,
    )


def content_table(
    features: DataFrame, seeds: DataFrame, size: int, pool: DataFrame, seen: DataFrame, *, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(user_id, track_id, content): every unseen pool track per user, content null when not positive.

    Candidates and their content scores leave the tiles together, so a blend starts from one table.
    """
    profiles = seed_profiles(features, seeds, size).select("user_id", unit(F.col("profile")).alias("u"))
    tracks = features.join(pool.select("track_id").distinct(), "track_id", "left_semi")
    scored = inner_products(
        profiles, tracks.select("track_id", unit(F.col("features")).alias("u")),
        query="user_id", item="track_id", vector="u", exclude=seen.select("user_id", "track_id"), tile_rows=tile_rows,
    )
    return scored.select("user_id", "track_id", F.when(F.col("score") > 0, F.col("score")).alias("content"))


def content_scores(features: DataFrame, seeds: DataFrame, size: int, candidates: DataFrame) -> DataFrame:
    """Positive content scores for given (user, track) candidates only."""
    profiles = seed_profiles(features, seeds, size).select("user_id", unit(F.col("profile")).alias("p"))
    unseen = candidates.select("user_id", "track_id").join(
        seeds.select("user_id", "track_id"), ["user_id", "track_id"], "left_anti"
    )
    vectors = features.select("track_id", unit(F.col("features")).alias("v"))
    joined = salted_join(unseen, vectors, "track_id", spread=["user_id"], how="inner")
    joined = salted_join(joined, profiles, "user_id", spread=["track_id"], how="inner")
    return joined.select("user_id", "track_id", dot(F.col("p"), F.col("v")).alias("score")).where(F.col("score") > 0)


def content_explain(
    features: DataFrame, names: list[str], seeds: DataFrame, candidates: DataFrame, *, top_n: int = 5
) -> DataFrame:
    """Largest per-feature contributions to the cosine of each (user, track) candidate.

    A genre feature that is not positive on either side is left out. The best ``top_n`` are taken in
    the row's own array, so no per-feature rows are shuffled.
    """
    size = len(names)
    profiles = seed_profiles(features, seeds, size)
    joined = salted_join(candidates.select("user_id", "track_id"), features, "track_id", spread=["user_id"], how="inner")
    joined = salted_join(joined, profiles, "user_id", spread=["track_id"], how="inner")
    joined = joined.withColumn("scale", norm(F.col("profile")) * norm(F.col("features")))
    label_array = F.array(*[F.lit(n) for n in names])

    def part(f, i):
        p = F.get(F.col("profile"), i)
        share = F.when(F.col("scale") > 0, p * f / F.col("scale")).otherwise(0.0)
        name = F.get(label_array, i)
        return F.struct(
            (-rank_key(share)).alias("order"),
            name.alias("feature_name"), p.alias("seed_value"), f.alias("candidate_value"), share.alias("contribution"),
        )

    def useful(x):
        return ~(x["feature_name"].startswith("genre_") & (x["seed_value"] <= 0) & (x["candidate_value"] <= 0))

    best = F.slice(F.array_sort(F.filter(F.transform(F.col("features"), part), useful)), 1, top_n)
    return joined.select("user_id", "track_id", F.posexplode(best).alias("pos", "c")).select(
        "user_id", "track_id", (F.col("pos") + 1).alias("rank"),
        "c.feature_name", "c.seed_value", "c.candidate_value", "c.contribution",
    )


def with_display(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach track and artist names; an unknown track shows its id and an empty artist."""
    from cadenza.functions.text import first_non_blank, non_blank

    def column(name: str):
        return F.col(name).cast("string") if name in catalog.columns else F.lit(None).cast("string")

    names = catalog.select(
        "track_id",
        first_non_blank(column("track_name"), column("name"), F.col("track_id").cast("string")).alias("track_name"),
        first_non_blank(column("artist_name"), column("primary_artist_name"), column("artist_names")).alias("artist_name"),
    ).dropDuplicates(["track_id"])
    shown = salted_join(ranked, names, "track_id", spread=["user_id"])
    return shown.withColumn(
        "track_name", F.coalesce(non_blank(F.col("track_name")), F.col("track_id").cast("string"))
    ).withColumn("artist_name", F.coalesce("artist_name", F.lit("")))
