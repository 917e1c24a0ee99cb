"""Blend normalised component scores into one ranking per user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.columns import harmonic, labels_where, rank_key
from cadenza.plans.skew import salted_join, top_k

COMPONENTS = ["collaborative", "content", "novelty", "popularity_prior"]


@dataclass(frozen=True)
class Weights:
    collaborative: float = 1.0
    content: float = 1.0
    novelty: float = 0.0
    popularity_prior: float = 0.0
    discovery: float = 0.0

    @classmethod
    def of(cls, values: dict[str, float]) -> "Weights":
        return cls(**{k: float(v) for k, v in values.items() if k in cls.__dataclass_fields__})


@dataclass(frozen=True)
class BlendWeights:
    hybrid: float = 1.0
    als: float = 0.0
    embedding: float = 0.0


def exploration_weights(level: float) -> Weights:
    """Weights of the known-catalog view for an exploration level in [0, 1]."""
    e = min(max(float(level), 0.0), 1.0)
    f = 1.0 - e
    return Weights(0.8 + 0.6 * f, 0.7 + 0.5 * f, 0.2 + e, 0.35 * f, 0.2 + 0.9 * e)


def candidate_weights(level: float) -> Weights:
    """Weights of the recent-history view: no collaborative part, stronger content and discovery."""
    e = min(max(float(level), 0.0), 1.0)
    f = 1.0 - e
    return Weights(0.0, 1.15 + 0.65 * f, 0.25 + 1.35 * e, 0.4 * f, 0.25 + 1.05 * e)


def min_max(score: Column, group: list[str], *, on_constant: str) -> Column:
    """Min-max over the group's non-null scores.

    A constant group gives: ``one_or_drop`` 1 when positive, else null; ``zero`` 0; ``half`` 0.5.
    Groups are one user's candidates, a bounded set, so the window stays small for every user.
    """
    w = W.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    constant = {
        "one_or_drop": F.when(high > 0, 1.0),
        "zero": F.lit(0.0),
        "half": F.lit(0.5),
    }[on_constant]
    return F.when(score.isNull(), None).when(high == low, constant).otherwise((score - low) / (high - low))


def candidate_universe(*sources: DataFrame) -> DataFrame:
    """Distinct track ids over all given component tables."""
    out = sources[0].select("track_id")
    for s in sources[1:]:
        out = out.union(s.select("track_id"))
    return out.distinct()


def user_history(seeds: DataFrame, interactions: DataFrame) -> DataFrame:
    """Declared seeds and interacted tracks, distinct."""
    return seeds.select("user_id", "track_id").union(interactions.select("user_id", "track_id")).distinct()


def priors(catalog: DataFrame, popularity: str = "popularity") -> DataFrame:
    """(track_id, popularity_prior, novelty): popularity / 100 and its complement."""
    p = F.col(popularity) / 100.0
    return catalog.select("track_id", p.alias("popularity_prior"), (1.0 - p).alias("novelty"))


def component_table(
    candidates: DataFrame,
    track_scores: DataFrame,
    *,
    collaborative: DataFrame | None = None,
    content: DataFrame | None = None,
) -> DataFrame:
    """One row per (user, track) candidate with its raw component scores (null when absent).

    The per-user components are stacked and folded back with one shuffle on the user, which the
    per-user windows of ``hybrid`` then reuse. ``candidates`` may already carry a ``content`` column.
    ``track_scores`` holds (track_id, popularity_prior, novelty); without novelty it is minus popularity.
    """
    if "novelty" not in track_scores.columns:
        track_scores = track_scores.withColumn("novelty", -F.col("popularity_prior"))
    has_inline = "content" in candidates.columns
    empty = F.lit(None).cast("double")
    parts = [
        candidates.select(
            "user_id", "track_id", F.lit(True).alias("candidate"), empty.alias("collaborative"),
            (F.col("content") if has_inline else empty).alias("content"),
        )
    ]
    for name, scores in (("collaborative", collaborative), ("content", content)):
        if scores is not None:
            parts.append(
                scores.select(
                    "user_id", "track_id", F.lit(False).alias("candidate"),
                    *[(F.col("score") if c == name else empty).alias(c) for c in ("collaborative", "content")],
                )
            )
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    if len(parts) > 1:
        folded = (
            stacked.repartition("user_id")
            .groupBy("user_id", "track_id")
            .agg(*[F.max(c).alias(c) for c in ("candidate", "collaborative", "content")])
            .where("candidate")
        )
    else:
        folded = stacked
    kept = track_scores.select("track_id", "popularity_prior", "novelty")
    return salted_join(folded.drop("candidate"), kept, "track_id", spread=["user_id"])


def hybrid(table: DataFrame, weights: Weights, *, k: int | None = 10) -> DataFrame:
    """Ranked (user, track) with the score, its breakdown and a cold-start flag; scores above 0 only."""
    user = W.partitionBy("user_id")
    normal = table.select(
        "user_id", "track_id", *[min_max(F.col(c), ["user_id"], on_constant="one_or_drop").alias(c) for c in COMPONENTS]
    )
    warm = F.max(F.col("collaborative").isNotNull() | F.col("content").isNotNull()).over(user)
    filled = normal.withColumn("cold_start", ~warm).fillna(0.0, COMPONENTS)
    familiar = 0.5 * F.col("collaborative") + 0.5 * F.col("content")
    scored = filled.withColumn("discovery", harmonic(familiar, F.col("novelty")))
    w = weights
    score = (
        w.collaborative * F.col("collaborative") + w.content * F.col("content") + w.novelty * F.col("novelty")
        + w.popularity_prior * F.col("popularity_prior") + w.discovery * F.col("discovery")
    )
    positive = scored.withColumn("score", score).where(F.col("score") > 0)
    if k is None:
        return positive
    return top_k(positive, ["user_id"], [rank_key(F.col("score")).desc(), F.col("track_id")], k)


def advanced_blend(
    base: DataFrame,
    weights: BlendWeights,
    *,
    als: DataFrame | None = None,
    embedding: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """hybrid + als + embedding scores per user, each optional signal min-max scaled over all its scores."""
    parts = [base.select("user_id", "track_id", F.col("score").alias("hybrid_score"))]
    out = parts[0]
    for name, scores in (("als_score", als), ("embedding_score", embedding)):
        if scores is None:
            out = out.withColumn(name, F.lit(0.0))
            continue
        scaled = scores.select(
            "user_id", "track_id", min_max(F.col("score"), ["user_id"], on_constant="zero").alias(name)
        )
        out = out.join(scaled, ["user_id", "track_id"], "left").fillna(0.0, [name])
    score = (
        weights.hybrid * F.col("hybrid_score") + weights.als * F.col("als_score")
        + weights.embedding * F.col("embedding_score")
    )
    reasons = labels_where(
        [
            ((F.lit(weights.als) > 0) & (F.col("als_score") > 0), "als"),
            ((F.lit(weights.embedding) > 0) & (F.col("embedding_score") > 0), "embedding"),
        ]
    )
    blended = out.withColumn("score", score).withColumn("signals", reasons)
    if k is None:
        return blended
    return top_k(blended, ["user_id"], [rank_key(F.col("score")).desc(), F.col("track_id")], k)


def optional_blend(base: DataFrame, *, als: DataFrame | None = None, embedding: DataFrame | None = None) -> DataFrame:
    """Blend whichever signals are given at weight 0.35 each; without any, the ranking stays as it is."""
    if als is None and embedding is None:
        return base
    weights = BlendWeights(1.0, 0.35 if als is not None else 0.0, 0.35 if embedding is not None else 0.0)
    return advanced_blend(base, weights, als=als, embedding=embedding)


def discovery_score(collaborative: Column, content: Column, novelty: Column, familiar_weight: float = 0.5) -> Column:
    """Harmonic mean of familiarity and novelty."""
    return harmonic(familiar_weight * collaborative + (1.0 - familiar_weight) * content, novelty)
