"""Re-score and reorder candidate lists: profile boosts, artist repetition, focus controls, diversity, buckets.

Lists are one user's candidates. The candidate stage bounds them (80); the diversity order also takes long ones.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cadenza.functions.columns import RANK_DIGITS, labels_where, rank_key, total, try_double
from cadenza.functions.text import genre_labels, is_blank, strip
from cadenza.operators.hybrid import min_max
from cadenza.operators.mood import mood_score, rule_mood_match
from cadenza.plans.skew import salted_join, top_k

# Boosts of the profile rerank.
ARTIST_BOOST, GENRE_BOOST, TASTE_BOOST, MOOD_BOOST = 0.025, 0.025, 0.04, 0.015
REPEAT_PENALTY = 0.01
TASTE_COLUMNS = ["danceability", "energy", "valence", "acousticness"]
# Weights per ranking focus; any other focus is "balanced".
FOCUS_WEIGHTS = {
    "familiar": {"base": 0.65, "familiar": 2.35, "discovery": 0.35, "mood": 0.85},
    "discovery": {"base": 0.55, "familiar": 0.30, "discovery": 2.60, "mood": 0.85},
    "mood-first": {"base": 0.25, "familiar": 0.35, "discovery": 0.45, "mood": 4.20},
    "balanced": {"base": 1.50, "familiar": 1.0, "discovery": 1.0, "mood": 0.25},
}
DIVERSITY_STRENGTH = {"discovery": 1.0, "familiar": 0.45, "mood-first": 0.35, "balanced": 0.75}
# Greedy diversity rerank.
ARTIST_PENALTY, NOVELTY_BONUS, SOURCE_BONUS = 0.95, 0.35, 0.12
CAP_LOW, CAP_HIGH, CAP_SWITCH = 4, 2, 0.65


def focus_key(focus: str) -> str:
    key = focus.strip().lower()
    return key if key in FOCUS_WEIGHTS else "balanced"


def _user_order() -> list[Column]:
    return [rank_key(F.col("score")).desc(), F.col("track_id")]


def repeat_count(artist: Column, order: list[Column]) -> Column:
    """How many earlier rows of the user's list have the same artist; a blank artist never counts."""
    w = W.partitionBy("user_id", artist).orderBy(*order)
    return F.when(is_blank(artist), 0).otherwise(F.row_number().over(w) - 1)


def penalize_artist(ranked: DataFrame, *, penalty: float | Column = REPEAT_PENALTY) -> DataFrame:
    """Lower each repeated artist by penalty x earlier rows; adds ``artist_penalty``. Artist is trimmed text."""
    p = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    loss = p * repeat_count(strip(F.col("artist_name")), _user_order())
    return ranked.withColumn("artist_penalty", loss).withColumn("score", F.col("score") - F.col("artist_penalty"))


def rerank_profile(ranked: DataFrame, catalog: DataFrame, signals: DataFrame) -> DataFrame:
    """Small additive boosts from a user's signals, then the repeated-artist penalty.

    ``signals`` has one row per user: maps recent_artists, seed_artists, genres (name -> affinity),
    an array taste (means of TASTE_COLUMNS, null when unknown) and mood. The maps come from at most 20
    recent plays and a few seeds, so they are bounded. A user without signals keeps the ranking.
    Returns score, score_before, adjustment, reasons and the new rank.
    """
    info = catalog.select("track_id", "artist_name", "artist_genres", *TASTE_COLUMNS, "instrumentalness")
    # One track may be recommended to a third of all users; a user has one short list.
    rows = salted_join(ranked.select("user_id", "track_id", "score"), info, "track_id", spread=["user_id"])
    rows = rows.join(signals, "user_id", "left")
    artist = strip(F.coalesce("artist_name", F.lit("")))

    def affinity(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(name), artist), F.lit(0.0))

    artist_part = ARTIST_BOOST * F.least(F.greatest(affinity("recent_artists"), affinity("seed_artists")) * 4.0, F.lit(1.0))
    shares = F.transform(
        genre_labels(F.col("artist_genres")), lambda g: F.coalesce(F.try_element_at(F.col("genres"), g), F.lit(0.0))
    )
    genre_part = GENRE_BOOST * F.least(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) * 3.0, F.lit(1.0))
    gaps = F.array_compact(
        F.array(*[F.abs(try_double(F.col(c), None) - F.col("taste")[i]) for i, c in enumerate(TASTE_COLUMNS)])
    )
    mean_gap = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size(gaps)
    taste = F.when(F.size(gaps) > 0, F.greatest(F.lit(0.0), 1.0 - mean_gap)).otherwise(0.0)
    taste_part = TASTE_BOOST * F.coalesce(taste, F.lit(0.0))
    mood_part = MOOD_BOOST * F.coalesce(rule_mood_match(F.col("mood")), F.lit(0.0))
    known = (
        (F.coalesce(F.size("recent_artists"), F.lit(0)) > 0) | (F.coalesce(F.size("seed_artists"), F.lit(0)) > 0)
        | (F.coalesce(F.size("genres"), F.lit(0)) > 0)
        | F.coalesce(F.exists("taste", lambda x: x.isNotNull()), F.lit(False))
    )
    boosted = rows.select(
        "user_id", "track_id", "artist_name", known.alias("known"), F.col("score").alias("score_before"),
        artist_part.alias("a"), genre_part.alias("g"), taste_part.alias("t"), mood_part.alias("m"),
    )
    boosted = boosted.withColumn(
        "score", F.when(F.col("known"), F.col("score_before") + F.col("a") + F.col("g") + F.col("t") + F.col("m")).otherwise(F.col("score_before"))
    )
    lowered = penalize_artist(boosted, penalty=F.when(F.col("known"), REPEAT_PENALTY).otherwise(0.0))
    reasons = labels_where(
        [
            (F.col("a") > 0, "recent_artist"), (F.col("g") > 0, "seed_genre"), (F.col("t") > 0, "taste_profile"),
            (F.col("m") > 0, "recent_mood"), (F.col("artist_penalty") > 0, "artist_repetition"),
        ]
    )
    scored = lowered.select(
        "user_id", "track_id", "artist_name", "score", "score_before",
        (F.col("score") - F.col("score_before")).alias("adjustment"),
        F.when(F.col("known"), reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(*_user_order())))


def adjust_scores(
    candidates: DataFrame, *, exploration: float, mood: str, focus: str = "balanced"
) -> DataFrame:
    """Control-sensitive score of ranked candidates.

    Needs user_id, track_id, score, artist_affinity, candidate_sources (text), catalog_popularity,
    catalog_novelty and the mood columns. The base score is min-max scaled per user (constant: 0.5).
    """
    e = min(max(float(exploration), 0.0), 1.0)
    familiar = 1.0 - e
    fw = FOCUS_WEIGHTS[focus_key(focus)]
    sources = F.lower("candidate_sources")
    search, top = sources.contains("search"), sources.contains("top track")
    popularity = try_double(F.col("catalog_popularity"))
    novelty = try_double(F.col("catalog_novelty"))
    affinity = F.coalesce("artist_affinity", F.lit(0.0))
    terms = [
        fw["base"] * min_max(F.col("score"), ["user_id"], on_constant="half"),
        2.35 * fw["familiar"] * familiar * affinity,
        1.40 * fw["familiar"] * familiar * popularity,
        F.when(top, 2.10 * fw["familiar"] * familiar).otherwise(0.0),
        3.25 * fw["mood"] * mood_score(mood, candidates.columns),
        2.45 * fw["discovery"] * e * novelty,
        F.when(search, 2.05 * fw["discovery"] * e).otherwise(0.0),
        -1.35 * fw["discovery"] * e * affinity,
        -1.05 * fw["discovery"] * e * popularity,
        F.when(top, -1.15 * fw["discovery"] * e).otherwise(0.0),
    ]
    adjusted = candidates.withColumn("score", total(terms))
    if e < 0.5 and focus_key(focus) != "discovery":
        return adjusted
    factor = {"discovery": 1.85, "mood-first": 0.65}.get(focus_key(focus), 1.0)
    return penalize_artist(adjusted, penalty=0.55 * factor * float(exploration)).drop("artist_penalty")


def greedy_order(fixed, artist, source, ids, *, cap: int, penalty: float, source_bonus: float, steps: int) -> list[tuple[int, float]]:
    """(row, value) of each step, rows being sorted by falling ``fixed`` and id; artist and source are codes, -1 for none.

    The value of a run's head is its fixed part, less the penalty for each earlier row of its artist, plus the bonus
    while its source is new. Values only fall, so a heap entry that is out of date is put back with its present
    value, and the first one that is right wins. Runs of an artist at the cap wait in a heap of their own, which is
    used only when no other run is left.
    """
    runs: dict[tuple[int, int], list[int]] = {}
    for row, key in enumerate(zip(artist.tolist(), source.tolist())):
        runs.setdefault(key, []).append(row)
    for run in runs.values():
        run.reverse()
    fixed, ids = fixed.tolist(), ids.tolist()
    repeats: dict[int, int] = {}
    used: set[int] = set()

    def entry(key: tuple[int, int]) -> tuple[float, int, float, tuple[int, int]]:
        own, src = key
        row = runs[key][-1]
        value = fixed[row] + source_bonus * (src >= 0 and src not in used) - penalty * (repeats.get(own, 0) if own >= 0 else 0)
        return -round(value, RANK_DIGITS), ids[row], value, key

    free, waiting = [entry(key) for key in runs], []
    heapq.heapify(free)
    out: list[tuple[int, float]] = []
    while len(out) < steps and (free or waiting):
        heap = free or waiting
        _, _, value, key = heapq.heappop(heap)
        now = entry(key)
        if heap is free and repeats.get(key[0], 0) >= cap:
            heapq.heappush(waiting, now)
            continue
        if now[2] != value:
            heapq.heappush(heap, now)
            continue
        own, src = key
        out.append((runs[key].pop(), value))
        if own >= 0:
            repeats[own] = repeats.get(own, 0) + 1
        if src >= 0:
            used.add(src)
        if runs[key]:
            heapq.heappush(waiting if own >= 0 and repeats[own] >= cap else free, entry(key))
    return out


def rerank_diversity(
    ranked: DataFrame, *, exploration: float, strength: float = 1.0, k: int | None = None
) -> DataFrame:
    """Greedy order: each step takes the best score + novelty + new-source bonus - repeated-artist penalty.

    An artist at the cap waits while another artist is left. Needs user_id, track_id, score,
    artist_name, candidate_sources (text), catalog_novelty. Rows of one artist and source lose and gain
    alike, so they form a run sorted by their fixed part, and only the head of a run can win a step: the rows
    of a listener arrive sorted by run, and a heap of heads gives out the order. Memory is linear in the
    longest list, time is steps x log(runs), whatever other listeners a task has.
    """
    e = min(max(float(exploration), 0.0), 1.0)
    s = min(max(float(strength), 0.0), 1.0)
    cap = CAP_HIGH if e >= CAP_SWITCH else CAP_LOW
    u_type, t_type = ranked.schema["user_id"].dataType, ranked.schema["track_id"].dataType
    source = F.lower(F.trim(F.coalesce(F.get(F.split("candidate_sources", ","), F.lit(0)), F.lit(""))))
    bonus, pen, src_bonus = NOVELTY_BONUS * e * s, ARTIST_PENALTY * e * s, SOURCE_BONUS * e * s
    fixed = F.col("score").cast("double") + F.lit(bonus) * try_double(F.col("catalog_novelty"))
    rows = ranked.select("user_id", "track_id", F.lower(strip(F.coalesce("artist_name", F.lit("")))).alias("artist"), source.alias("source"), fixed.alias("fixed"))
    lists = rows.repartition("user_id").sortWithinPartitions("user_id", rank_key(F.col("fixed")).desc(), "track_id")
    schema = T.StructType(
        [
            T.StructField("user_id", u_type), T.StructField("track_id", t_type),
            T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()),
        ]
    )
    def reorder(batches):
        import numpy as np
        import pyarrow as pa

        def finish(table):
            size = table.num_rows
            fixed = table.column("fixed").to_numpy()
            names = {c: table.column(c).combine_chunks().dictionary_encode() for c in ("artist", "source")}
            artist, source = (np.where(np.array(v.dictionary.to_pylist())[v.indices.to_numpy()] == "", -1, v.indices.to_numpy()) for v in names.values())
            ids = np.unique(table.column("track_id").to_numpy(), return_inverse=True)[1]  # order of ids of any type
            order = greedy_order(fixed, artist, source, ids, cap=cap, penalty=pen, source_bonus=src_bonus, steps=size if k is None else min(k, size))
            at = np.array([row for row, _ in order], dtype=np.int64)
            part = table.select(["user_id", "track_id"]).take(pa.array(at))
            return pa.table([*part.columns, pa.array(np.arange(1, len(at) + 1), pa.int32()), pa.array([v for _, v in order], pa.float64())], names=schema.names).to_batches()

        held = []  # from the first row of the last listener on
        for batch in batches:
            if not batch.num_rows or k is not None and k <= 0:
                continue
            ids = batch.column("user_id").to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and held[-1].column("user_id")[0].as_py() != batch.column("user_id")[a].as_py():
                    yield from finish(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(pa.Table.from_batches(held))

    return lists.mapInArrow(reorder, schema)


def bucket_scores(candidates: DataFrame, *, exploration: float, mood: str) -> DataFrame:
    """Adds familiar, discovery and mood_based scores in one pass.

    Needs user_id, track_id, candidate_pos, artist_name, artist_affinity, candidate_sources,
    catalog_popularity, catalog_novelty and the mood columns. The discovery score counts earlier
    candidates of the same artist in ``candidate_pos`` order.
    """
    e = min(max(float(exploration), 0.0), 1.0)
    f = 1.0 - e
    sources = F.lower("candidate_sources")
    search, top = sources.contains("search"), sources.contains("top track")
    popularity, novelty = try_double(F.col("catalog_popularity")), try_double(F.col("catalog_novelty"))
    affinity = F.coalesce("artist_affinity", F.lit(0.0))
    fit = F.col("mood_fit")
    earlier = repeat_count(strip(F.col("artist_name")), [F.col("candidate_pos")])
    rows = candidates.withColumn("mood_fit", mood_score(mood, candidates.columns))
    return rows.withColumns(
        {
            "familiar": (3.4 + 1.8 * f) * affinity
            + F.when(top, 1.8 + 0.9 * f).otherwise(0.0)
            + (1.7 + 0.8 * f) * popularity + 0.20 * fit - 0.65 * e * novelty,
            "discovery": (2.4 + 2.1 * e) * novelty
            + F.when(search, 1.8 + 1.3 * e).otherwise(0.0)
            + 0.35 * fit - (1.2 + 0.9 * e) * affinity - 0.75 * popularity - 0.75 * earlier,
            "mood_based": 8.0 * fit + 0.08 * novelty + 0.03 * popularity + F.when(search, 0.08).otherwise(0.0),
        }
    )


def rank_buckets(scored: DataFrame, *, k: int) -> DataFrame:
    """(user_id, bucket, rank, track_id, score): top k of each bucket before any diversity pass."""
    long = scored.select(
        "user_id", "track_id",
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("score")) for b in ("familiar", "discovery", "mood_based")])
        ).alias("b"),
    ).select("user_id", "track_id", "b.bucket", "b.score")
    return top_k(long, ["user_id", "bucket"], _user_order(), k)


def buckets(candidates: DataFrame, *, exploration: float, mood: str, k: int) -> DataFrame:
    """Final three buckets: discovery goes through the greedy diversity order, the others are top k."""
    scored = bucket_scores(candidates, exploration=exploration, mood=mood)
    plain = rank_buckets(scored, k=k).where(F.col("bucket") != "discovery")
    diverse = rerank_diversity(
        scored.withColumn("score", F.col("discovery")), exploration=max(min(float(exploration), 1.0), 0.75), k=k
    )
    columns = ["user_id", "bucket", "track_id", "rank", "score"]
    return plain.select(*columns).unionByName(diverse.withColumn("bucket", F.lit("discovery")).select(*columns))


def position_changes(before: DataFrame, after: DataFrame, *, k: int = 10) -> DataFrame:
    """(user_id, positions_changed): positions of the first k that hold different tracks."""
    a = before.where(F.col("rank") <= k).select("user_id", "rank", F.col("track_id").alias("a"))
    b = after.where(F.col("rank") <= k).select("user_id", "rank", F.col("track_id").alias("b"))
    both = a.join(b, ["user_id", "rank"], "full")
    return both.groupBy("user_id").agg(
        F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("int")).alias("positions_changed")
    )


def top_overlap(left: DataFrame, right: DataFrame, *, k: int = 10) -> DataFrame:
    """(user_id, overlap): shared share of two top-k lists over the longer list's length."""

    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("rank") <= k).groupBy("user_id").agg(F.collect_set("track_id").alias(name))

    both = ids(left, "a").join(ids(right, "b"), "user_id", "full")
    a, b = F.coalesce("a", F.array()), F.coalesce("b", F.array())
    size = F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return both.select("user_id", F.when(size > 0, shared / size).otherwise(0.0).alias("overlap"))


def rounded(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Display table: half-even rounding of score columns."""
    return df.withColumns({c: F.bround(F.col(c), digits) for c in columns})


def audit_columns(table: DataFrame, reranked: DataFrame) -> DataFrame:
    """Score before the rerank, adjustment (0 when missing) and whether a note is due."""
    extra = reranked.select("user_id", "track_id", "score_before", "adjustment", "reasons")
    joined = table.join(extra, ["user_id", "track_id"], "left")
    adjustment = F.coalesce("adjustment", F.lit(0.0))
    return joined.select(
        *table.columns, F.bround("score_before", 3).alias("model_final_score"),
        F.bround(adjustment, 3).alias("rerank_adjustment"),
        (F.abs(adjustment) > 1e-9).alias("has_note"),
        F.slice(F.coalesce("reasons", F.array().cast("array<string>")), 1, 2).alias("note_reasons"),
    )
