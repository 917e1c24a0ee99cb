"""Mood-aware playlist sequencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.columns import rank_key, try_double
from cadenza.operators.mood import mood_relevance, sequencing_profile
from cadenza.plans.skew import salted_join

# Required columns, defaults and weights of the sequencing.
REQUIRED = ["track_id", "track_name", "artist_name", "energy", "tempo", "valence"]
DEFAULTS = {
    "danceability": 0.5, "energy": 0.5, "valence": 0.5, "tempo": 120.0, "acousticness": 0.5,
    "speechiness": 0.1, "instrumentalness": 0.0, "loudness": -10.0, "popularity": 0.5,
}
DIVERSITY_COLUMNS = ["danceability", "valence", "acousticness", "instrumentalness"]
RELEVANCE_WEIGHT, DIVERSITY_WEIGHT, TRANSITION_WEIGHT = 0.6, 0.2, 0.2


def prepare_candidates(candidates: DataFrame) -> DataFrame:
    """Check required columns, coerce features to numbers, fill defaults."""
    if "artist_name" not in candidates.columns and "primary_artist_name" in candidates.columns:
        candidates = candidates.withColumn("artist_name", F.col("primary_artist_name"))
    missing = sorted(set(REQUIRED) - set(candidates.columns))
    if missing:
        raise ValueError(f"candidate tracks lack the columns {', '.join(missing)}")
    numbers = {
        c: try_double(F.col(c), d) if c in candidates.columns else F.lit(d) for c, d in DEFAULTS.items()
    }
    return candidates.withColumns(
        {
            **numbers,
            "track_name": F.coalesce(F.col("track_name").cast("string"), F.col("track_id").cast("string")),
            "artist_name": F.coalesce("artist_name", F.lit("")),
        }
    )


def closest_features(mood: str) -> Column:
    """Names of the two features nearest to the mood's targets."""
    rows = F.array(
        *[
            F.struct(F.abs(F.col(n) - target).alias("d"), F.lit(n).alias("n"))
            for n, (target, _) in sequencing_profile(mood)["features"].items()
        ]
    )
    return F.transform(F.slice(F.array_sort(rows), 1, 2), lambda r: r["n"])


# Places of one padded matrix of lists.
MATRIX_PLACES = 1 << 20


def similar_lists(batches, column: str, places: int = MATRIX_PLACES):
    """The rows of Arrow batches regrouped by the length of their list, so that padding at most doubles it; empty lists are left out."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        size = batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for w in np.unique(width[size > 0]).tolist():
            own = np.flatnonzero((width == w) & (size > 0))
            step = max(1, places // w)
            for s in range(0, len(own), step):
                yield batch.take(pa.array(own[s : s + step]))


def sequence_playlist(
    candidates: DataFrame, mood: str, *, max_items: int, playlist: str = "user_id", order: str = "track_id"
) -> DataFrame:
    """(playlist, position, track_id, mood_relevance, diversity, transition, score) per playlist.

    The opener fits the mood best (ties by id). Every next track has the best
    0.6 x mood + 0.2 x diversity + 0.2 x smoothness, the first in ``order`` on ties. Playlists of like
    length share one matrix of bounded size; a long list is a matrix of its own, so memory is linear in it.
    """
    profile = sequencing_profile(mood)
    tempo_step, energy_step = profile["tempo_step"], profile["energy_step"]
    p_type, t_type = candidates.schema[playlist].dataType, candidates.schema["track_id"].dataType
    ready = prepare_candidates(candidates).select(
        F.col(playlist).alias("p"),
        F.struct(
            F.col(order).alias("o"), F.col("track_id").alias("id"),
            mood_relevance(mood).alias("mood"), "tempo", "energy",
            *[F.col(c).alias(f"d{i}") for i, c in enumerate(DIVERSITY_COLUMNS)],
        ).alias("c"),
    )
    lists = ready.groupBy("p").agg(F.array_sort(F.collect_list("c")).alias("c"))
    schema = T.StructType(
        [T.StructField(playlist, p_type), T.StructField("position", T.IntegerType()), T.StructField("track_id", t_type)]
        + [T.StructField(n, T.DoubleType()) for n in ("mood_relevance", "diversity", "transition", "score")]
    )
    axes = len(DIVERSITY_COLUMNS)
    rw, dw, tw = RELEVANCE_WEIGHT, DIVERSITY_WEIGHT, TRANSITION_WEIGHT

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        for batch in similar_lists(batches, "c"):
            lists_col = batch.column("c")
            cells = lists_col.flatten()
            sizes = np.diff(lists_col.offsets.to_numpy())
            if max_items <= 0:
                continue
            n, width = len(sizes), int(sizes.max())
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            row = np.repeat(np.arange(n), sizes)
            col = np.arange(len(cells)) - np.repeat(starts, sizes)

            def padded(values, fill=0.0):
                m = np.full((n, width), fill)
                m[row, col] = values
                return m

            def number(name):
                return padded(cells.field(name).to_numpy(zero_copy_only=False))

            _, id_code = np.unique(cells.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
            ids = padded(id_code, np.iinfo(np.int64).max)
            at = padded(np.arange(len(cells)), -1)
            left = padded(True, False)
            mood_fit, tempo, energy = number("mood"), number("tempo"), number("energy")
            spread = np.stack([number(f"d{i}") for i in range(axes)], axis=2)
            distance = np.zeros((n, width))
            every = np.arange(n)
            out = {name: [] for name in ("p", "cell", "pos", "m", "d", "t", "s")}
            pick = None
            for step in range(min(max_items, width)):
                active = left.any(axis=1)
                if step == 0:
                    diversity, smooth = np.zeros((n, width)), np.ones((n, width))
                    value = np.where(left, np.round(mood_fit, 9), -np.inf)
                    tied = left & (value == value.max(axis=1)[:, None])
                    pick = np.where(tied, ids, np.iinfo(np.int64).max).argmin(axis=1)
                    score = mood_fit
                else:
                    diversity = np.minimum(distance / step, 1.0)
                    tempo_gap = np.abs(tempo - tempo[every, pick][:, None])
                    energy_gap = np.abs(energy - energy[every, pick][:, None])
                    smooth = (
                        np.maximum(0.0, 1.0 - tempo_gap / tempo_step) + np.maximum(0.0, 1.0 - energy_gap / energy_step)
                    ) / 2.0
                    score = rw * mood_fit + dw * diversity + tw * smooth
                    pick = np.where(left, np.round(score, 9), -np.inf).argmax(axis=1)
                live = every[active]
                chosen = pick[live]
                out["p"].append(live)
                out["cell"].append(at[live, chosen])
                out["pos"].append(np.full(len(live), step + 1))
                for key, m in (("m", mood_fit), ("d", diversity), ("t", smooth), ("s", score)):
                    out[key].append(m[live, chosen])
                left &= ids != ids[every, pick][:, None]
                distance += np.abs(spread - spread[every, pick][:, None, :]).mean(axis=2)
            merged = {key: np.concatenate(v) for key, v in out.items()}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("p").take(pa.array(merged["p"])),
                    pa.array(merged["pos"], type=pa.int32()),
                    cells.field("id").take(pa.array(merged["cell"])),
                    *[pa.array(merged[key]) for key in ("m", "d", "t", "s")],
                ],
                names=[playlist, "position", "track_id", "mood_relevance", "diversity", "transition", "score"],
            )

    return lists.mapInArrow(fold, schema)


def sequence_reasons(sequence: DataFrame, candidates: DataFrame, mood: str, *, playlist: str = "user_id") -> DataFrame:
    """Adds the two best-fitting features and the tempo move from the previous track."""
    from pyspark.sql import Window as W

    info = prepare_candidates(candidates).select(
        playlist, "track_id", "tempo", closest_features(mood).alias("best_features")
    )
    joined = sequence.join(info, [playlist, "track_id"], "left")
    w = W.partitionBy(playlist).orderBy("position")
    return joined.withColumn("previous_tempo", F.lag("tempo").over(w))


def export_tracks(buckets: DataFrame, main: DataFrame, bucket_order: list[str]) -> DataFrame:
    """Distinct tracks of all buckets per user in first-seen order; the main list when there are no buckets."""
    order = F.array_position(F.array(*[F.lit(b) for b in bucket_order]), F.col("bucket"))
    from_buckets = buckets.select("user_id", "track_id", F.struct(order.alias("o"), F.col("rank").alias("r")).alias("at"))
    only_main = main.join(buckets.select("user_id").distinct(), "user_id", "left_anti").select(
        "user_id", "track_id", F.struct(F.lit(0).cast("long").alias("o"), F.col("rank").alias("r")).alias("at")
    )
    first = from_buckets.unionByName(only_main).groupBy("user_id", "track_id").agg(F.min("at").alias("at"))
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("at", "track_id")
    return first.select("user_id", "track_id", F.row_number().over(w).alias("position"))


def playlist_candidates(catalog: DataFrame, ranked: DataFrame) -> DataFrame:
    """Catalog rows of each user's recommended tracks."""
    return salted_join(ranked.select("user_id", "track_id").distinct(), catalog, "track_id", spread=["user_id"], how="inner")


def playlist_duration(tracks: DataFrame, *, playlist: str = "user_id", duration: str = "duration_ms") -> DataFrame:
    """(playlist, total_seconds, duration_label m:ss)."""
    seconds = tracks.groupBy(playlist).agg(
        F.bround(F.sum(F.col(duration).try_cast("double")) / 1000.0, 0).cast("long").alias("total_seconds")
    )
    label = F.concat(
        F.floor(F.col("total_seconds") / 60).cast("string"), F.lit(":"),
        F.lpad((F.col("total_seconds") % 60).cast("string"), 2, "0"),
    )
    return seconds.withColumn("duration_label", F.coalesce(label, F.lit("Unavailable")))


def best_opener(candidates: DataFrame, mood: str, *, playlist: str = "user_id") -> DataFrame:
    """Opening track alone: best mood relevance, ties by id (a partial aggregate, no per-playlist list)."""
    scored = prepare_candidates(candidates).withColumn("mood_relevance", mood_relevance(mood))
    key = F.struct((-rank_key(F.col("mood_relevance"))).alias("a"), F.col("track_id").alias("b"))
    return scored.groupBy(playlist).agg(
        F.min_by("track_id", key).alias("track_id"), F.max("mood_relevance").alias("mood_relevance")
    )
