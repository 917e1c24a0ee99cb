"""Listening-context embeddings: sequences, windowed co-occurrence, PPMI, truncated SVD, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.columns import dot, norm, rank_key
from cadenza.functions.text import is_blank
from cadenza.plans.skew import positions_by_time, salted_join, top_k
from cadenza.plans.sparse import sparse_product
from cadenza.session import ensure_checkpoint_dir

# Fixed value: time columns tried in this order when none is named.
TIME_COLUMNS = ["timestamp", "played_at", "first_timestamp", "last_timestamp"]
CONTEXT_WEIGHT, EMBEDDING_WEIGHT = 0.65, 0.35
CHUNK_ROWS = 4096
# Parts that a track's context is packed in.
LIST_PARTS = 4


def build_sequences(
    rows: DataFrame,
    *,
    group: str = "user_id",
    playlist: str | None = None,
    timestamp: str | None = None,
    position: str | None = None,
    min_count: int = 1,
) -> DataFrame:
    """(group_id, pos, track_id): ordered tracks per playlist or user, vocabulary-filtered.

    Ties in time are broken by track id. Positions count the kept tracks only, so that later distances
    skip the dropped ones. A listener with a third of all rows, or a burst at one time, is numbered range by range.
    """
    key = playlist if playlist and playlist in rows.columns else group
    kept = rows.where(~is_blank(F.col("track_id").cast("string")))
    if min_count > 1:
        vocabulary = kept.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
        kept = kept.join(vocabulary.select("track_id"), "track_id", "left_semi")
    if position and position in rows.columns:
        kept = kept.withColumn("_ts", F.timestamp_micros(F.col(position).cast("long")))
        ties = [c for c in [timestamp] if c and c in rows.columns] + ["track_id"]
    else:
        present = [c for c in [timestamp, *TIME_COLUMNS] if c and c in rows.columns]
        source = F.col(present[0]) if present else F.lit(None).cast("timestamp")
        kept = kept.withColumn("_ts", source.cast("timestamp"))
        ties = ["track_id"]
    slim = kept.select(F.col(key).alias("group_id"), "_ts", *dict.fromkeys(ties))
    return positions_by_time(slim, "group_id", "_ts", ties).select("group_id", "pos", "track_id")


def cooccurrence(sequences: DataFrame, *, window: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(track_id, context_id, weight): symmetric sum of 1/distance within the window.

    Each sequence is cut into chunks that also receive the first ``window`` rows of the next chunk, so
    a look-ahead inside (group, chunk) sees every neighbour once and a long sequence stays split.
    """
    chunk = F.floor(F.col("pos") / chunk_rows).cast("long")
    inside = F.col("pos") - chunk * chunk_rows
    owned = F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))
    borrowed = F.when((inside < window) & (chunk > 0), F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own")))
    placed = sequences.withColumn("c", F.explode(F.array_compact(F.array(owned, borrowed))))
    placed = placed.select("group_id", "pos", "track_id", F.col("c.chunk").alias("chunk"), F.col("c.own").alias("own"))
    w = W.partitionBy("group_id", "chunk").orderBy("pos")
    ahead = [F.struct(F.lead("track_id", d).over(w).alias("t"), F.lit(1.0 / d).alias("w")) for d in range(1, window + 1)]
    near = placed.select("own", "track_id", F.array(*ahead).alias("ahead")).where("own")
    pairs = near.select("track_id", F.explode("ahead").alias("n")).where(F.col("n.t").isNotNull())
    half = pairs.groupBy("track_id", F.col("n.t").alias("context_id")).agg(F.sum("n.w").alias("weight"))
    # Every ordered pair counts in both directions; a repeated track pairs with itself twice.
    both = half.select(
        F.explode(
            F.array(
                F.struct(F.col("track_id").alias("a"), F.col("context_id").alias("b")),
                F.struct(F.col("context_id").alias("a"), F.col("track_id").alias("b")),
            )
        ).alias("p"),
        "weight",
    )
    return both.groupBy(F.col("p.a").alias("track_id"), F.col("p.b").alias("context_id")).agg(
        F.sum("weight").alias("weight")
    )


def ppmi(pairs: DataFrame) -> DataFrame:
    """(track_id, context_id, ppmi): positive pointwise mutual information, positive values only."""
    totals = pairs.groupBy("track_id").agg(F.sum("weight").alias("t"))
    grand = pairs.agg(F.sum("weight").alias("g")).scalar()
    columns = totals.select(F.col("track_id").alias("context_id"), F.col("t").alias("ct"))
    joined = salted_join(pairs, totals, "track_id", spread=["context_id"], how="inner")
    joined = salted_join(joined, columns, "context_id", spread=["track_id"], how="inner")
    value = F.ln(F.col("weight") * grand / (F.col("t") * F.col("ct")))
    return joined.select("track_id", "context_id", value.alias("ppmi")).where(F.col("ppmi") > 0)


def _products(block: DataFrame, outputs: dict) -> DataFrame:
    """(track_id, one array for each output): sums of vector x small matrix, computed per Arrow batch.

    ``outputs`` names for each output the vector columns and the matrix that each one is multiplied by.
    """
    id_type = block.schema["track_id"].dataType.simpleString()
    used = sorted({column for parts in outputs.values() for column in parts})

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                read = {c: batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in used}
                made = [batch.column("track_id")]
                for parts in outputs.values():
                    rows = sum(read[c] @ matrix for c, matrix in parts.items())
                    offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * rows.shape[1]
                    made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel())))
                yield pa.RecordBatch.from_arrays(made, names=["track_id", *outputs])

    ddl = ", ".join([f"track_id {id_type}", *(f"{out} array<double>" for out in outputs)])
    return block.select("track_id", *used).mapInArrow(multiply, ddl)


def _inner(block: DataFrame, left: list[str], right: list[str], shape: tuple[int, int]):
    """left^T right as a small matrix, the columns of each side put side by side: one partial product per task."""
    import numpy as np

    def product(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                a, b = (
                    np.concatenate([batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in side], axis=1)
                    for side in (left, right)
                )
                total += a.T @ b
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "v"])

    partial = block.select(*dict.fromkeys([*left, *right])).mapInArrow(product, "cell long, v double")
    cells = partial.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return out.reshape(shape)


def _ritz(gram, image):
    """(values, matrix) of the basis with inner products ``gram`` and ``image`` = basis^T A basis: its best
    approximations of eigenvectors, largest sizes first. Directions that the basis has twice are left out."""
    import numpy as np

    size, axes = np.linalg.eigh((gram + gram.T) / 2)
    kept = size > size.max() * 1e-8
    whiten = axes[:, kept] / np.sqrt(size[kept])
    values, vectors = np.linalg.eigh(whiten.T @ ((image + image.T) / 2) @ whiten)
    order = np.argsort(-np.abs(values))
    return values[order], (whiten @ vectors)[:, order]


def truncated_svd(
    matrix: DataFrame,
    *,
    dim: int = 16,
    oversample: int = 12,
    max_rounds: int = 300,
    tolerance: float = 1e-6,
    seed: int = 42,
) -> DataFrame:
    """(track_id, vector): left singular vectors times the root of the singular values of a symmetric matrix.

    ``matrix`` is (row id, column id, value). Block Krylov iteration with Rayleigh-Ritz and thick restarts: each
    round multiplies one block of dim + oversample vectors, the residuals of the best approximations so far, and
    adds it to the basis; a basis of six blocks is replaced by its best three. Basis and images stay a DataFrame;
    the driver sees small matrices of at most six by two blocks per round. Each round is checkpointed in the
    session's shared folder, so a lost executor costs a round. Rounds go on until |Aq - lambda q| of every kept
    vector is at most ``tolerance`` times its own |lambda| (values under 1e-7 of the largest one count as that,
    because rounding hides their residual); it is an error if ``max_rounds`` do not suffice. A matrix without
    cells has no vectors.
    """
    import numpy as np

    ensure_checkpoint_dir(matrix.sparkSession)
    row, column, value = matrix.columns
    cells = matrix.select(
        F.col(row).alias("track_id"), F.col(column).alias("context_id"), F.col(value).alias("v")
    ).checkpoint()
    ids = cells.select("track_id").distinct()
    empty = F.expr("cast(array() as array<double>)")
    width = min(dim + oversample, ids.count())
    if not width:
        return ids.select("track_id", empty.alias("vector"))
    kept = min(dim, width)

    def multiply(block: DataFrame, vector: str, size: int) -> DataFrame:
        # A symmetric matrix has every id both as row and as column, so no row is lost by the join.
        right = block.select(F.col("track_id").alias("context_id"), F.col(vector).alias("q"))
        joined = salted_join(cells, right, "context_id", spread=["track_id"], how="inner")
        sums = [F.sum(F.col("v") * F.col("q")[i]) for i in range(size)]
        return joined.groupBy("track_id").agg(F.array(*sums).alias("y"))

    def noise(i: int) -> Column:
        # Hash-based, so a recomputed task draws the same numbers.
        u = [
            (F.pmod(F.xxhash64("track_id", F.lit(seed + n * 1009 + i)), F.lit(2**31 - 1)) + 1) / F.lit(2.0**31)
            for n in range(2)
        ]
        return F.sqrt(-2.0 * F.ln(u[0])) * F.cos(u[1] * F.lit(2 * np.pi))

    # basis and image: the vectors so far and A times them; p and y: the new block and A times it.
    state = ids.select("track_id", empty.alias("basis"), empty.alias("image"), F.array(*[noise(i) for i in range(width)]).alias("p"))
    old, new, gram, image = 0, width, np.zeros((0, 0)), np.zeros((0, 0))
    worst = np.inf
    for _ in range(max_rounds):
        state = state.join(multiply(state, "p", new), "track_id").checkpoint()
        both = _inner(state, ["basis", "p"], ["p", "y"], (old + new, 2 * new))
        gram, image = (
            np.block([[whole, part[:old]], [part[:old].T, part[old:]]])
            for whole, part in ((gram, both[:, :new]), (image, both[:, new:]))
        )
        values, ritz = _ritz(gram, image)
        size = len(values)
        if size + width > 6 * width:
            values, ritz, size = values[: 3 * width], ritz[:, : 3 * width], 3 * width
        gram, image = np.eye(size), np.diag(values)
        block = min(width, size)
        # Residuals Aq - lambda q of the best approximations.
        own = ritz[:, :block] * values[:block]
        state = _products(state, {
            "basis": {"basis": ritz[:old], "p": ritz[old:]},
            "image": {"image": ritz[:old], "y": ritz[old:]},
            "r": {"image": ritz[:old, :block], "y": ritz[old:, :block], "basis": -own[:old], "p": -own[old:]},
        })
        rr = _inner(state, ["basis", "r"], ["r"], (size + block, block))
        length = np.sqrt(np.maximum(np.diag(rr[size:]), 0.0))
        sizes = np.abs(values[:kept])
        worst = np.max(length[:kept] / np.maximum(sizes, max(1e-7 * sizes[0], 1e-300)))
        if worst <= tolerance:
            break
        # The next block: residuals of length one without their part along the basis, made orthonormal.
        unit = np.where(length > 1e-13 * sizes[0], 1.0 / np.where(length > 0, length, 1.0), 0.0)
        along, between = rr[:size] * unit, unit[:, None] * rr[size:] * unit
        spread, axes = np.linalg.eigh(between - along.T @ along)
        good = spread > 1e-8 * max(spread.max(), 1e-300)
        turn = axes[:, good] / np.sqrt(spread[good])
        old, new = size, turn.shape[1]
        if not new:
            raise RuntimeError(f"singular vectors still change by {worst:.2e} and have no further direction")
        same = np.eye(size)
        state = _products(state, {"basis": {"basis": same}, "image": {"image": same}, "p": {"r": unit[:, None] * turn, "basis": -along @ turn}})
    else:
        raise RuntimeError(f"singular vectors still change by {worst:.2e} of their values after {max_rounds} rounds")
    scale = np.eye(size)[:, :kept] * np.sqrt(np.abs(values[:kept]))
    return _products(state, {"vector": {"basis": scale}}).checkpoint()


def direct_context(pairs: DataFrame) -> DataFrame:
    """(track_id, context_id, score): co-occurrence over the strongest one of the same track."""
    top = pairs.groupBy("track_id").agg(F.max("weight").alias("m")).where(F.col("m") > 0)
    joined = salted_join(pairs, top, "track_id", spread=["context_id"], how="inner")
    return joined.select("track_id", "context_id", (F.col("weight") / F.col("m")).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def vocabulary_vectors(pairs: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(track_id, vector) of every track with context; zeros where the decomposition has no row."""
    words = pairs.select("track_id").distinct()
    zeros = F.array_repeat(F.lit(0.0), size)
    padded = F.when(F.size("vector") < size, F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vector"))))
    return words.join(vectors, "track_id", "left").select("track_id", F.coalesce(padded, "vector", zeros).alias("vector"))


def similar_tracks(pairs: DataFrame, vectors: DataFrame, *, k: int = 10, tile_rows: int = 2048) -> DataFrame:
    """(track_id, similar_id, score, rank): 0.65 x direct context + 0.35 x embedding cosine, top k.

    A pair without direct context scores by cosine alone. Its best k come from the tiled top-k of the
    cosine; pairs with context are scored one by one. The union holds the overall best k, so all pairs
    of the vocabulary are never listed.
    """
    from cadenza.operators.similarity import cosine_topk

    size = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("n")).first()["n"]
    vectors = vocabulary_vectors(pairs, vectors, size)
    direct = direct_context(pairs).where(F.col("track_id") != F.col("context_id"))
    left = vectors.withColumnRenamed("vector", "a")
    right = vectors.select(F.col("track_id").alias("context_id"), F.col("vector").alias("b"))
    scored = salted_join(direct, left, "track_id", spread=["context_id"], how="inner")
    scored = salted_join(scored, right, "context_id", spread=["track_id"], how="inner").select(
        "track_id", "context_id",
        (CONTEXT_WEIGHT * F.col("score") + EMBEDDING_WEIGHT * cosine(F.col("a"), F.col("b"))).alias("score"),
    )
    near = cosine_topk(vectors, k=k, vector="vector", tile_rows=tile_rows).select(
        F.col("track_a").alias("track_id"), F.col("track_b").alias("context_id"),
        (EMBEDDING_WEIGHT * F.col("similarity")).alias("score"),
    )
    alone = near.join(direct.select("track_id", "context_id"), ["track_id", "context_id"], "left_anti")
    # A pair that has context can only rise, so the cosine top k minus those pairs may miss a pair of
    # the tail only when k better ones exist already.
    ranked = scored.unionByName(alone)
    return top_k(ranked, ["track_id"], [rank_key(F.col("score")).desc(), F.col("context_id")], k).withColumnRenamed(
        "context_id", "similar_id"
    )


def seed_context(pairs: DataFrame, seeds: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(user_id, track_id, score): direct context averaged over the user's contributing seeds.

    Seeds outside the vocabulary or without context do not count in the average. With ``candidates`` only
    contexts that somebody asks for are expanded, and only asked (user, track) pairs come back.
    """
    direct = direct_context(pairs)
    lists = direct.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    if candidates is not None:
        wanted = candidates.select(F.col("track_id").alias("context_id")).distinct()
        direct = direct.join(wanted, "context_id", "left_semi")
    contributing = salted_join(seeds.select("user_id", "track_id"), lists, "track_id", spread=["user_id"], how="inner")
    counts = contributing.groupBy("user_id").agg(F.count(F.lit(1)).alias("seeds"))
    # A user's seeds are added up where the lists are held, so no (user, seed, context) row reaches a shuffle.
    rows = contributing.select(F.col("user_id").alias("row"), F.col("track_id").alias("link"), F.lit(1.0).alias("weight"))
    packed = direct.groupBy(F.col("track_id").alias("link"), F.pmod(F.xxhash64("context_id"), F.lit(LIST_PARTS))).agg(
        F.collect_list(F.struct(F.col("context_id").alias("col"), F.col("score").alias("v"))).alias("cells")
    )
    sums = sparse_product(rows, packed.select("link", "cells"), k=None).select(
        F.col("row").alias("user_id"), F.col("col").alias("track_id"), F.col("score").alias("total")
    )
    if candidates is not None:
        sums = sums.join(candidates.select("user_id", "track_id").distinct(), ["user_id", "track_id"], "left_semi")
    joined = salted_join(sums, counts, "user_id", spread=["track_id"], how="inner")
    return joined.select("user_id", "track_id", (F.col("total") / F.col("seeds")).alias("score"))


def context_scores(
    pairs: DataFrame, vectors: DataFrame, seeds: DataFrame, candidates: DataFrame, size: int
) -> DataFrame:
    """(user_id, track_id, score) of candidates: 0.65 x seed context + 0.35 x cosine to the mean seed vector.

    A vocabulary track without positive PPMI has a zero vector: its context counts, its cosine is 0.
    Candidates outside the vocabulary, and users without known seeds, score 0.
    """
    from cadenza.operators.content import seed_profiles

    vectors = vocabulary_vectors(pairs, vectors, size)
    profiles = seed_profiles(vectors.withColumnRenamed("vector", "features"), seeds, size)
    direct = seed_context(pairs, seeds, candidates).withColumnRenamed("score", "direct")
    joined = salted_join(
        candidates.select("user_id", "track_id"), vectors, "track_id", spread=["user_id"]
    )
    joined = salted_join(joined, profiles, "user_id", spread=["track_id"])
    joined = joined.join(direct, ["user_id", "track_id"], "left")
    known = F.col("vector").isNotNull() & F.col("profile").isNotNull()
    score = CONTEXT_WEIGHT * F.coalesce("direct", F.lit(0.0)) + EMBEDDING_WEIGHT * cosine(F.col("profile"), F.col("vector"))
    return joined.select("user_id", "track_id", F.when(known, score).otherwise(0.0).alias("score"))
