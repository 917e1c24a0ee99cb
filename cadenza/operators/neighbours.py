"""Item-item collaborative filtering: cosine neighbours and history propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import RANK_DIGITS, rank_key
from cadenza.plans.skew import salted_join, top_k
from cadenza.plans.sparse import PIECE_ENTRIES, sparse_product
from cadenza.session import written

NEIGHBOURS = 100
# Tracks of one piece of a history; a longer history is multiplied piece by piece.
PIECE_TRACKS = 512
# Products of a slot of tracks, which one task adds up; a track with more is dealt to several slots by its listeners.
# A slot's task holds their histories, at most a row of 16 bytes for a product, and so many products at a time.
HELD_PRODUCTS = 32_000_000
STEP_PRODUCTS = 1_000_000
# Tracks whose products fill at least this share of a row of the slot are added up in whole rows, without a sort.
FILLED = 0.25
# A track with at least so many products of a step is added up by itself, without a sort.
MANY = 256


def _slot_sums(dealt: DataFrame, k: int, step: int) -> DataFrame:
    """(i, j, s) of the slots that a task reads in order: the best ``k`` of a track that has one slot, all sums of another.

    A row holds the tracks of one piece of a history that belong to the slot (``own``) and a piece of the same
    history (``others``).
    """
    item_type = dealt.schema["others"].dataType.elementType["track_id"].dataType.simpleString()

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        def flat(table, name):
            column = table.column(name).combine_chunks()
            values = column.flatten()
            return values, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

        def finish(table):
            own, on = flat(table, "own")
            others, rn = flat(table, "others")
            lt, rt = own.field("track_id"), others.field("track_id")
            ids, code = np.unique(np.concatenate([lt.to_numpy(zero_copy_only=False), rt.to_numpy(zero_copy_only=False)]), return_inverse=True)
            lc, rc = code[: len(lt)], code[len(lt):]
            lx, rx = (v.field("x").to_numpy(zero_copy_only=False) for v in (own, others))
            row, start = np.repeat(np.arange(len(on)), on), np.cumsum(rn) - rn
            split = np.zeros(len(ids), bool)
            split[lc[own.field("split").to_numpy(zero_copy_only=False)]] = True
            # Track by track, so that only the sums of a few tracks are held.
            order = np.argsort(lc, kind="stable")
            lc, lx, row = lc[order], lx[order], row[order]
            done = np.cumsum(rn[row])
            ends = np.r_[np.flatnonzero(np.diff(lc)) + 1, len(lc)] if len(lc) else np.zeros(0, int)

            def products(first, last):
                """Entry, other track and value of the products of some entries."""
                n = rn[row[first:last]]
                a = np.repeat(np.arange(first, last), n)
                b = start[row[a]] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                return a, rc[b], lx[a] * rx[b]

            sums, mark = np.zeros(len(ids)), np.zeros(len(ids), np.int64)

            def sorted_sums(first, last):
                """Sums of the products of some entries, by pair; of a track with many, those that can be among the best ``k``."""
                a, c, value = products(first, last)
                of = lc[a]
                edges = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
                many = np.diff(edges) >= MANY
                found = []
                for begin, end in zip(edges[:-1][many].tolist(), edges[1:][many].tolist()):
                    own, cols, n = int(of[begin]), c[begin:end], np.arange(end - begin)
                    np.add.at(sums, cols, value[begin:end])
                    mark[cols] = n
                    j = cols[mark[cols] == n]  # each once
                    j = j[j != own]
                    total = sums[j]
                    sums[cols] = 0
                    if len(j) > k > 0 and not split[own]:
                        rank = np.round(total, RANK_DIGITS)
                        rank[(total == 0) | np.isnan(rank)] = -np.inf
                        best = rank >= np.partition(rank, len(j) - k)[len(j) - k]
                        j, total = j[best], total[best]
                    found.append((np.full(len(j), own), j, total))
                rest = np.repeat(~many, np.diff(edges)) & (of != c)
                pair, inverse = np.unique((of * width + c)[rest], return_inverse=True)
                total = np.bincount(inverse, weights=value[rest], minlength=len(pair))
                found.append((pair // width, pair % width, total))
                return tuple(np.concatenate(x) for x in zip(*found))

            def filled_sums(first, last, tracks):
                """As ``sorted_sums``, in a row of the slot's tracks each; what cannot be among the best ``k`` is left out."""
                local, total, at = np.searchsorted(tracks, lc[first:last]), np.zeros(len(tracks) * width), first
                while at < last:
                    to = min(last, max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right"))))
                    a, c, value = products(at, to)
                    total += np.bincount(local[a - first] * width + c, weights=value, minlength=len(total))
                    at = to
                total = total.reshape(len(tracks), width)
                total[np.arange(len(tracks)), tracks] = 0
                real = total != 0
                if width > k > 0:  # all that equal the k-th stay, and all of a track with several slots
                    rank = np.round(total, RANK_DIGITS)
                    rank[~real | np.isnan(rank)] = -np.inf
                    kth = np.partition(rank, width - k, axis=1)[:, width - k]
                    real &= (rank >= kth[:, None]) | split[tracks][:, None]
                r, j = np.nonzero(real)
                return tracks[r], j, total[r, j]

            first, width = 0, len(ids)
            while first < len(lc):
                base = done[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(done, base + step, "right")))
                whole = int(np.searchsorted(ends, last, "right"))
                long = not whole or ends[whole - 1] <= first  # one track with more products than a step
                last = int(ends[whole if long else whole - 1])
                tracks = np.unique(lc[first:last])
                if long or len(tracks) * width * FILLED <= done[last - 1] - base:
                    i, j, total = filled_sums(first, last, tracks)
                else:
                    i, j, total = sorted_sums(first, last)
                first = last
                order = np.lexsort((j, -np.round(total, RANK_DIGITS), i))
                order = order[total[order] != 0]
                i, j, total = i[order], j[order], total[order]
                starts = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
                place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
                keep = split[i] | (place < k)
                i, j, total = i[keep], j[keep], total[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], type=lt.type), pa.array(ids[j], type=lt.type), pa.array(total)], names=["i", "j", "s"])

        held_back = []  # from the start of the last slot on
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column("slot").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(slot)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held_back and held_back[-1].column("slot")[0].as_py() != slot[a]:
                    yield from finish(pa.Table.from_batches(held_back))
                    held_back = []
                held_back.append(batch.slice(a, b - a))
        if held_back:
            yield from finish(pa.Table.from_batches(held_back))

    return dealt.mapInArrow(multiply, f"i {item_type}, j {item_type}, s double")


def item_neighbours(
    interactions: DataFrame, *, k: int = NEIGHBOURS, piece_tracks: int = PIECE_TRACKS, held: int = HELD_PRODUCTS
) -> DataFrame:
    """(track_id, neighbour_id, similarity): cosine of item columns, top k per track, exact.

    One plan for all histories: a history is packed in pieces of about ``piece_tracks`` tracks and sent to the slots
    that its tracks belong to, once for each slot. A slot is a set of tracks with about ``held`` products; its task
    adds them up and keeps the best ``k`` of each track, so neither products nor lists reach a shuffle. The products
    of a track with more than ``held`` are dealt to several slots by listener; their sums go to Spark whole and are
    added there. The sized rows, and the tracks' lengths and slots, are written once to the shared folder. Pairs whose sum is zero are no neighbours, negative ones are. Strengths of zero carry no similarity.
    """
    rows = interactions.select("user_id", "track_id", F.col("interaction_strength").cast("double").alias("r"))
    rows = rows.where(F.col("r") != 0)
    size = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    sized = written(salted_join(rows, size, "user_id", spread=["track_id"], how="inner"))
    per_track = sized.groupBy("track_id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("len"), F.sum("n").alias("products"))
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = sized.agg(F.greatest(F.ceil(F.sum("n") / held), F.lit(parallel)).alias("n")).scalar()
    dealt = written(per_track.select(
        "track_id", "len", F.pmod(F.xxhash64("track_id"), F.coalesce(wanted, F.lit(parallel))).alias("base"), F.ceil(F.col("products") / held).alias("slots")
    ))
    pieces = F.ceil(F.col("n") / F.lit(piece_tracks)).cast("int")
    placed = salted_join(sized, dealt, "track_id", spread=["user_id"], how="inner").select(
        "user_id", "track_id", (F.col("r") / F.col("len")).alias("x"), pieces.alias("pieces"), F.pmod(F.xxhash64("track_id"), pieces).cast("int").alias("piece"),
        F.xxhash64("base", F.when(F.col("slots") > 1, F.pmod(F.xxhash64("user_id"), F.col("slots"))).otherwise(0)).alias("slot"), (F.col("slots") > 1).alias("split"),
    )
    # A history of one piece meets itself; of a longer one the tracks of one slot travel together and meet piece by piece.
    cell, entry = F.struct("track_id", "x", "slot", "split"), F.struct("track_id", "x", "split")
    bare = lambda c: F.transform(c, lambda x: F.struct(x["track_id"], x["x"]))
    short = placed.where("pieces = 1").groupBy("user_id").agg(F.collect_list(cell).alias("cells"))
    short = short.withColumn("slot", F.explode(F.array_distinct(F.col("cells.slot")))).select(
        "slot", F.transform(F.filter("cells", lambda c: c["slot"] == F.col("slot")), lambda c: F.struct(c["track_id"], c["x"], c["split"])).alias("own"), bare("cells").alias("others")
    )
    long = placed.where("pieces > 1")
    own = long.groupBy("user_id", "pieces", "slot").agg(F.collect_list(entry).alias("own")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    others = long.groupBy("user_id", "piece").agg(F.collect_list(F.struct("track_id", "x")).alias("others"))
    met = short.unionByName(own.join(others, ["user_id", "piece"]).select("slot", "own", "others"))
    sums = _slot_sums(met.repartition(parallel, "slot").sortWithinPartitions("slot"), k, min(held, STEP_PRODUCTS))
    split = not dealt.where("slots > 1").isEmpty()
    if split:
        sums = sums.groupBy("i", "j").agg(F.sum("s").alias("s")).where(F.col("s") != 0)
    named = sums.select(F.col("i").alias("track_id"), F.col("j").alias("neighbour_id"), F.col("s").alias("similarity"))
    if not split:
        return named
    order = [rank_key(F.col("similarity")).desc(), F.col("neighbour_id")]
    return top_k(named, ["track_id"], order, k).select("track_id", "neighbour_id", "similarity")


def _product(interactions: DataFrame, neighbours: DataFrame, pool: DataFrame | None, k: int | None, piece_entries: int) -> DataFrame:
    """History x neighbour lists (at most k entries each), own tracks left out."""
    if pool is not None:
        # Neighbour lists are final by now, so cutting them to the pool first gives the same scores.
        kept = pool.select(F.col("track_id").alias("neighbour_id")).distinct()
        neighbours = neighbours.join(kept, "neighbour_id", "left_semi")
    lists = neighbours.groupBy(F.col("track_id").alias("link")).agg(
        F.collect_list(F.struct(F.col("neighbour_id").alias("col"), F.col("similarity").alias("v"))).alias("cells")
    )
    rows = interactions.select(
        F.col("user_id").alias("row"), F.col("track_id").alias("link"),
        F.col("interaction_strength").cast("double").alias("weight"),
    )
    out = sparse_product(rows, lists, k=k, exclude_links=True, piece_entries=piece_entries)
    return out.withColumnRenamed("row", "user_id").withColumnRenamed("col", "track_id")


def cf_scores(
    interactions: DataFrame, neighbours: DataFrame, pool: DataFrame | None = None, *, piece_entries: int = PIECE_ENTRIES
) -> DataFrame:
    """(user_id, track_id, score): positive scores of unseen tracks, optionally inside a pool.

    The score is the sum of strength x similarity over the user's history; an unknown user gets no rows.
    """
    return _product(interactions, neighbours, pool, None, piece_entries)


def cf_topk(
    interactions: DataFrame, neighbours: DataFrame, *, k: int = 10, pool: DataFrame | None = None,
    piece_entries: int = PIECE_ENTRIES,
) -> DataFrame:
    """Top k of the same scores per user."""
    return _product(interactions, neighbours, pool, k, piece_entries)
