"""Inner products between two vector tables, computed cell by cell.

A cell is a set of queries and a set of items, both chosen by the hash of their ids. Its task keeps the queries and
lets the items stream past them in blocks, each one matrix product; only the best k per query (or the scores above
a floor) leave it. Neither side is collected or broadcast and no (query, item) pair reaches a shuffle before it has
been ranked. Cells are as large as a task's memory allows: a row is sent once to every cell of its row or column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.columns import RANK_DIGITS, rank_key
from cadenza.plans.skew import top_k
from cadenza.session import written

#: Items of a block; a quarter as many queries meet them at a time.
TILE_ROWS = 1024
#: Bytes of queries with their lists, and items, that one cell holds at the most.
HELD_BYTES = 192 << 20
HELD_ITEMS = 1 << 20


def _tile_count(df: DataFrame, tile_rows: int, at_least: int = 1) -> Column:
    """Tiles of at most about ``tile_rows`` rows; a small table still gives ``at_least`` tiles of 128 rows or more."""
    n = F.count(F.lit(1))
    wanted = F.greatest(F.ceil(n / F.lit(tile_rows)), F.least(F.lit(at_least), F.ceil(n / F.lit(128))), F.lit(1))
    return df.agg(wanted.cast("int").alias("n")).scalar()


def _tile(column: Column, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(column), tiles).cast("int")


def spread_rows(pairs: DataFrame, *keys: str) -> DataFrame:
    """Spread rows that are each a whole unit of work. The explicit count keeps AQE from merging them by size."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _cells(queries: int, items: int, size: int, k: int, parallel: int, held_bytes: int, held_items: int) -> tuple[int, int]:
    """(sets of queries, sets of items): at least ``parallel`` cells, of those the ones that send the fewest bytes."""
    item, query = 8 * size + 40, 8 * size + 40 + 24 * k
    wish = math.sqrt(parallel * max(1, queries) * query / (max(1, items) * item))
    wish = min(2 ** round(math.log2(max(1.0, wish))), parallel, math.ceil(queries / 128))
    q_sets = max(1, wish, math.ceil(queries * query / held_bytes))
    return q_sets, max(1, math.ceil(items / held_items), min(math.ceil(parallel / q_sets), math.ceil(items / 128)))


def _multiply(names: tuple[str, str, str], *, k: int | None, floor: float | None, exclude_self: bool, block: int):
    """Rows of cells, sorted by (cell, side, i, q), to scores. Sides: 0 queries, 1 excluded pairs, 2 items."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        class Cell:
            def __init__(self):
                self.parts = {0: [], 1: [], 2: []}
                self.waiting, self.ids, self.seen, self.last, self.ready = 0, [], 0, None, False

            def prepare(self):
                """Queries as one matrix, excluded pairs by item; rows without an id come first and match nothing."""
                self.ready = True
                own = self.parts.pop(0)
                self.q = pa.concat_arrays([b.column("q") for b in own])
                self.q_null = self.q.null_count
                self.q_key = self.q.slice(self.q_null).to_numpy(zero_copy_only=False)
                self.matrix = self.vectors(own)
                banned = self.parts.pop(1)
                self.banned = None
                if banned and len(self.q_key):
                    who, what = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in banned]) for c in ("q", "i"))
                    at = np.minimum(np.searchsorted(self.q_key, who), len(self.q_key) - 1)
                    real = self.q_key[at] == who
                    self.banned = what[real], at[real] + self.q_null
                if k is not None:
                    self.score = np.full((len(self.q), k), -np.inf)
                    self.at = np.full((len(self.q), k), -1, dtype=np.int64)
                    self.kth = np.full(len(self.q), -np.inf)

            @staticmethod
            def vectors(parts):
                rows = sum(b.num_rows for b in parts)
                flat = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for b in parts])
                return flat.reshape(rows, -1)

            def add(self, side, batch):
                if side < 2:
                    self.parts[side].append(batch)
                    return
                if not self.parts.get(0) and not self.ready:
                    return  # items without queries
                self.parts[2].append(batch)
                self.waiting += batch.num_rows
                if self.waiting >= block:
                    yield from self.step()

            def step(self):
                """One block of items past all queries."""
                if not self.ready:
                    self.prepare()
                parts, self.parts[2], self.waiting = self.parts[2], [], 0
                ids, items = pa.concat_arrays([b.column("i") for b in parts]), self.vectors(parts)
                nulls = ids.null_count
                key = ids.slice(nulls).to_numpy(zero_copy_only=False)
                rows, cols = np.zeros(0, np.int64), np.zeros(0, np.int64)

                def meet(what, who):
                    """Pairs of this block; of items with the same id the first alone is meant."""
                    if not len(key) or not len(what):
                        return rows, cols
                    a, b = np.searchsorted(what, key[0], "right" if self.last is not None and self.last == key[0] else "left"), np.searchsorted(what, key[-1], "right")
                    c = np.searchsorted(key, what[a:b])
                    real = key[c] == what[a:b]
                    return np.concatenate([rows, who[a:b][real]]), np.concatenate([cols, c[real] + nulls])

                if self.banned is not None:
                    rows, cols = meet(*self.banned)
                if exclude_self:
                    rows, cols = meet(self.q_key, np.arange(len(self.q_key)) + self.q_null)
                order = np.argsort(rows, kind="stable")
                rows, cols = rows[order], cols[order]
                finite = np.isfinite(items).all() and np.isfinite(self.matrix).all()
                few = max(1, block // 4)
                for first in range(0, len(self.q), few):
                    scores = self.matrix[first : first + few] @ items.T
                    a, b = np.searchsorted(rows, [first, first + few])
                    out = rows[a:b] - first, cols[a:b]
                    if k is None:
                        keep = np.ones(scores.shape, dtype=bool) if floor is None else scores > floor
                        keep[out] = False
                        r, c = np.nonzero(keep)
                        if len(r):
                            yield pa.RecordBatch.from_arrays([self.q.take(pa.array(r + first)), ids.take(pa.array(c)), pa.array(scores[r, c])], names=list(names))
                        continue
                    if not finite:
                        scores[np.isnan(scores)] = -np.inf
                    scores[out] = -np.inf
                    self.rank(first, scores)
                if k is not None:
                    self.ids.append(ids)
                self.seen += len(ids)
                self.last = key[-1] if len(key) else self.last

            def rank(self, first, scores):
                """Merges the block's best into the lists. Later items have larger ids: of equal scores they are worse."""
                n, width = scores.shape
                least = self.kth[first : first + n]
                better = scores > (least if floor is None else np.maximum(least, floor))[:, None]
                if width > k and np.count_nonzero(better) > 8 * k * n:
                    kth = np.round(np.partition(scores, width - k, axis=1)[:, width - k], RANK_DIGITS)
                    better &= scores >= (kth - 10.0**-RANK_DIGITS)[:, None]
                hit = np.flatnonzero(better)
                r, s = hit // width, scores.ravel()[hit]
                real = np.round(s, RANK_DIGITS) > least[r]
                r, s, c = r[real], s[real], (hit % width)[real] + self.seen
                if not len(r):
                    return
                met = np.zeros(n, dtype=bool)
                met[r] = True
                met = np.flatnonzero(met)
                old_at, old = self.at[first + met], self.score[first + met]
                filled = old_at >= 0
                r, s, c = np.concatenate([np.repeat(met, filled.sum(axis=1)), r]), np.concatenate([old[filled], s]), np.concatenate([old_at[filled], c])
                order = np.lexsort((c, -np.round(s, RANK_DIGITS), r))
                r, s, c = r[order], s[order], c[order]
                starts = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
                place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                best = place < k
                r, place = r[best] + first, place[best]
                self.score[r, place], self.at[r, place] = s[best], c[best]
                self.kth[first : first + n] = np.round(self.score[first : first + n, k - 1], RANK_DIGITS)

            def end(self):
                if self.waiting:
                    yield from self.step()
                if not self.ready or k is None:
                    return
                ids = pa.concat_arrays(self.ids)
                for first in range(0, len(self.q), 1 << 16):
                    r, place = np.nonzero(self.at[first : first + (1 << 16)] >= 0)
                    if len(r):
                        r = r + first
                        yield pa.RecordBatch.from_arrays([self.q.take(pa.array(r)), ids.take(pa.array(self.at[r, place])), pa.array(self.score[r, place])], names=list(names))

        number, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, side = (batch.column(c).to_numpy() for c in ("cell", "side"))
            edges = np.r_[0, np.flatnonzero((np.diff(where) != 0) | (np.diff(side) != 0)) + 1, len(where)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if number != where[a]:
                    if cell is not None:
                        yield from cell.end()
                    number, cell = where[a], Cell()
                yield from cell.add(int(side[a]), batch.slice(a, b - a))
        if cell is not None:
            yield from cell.end()

    return run


def inner_products(
    queries: DataFrame,
    items: DataFrame,
    *,
    query: str,
    item: str,
    vector: str,
    k: int | None = None,
    floor: float | None = None,
    exclude: DataFrame | None = None,
    exclude_self: bool = False,
    tile_rows: int = TILE_ROWS,
    held_bytes: int = HELD_BYTES,
    held_items: int = HELD_ITEMS,
    score: str = "score",
) -> DataFrame:
    """(query, item, score) with the top ``k`` per query by (rounded score desc, item asc).

    ``k=None`` keeps every score. ``floor`` drops scores not above it. ``exclude`` holds (query, item)
    pairs that must not be returned; it is matched inside the cells, so it costs its own size only. Both vector
    tables are written once to the shared folder, where they are counted and read; rows without a vector give nothing.
    """
    spark = queries.sparkSession
    q_type, i_type = queries.schema[query].dataType, items.schema[item].dataType
    left = written(queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL"))
    right = written(items.select(F.col(item).alias("i"), F.col(vector).alias("v")).where("v IS NOT NULL"))
    size = right.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("size")).first()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_sets, i_sets = _cells(left.count(), size["n"], size["size"], k or 0, parallel, held_bytes, held_items)
    qs, its = F.pmod(F.xxhash64("q"), F.lit(q_sets)).cast("int"), F.pmod(F.xxhash64("i"), F.lit(i_sets)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none_q, none_i, none_v = F.lit(None).cast(q_type), F.lit(None).cast(i_type), F.lit(None).cast(left.schema["v"].dataType)
    sides = [
        left.select(qs.alias("qs"), "q", "v", every(i_sets).alias("its")).select(F.col("qs"), F.col("its"), F.lit(0).alias("side"), "q", none_i.alias("i"), "v"),
        right.select(its.alias("its"), "i", "v", every(q_sets).alias("qs")).select(F.col("qs"), F.col("its"), F.lit(2).alias("side"), none_q.alias("q"), "i", "v"),
    ]
    if exclude is not None:
        pairs = exclude.select(F.col(query).cast(q_type).alias("q"), F.col(item).cast(i_type).alias("i")).where("q IS NOT NULL AND i IS NOT NULL")
        sides.append(pairs.select(qs.alias("qs"), its.alias("its"), F.lit(1).alias("side"), "q", "i", none_v.alias("v")))
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.unionByName(more)
    rows = rows.select((F.col("qs") * i_sets + F.col("its")).alias("cell"), "side", "q", "i", "v")
    dealt = rows.repartitionById(q_sets * i_sets, F.col("cell")).sortWithinPartitions("cell", "side", "i", "q")
    out_schema = T.StructType([T.StructField(query, q_type), T.StructField(item, i_type), T.StructField(score, T.DoubleType())])
    scored = dealt.mapInArrow(_multiply((query, item, score), k=k, floor=floor, exclude_self=exclude_self, block=tile_rows), out_schema)
    if k is None:
        return scored
    return top_k(scored, [query], [rank_key(F.col(score)).desc(), F.col(item)], k)
