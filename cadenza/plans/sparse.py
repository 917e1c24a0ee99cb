"""Sparse row x list products with a top-k per row: the shape of item similarity and of its use."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.columns import RANK_DIGITS, rank_key
from cadenza.plans.skew import salted_join, top_k
from cadenza.session import written

# Entries of a row that are summed together; a longer row is dealt in pieces of about so many.
PIECE_ENTRIES = 4096
# Entries of lists that one cell holds at the most, and products that it adds up at a time.
HELD_ENTRIES = 8_000_000
STEP_PRODUCTS = 1_000_000
# A piece with at least so many products is added up by itself, without a sort.
MANY = 256


def _sets(entries: int, rows: int, cells: int, k: int | None, parallel: int, held: int) -> tuple[int, int]:
    """(sets of rows, sets of columns): at least ``parallel`` cells, of those the ones that send the fewest entries."""
    least = max(1, math.ceil(cells / held))
    choices = [(math.ceil(parallel / c), c) for c in range(least, max(least, parallel) + 1)]
    return min(choices, key=lambda n: (n[1] * (entries + rows * (k or 0)) + n[0] * cells, n[1]))


def _added(k: int | None, exclude_links: bool, exclude_self: bool, step: int, names: list[str]):
    """Rows of cells, sorted by (cell, side, row, piece, link), to sums. Sides: 0 lists, 1 pieces of rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flat(column, field):
            return column.flatten().field(field)

        class Cell:
            def __init__(self):
                self.lists, self.ready, self.total = [], False, None

            def prepare(self):
                """The cell's lists end to end, by link, and its columns."""
                self.ready = True
                own, self.lists = self.lists, []
                if not own:
                    self.links = np.zeros(0, object)
                    return
                self.links = np.concatenate([b.column("link").to_numpy(zero_copy_only=False) for b in own])
                self.size = np.concatenate([b.column("entries").value_lengths().to_numpy(zero_copy_only=False) for b in own]).astype(np.int64)
                self.first = np.cumsum(self.size) - self.size
                self.value = np.concatenate([flat(b.column("entries"), "v").to_numpy(zero_copy_only=False) for b in own])
                ids = pa.concat_arrays([flat(b.column("entries"), "id") for b in own])
                self.type = ids.type
                self.cols, self.col = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)

            def add(self, side, batch):
                if not side:
                    self.lists.append(batch)
                    return
                if not self.ready:
                    self.prepare()
                if not len(self.links):
                    return  # rows without lists
                links = flat(batch.column("entries"), "id").to_numpy(zero_copy_only=False)
                # A link may have several lists: they stand side by side.
                low, high = np.searchsorted(self.links, links, "left"), np.searchsorted(self.links, links, "right")
                start = np.r_[self.first, len(self.value)]
                n = start[high] - start[low]
                sizes = batch.column("entries").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes)
                done = np.r_[0, np.cumsum(n)][ends]
                at = 0
                while at < len(sizes):
                    last = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
                    a, b = ends[at] - sizes[at], ends[last - 1]
                    yield from self.sums(batch.slice(at, last - at), links[a:b], start[low[a:b]], n[a:b], sizes[at:last])
                    at = last

            def sums(self, batch, links, start, n, sizes):
                weight = flat(batch.column("entries"), "v").to_numpy(zero_copy_only=False)
                at = same = None
                if exclude_links:
                    at = np.minimum(np.searchsorted(self.cols, links), len(self.cols) - 1)
                    same = self.cols[at] == links
                code, width = np.repeat(np.arange(len(sizes)), sizes), len(self.cols)

                def products(a, b):
                    which = np.repeat(np.arange(a, b), n[a:b])
                    spot = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                    return which, self.col[spot], weight[which] * self.value[spot]

                if len(sizes) == 1 and n.sum() > step:  # one piece with more products than a step
                    total, met, a = np.zeros(width), np.zeros(width, bool), 0
                    done = np.cumsum(n)
                    while a < len(n):
                        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + step, "right")))
                        _, col, value = products(a, b)
                        total += np.bincount(col, weights=value, minlength=width)
                        met[col] = True
                        a = b
                    c = np.flatnonzero(met)
                    r, total = np.zeros(len(c), np.int64), total[c]
                    large = (r[:0], r[:0], total[:0])
                else:
                    which, col, value = products(0, len(n))
                    piece, counts = code[which], np.bincount(code, weights=n, minlength=len(sizes)).astype(np.int64)
                    many = counts >= MANY
                    small = ~many[piece]
                    hit, inverse = np.unique(piece[small] * width + col[small], return_inverse=True)
                    r, c = hit // width, hit % width
                    total = np.bincount(inverse, weights=value[small], minlength=len(hit))
                    large = self.large(np.flatnonzero(many), counts, col, value, batch, at, same, sizes)
                if not len(r) and not len(large[0]):
                    return
                ids, split = batch.column("row"), batch.column("split").to_numpy(zero_copy_only=False)
                part = split[r]  # a part's sums: nothing is decided yet
                keep = (total > 0) | part
                if exclude_links and len(r):
                    keep &= ~np.isin(r * width + c, code[same] * width + at[same]) | part
                if exclude_self:
                    keep &= (self.cols[c] != ids.to_numpy(zero_copy_only=False)[r]) | part
                r, c, total = (np.concatenate([x[keep], y]) for x, y in zip((r, c, total), large))
                part = split[r]
                if k is not None and len(r):
                    order = np.lexsort((c, -np.round(total, RANK_DIGITS), r))
                    r, c, total, part = r[order], c[order], total[order], part[order]
                    starts = np.r_[0, np.nonzero(np.diff(r))[0] + 1]
                    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                    best = (place < k) | part
                    r, c, total, part = r[best], c[best], total[best], part[best]
                if len(r):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(self.cols[c], type=self.type), pa.array(total), pa.array(part)], names=names)

            def large(self, which, counts, col, value, batch, at, same, sizes):
                """Row, column and sum of pieces with many products, one after the other without a sort; of a whole row what may be listed."""
                if self.total is None:
                    self.total, self.mark = np.zeros(len(self.cols)), np.zeros(len(self.cols), np.int64)
                ends, tops, found = np.cumsum(counts), np.cumsum(sizes), []
                ids, split = batch.column("row"), batch.column("split").to_numpy(zero_copy_only=False)
                for p in which.tolist():
                    first, last = int(ends[p] - counts[p]), int(ends[p])
                    cols, n = col[first:last], np.arange(last - first)
                    np.add.at(self.total, cols, value[first:last])
                    self.mark[cols] = n
                    c = cols[self.mark[cols] == n]  # each once
                    if not split[p] and exclude_links:
                        own = slice(tops[p] - sizes[p], tops[p])
                        self.total[at[own][same[own]]] = 0
                    total = self.total[c]
                    self.total[cols] = 0
                    if not split[p]:
                        keep = total > 0
                        if exclude_self:
                            keep &= self.cols[c] != ids[p].as_py()
                        c, total = c[keep], total[keep]
                        if k is not None and len(c) > k > 0:
                            rank = np.round(total, RANK_DIGITS)
                            best = rank >= np.partition(rank, len(c) - k)[len(c) - k]
                            c, total = c[best], total[best]
                    found.append((np.full(len(c), p), c, total))
                if not found:
                    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                return tuple(np.concatenate(x) for x in zip(*found))

        number, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, side = (batch.column(c).to_numpy() for c in ("cell", "side"))
            edges = np.r_[0, np.flatnonzero((np.diff(where) != 0) | (np.diff(side) != 0)) + 1, len(where)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if number != where[a]:
                    number, cell = where[a], Cell()
                yield from cell.add(int(side[a]), batch.slice(a, b - a))

    return run


def sparse_product(
    rows: DataFrame,
    lists: DataFrame,
    *,
    k: int | None,
    exclude_links: bool = False,
    exclude_self: bool = False,
    piece_entries: int = PIECE_ENTRIES,
    held_entries: int = HELD_ENTRIES,
    step: int = STEP_PRODUCTS,
) -> DataFrame:
    """(row, col, score[, rank]): sum over the row's links of weight x value, positive sums, best k.

    ``rows`` is (row, link, weight) and ``lists`` (link, cells array<struct<col, v>>). ``exclude_links`` drops
    columns that the row itself links to, ``exclude_self`` the column equal to the row. One plan for all rows, in
    cells of a set of rows and a set of columns: a cell's task holds the lists' entries with its columns, at most
    about ``held_entries``, and its rows stream past them, so a list is sent once for each set of rows and not for
    each link, and no single product reaches a shuffle. A row is dealt in pieces of about ``piece_entries``
    entries: one of one piece is ranked where it was summed and gives k rows a cell; the sums of a row of several
    pieces are added by Spark. Packed rows and lists are written once to the shared folder, where they are counted.
    """
    spark = rows.sparkSession
    row_type, col_type = rows.schema["row"].dataType, lists.schema["cells"].dataType.elementType["col"].dataType
    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = rows.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece_entries)).cast("int").alias("pieces"))
    placed = salted_join(rows, sizes, "row", spread=["link"], how="inner").withColumn("piece", F.pmod(F.xxhash64("link"), F.col("pieces")).cast("int"))
    pieces = written(
        placed.where("link IS NOT NULL").groupBy("row", "piece", (F.col("pieces") > 1).alias("split"))
        .agg(F.collect_list(F.struct(F.col("link").alias("id"), F.col("weight").cast("double").alias("v"))).alias("entries"))
    )
    own = written(lists.where("link IS NOT NULL").select("link", F.transform("cells", lambda c: F.struct(c["col"].alias("id"), c["v"].cast("double").alias("v"))).alias("entries")))
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("entries")).first()
    of_rows, of_lists = total(pieces), total(own)
    r_sets, c_sets = _sets(of_rows["entries"], of_rows["n"], of_lists["entries"], k, parallel, held_entries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    if c_sets > 1:
        own = own.withColumn("cs", every(c_sets)).withColumn("entries", F.filter("entries", lambda e: place(e["id"], c_sets) == F.col("cs")))
    else:
        own = own.withColumn("cs", F.lit(0))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    link_type = lists.schema["link"].dataType
    held = own.where(F.size("entries") > 0).withColumn("rs", every(r_sets)).select(
        "rs", "cs", F.lit(0).alias("side"), none("row", row_type), F.lit(0).alias("piece"), F.lit(False).alias("split"), "link", "entries"
    )
    streamed = pieces.withColumn("rs", F.pmod(F.xxhash64("row", "piece"), F.lit(r_sets)).cast("int")).withColumn("cs", every(c_sets)).select(
        "rs", "cs", F.lit(1).alias("side"), "row", "piece", "split", none("link", link_type), "entries"
    )
    dealt = held.unionByName(streamed).withColumn("cell", F.col("rs") * c_sets + F.col("cs")).drop("rs", "cs")
    dealt = dealt.repartitionById(r_sets * c_sets, F.col("cell")).sortWithinPartitions("cell", "side", "row", "piece", "link")
    out = T.StructType(
        [T.StructField("row", row_type), T.StructField("col", col_type), T.StructField("score", T.DoubleType()), T.StructField("split", T.BooleanType())]
    )
    made = dealt.mapInArrow(_added(k, exclude_links, exclude_self, step, out.names), out)
    split = not pieces.where("split").isEmpty()
    if split:
        # Written once: rows of one piece pass on, those of several pieces are read for their sums.
        made = written(made)
    both = made.drop("split")
    if split:
        whole = made.where(~F.col("split")).drop("split")
        sums = made.where("split").groupBy("row", "col").agg(F.sum("score").alias("score")).where(F.col("score") > 0)
        if exclude_self:
            sums = sums.where(F.col("row") != F.col("col"))
        if exclude_links:
            sums = sums.join(rows.select("row", F.col("link").alias("col")), ["row", "col"], "left_anti")
        both = whole.unionByName(sums)
    if k is None:
        return both
    return top_k(both, ["row"], [rank_key(F.col("score")).desc(), F.col("col")], k)
