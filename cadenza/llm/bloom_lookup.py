"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph is a line; a long line is further cut at spaces where the four bytes before them hash to a fixed value,
so a change moves cuts only nearby. Each paragraph's digest is added to one cell in each of three parts of a sketch.
Subtracting two sketches leaves the paragraphs that differ; cells with one of them give it away, and taking it out
frees others. Where this peeling stops early, both texts are sketched again with four times the cells.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SLICE_BYTES, arrow_schema, plain, slices

PARTS = 3
#: Cells of a stored fingerprint.
CELLS = 24
GROWTH = 4
#: One in this many spaces cuts a line.
CUT_ONE_IN = 8

_U = np.uint64
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def paragraph_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all paragraphs, paragraphs of each text); a repeated paragraph has a key for each time."""
    import xxhash

    body = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(body, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    space = np.flatnonzero(raw == 32)
    space = space[space - begin[np.searchsorted(begin, space, "right") - 1] >= 4]
    before = sum(raw[space - k].astype(_U) << _U(8 * k) for k in (1, 2, 3, 4)) if len(space) else np.zeros(0, _U)
    cuts = space[_mix(before, 5) % _U(CUT_ONE_IN) == 0] if len(space) else space
    end = np.union1d(np.flatnonzero(raw == 10), cuts)
    start = np.concatenate([[0], end[:-1] + 1])
    real = end > start
    start, end = start[real], end[real]
    digest = np.fromiter((xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(start.tolist(), end.tolist())), _U, len(start))
    doc = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((digest, doc))
    digest, doc = digest[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    return _mix(digest + times.astype(_U) * _U(0xA0761D6478BD642F), 7), np.bincount(doc, minlength=len(texts))


def sketch(keys: np.ndarray, owner: np.ndarray, owners: int, cells: int, sign: np.ndarray | int = 1) -> np.ndarray:
    """Sketches of ``owners`` sets side by side, ``cells`` each; keys with sign -1 are subtracted."""
    out = np.zeros(owners * cells, _CELL)
    put(out, keys, owner, cells, sign)
    return out.reshape(owners, cells)


def put(flat: np.ndarray, keys: np.ndarray, owner: np.ndarray, cells: int, sign: np.ndarray | int) -> None:
    """Add ``sign`` times each key to its three cells of its owner's sketch."""
    many = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
    value, check = keys * many.astype(_U), _mix(keys, 99).astype(np.uint32) * many.astype(np.uint32)
    part = cells // PARTS
    for j in range(PARTS):
        at = owner * cells + j * part + (((_mix(keys, 20 + j) >> _U(32)) * _U(part)) >> _U(32)).astype(np.int64)
        np.add.at(flat["count"], at, many.astype(np.int32))
        np.add.at(flat["key"], at, value)
        np.add.at(flat["check"], at, check)


def peel(left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(done, owners, keys, signs) of subtracted sketches: whether each came out empty, and what was recovered."""
    owners, cells = left.shape
    flat = left.reshape(-1).copy()
    found: list[tuple] = []
    live = np.arange(len(flat))
    while len(live):
        count = flat["count"][live]
        at = live[np.abs(count) == 1]
        sign = flat["count"][at].astype(np.int64)
        key = flat["key"][at] * sign.astype(_U)
        pure = flat["check"][at] == _mix(key, 99).astype(np.uint32) * sign.astype(np.uint32)
        key, sign, owner = key[pure], sign[pure], at[pure] // cells
        order = np.lexsort((key, owner))
        key, sign, owner = key[order], sign[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, sign, owner = key[new], sign[new], owner[new]
        if not len(key):
            break
        put(flat, key, owner, cells, -sign)
        found.append((owner, key, sign))
        busy = np.unique(owner)
        live = (busy[:, None] * cells + np.arange(cells)).ravel()
    empty = (flat["count"] == 0) & (flat["key"] == 0) & (flat["check"] == 0)
    whole = tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))
    return empty.reshape(owners, cells).all(axis=1), *whole


def encode(cells: np.ndarray) -> list[str]:
    """A fingerprint's text: the cells of each sketch in base64."""
    return [base64.b64encode(row.tobytes()).decode() for row in cells]


def decode(fingerprints: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(base64.b64decode, fingerprints)), _CELL).reshape(len(fingerprints), -1)


class Sets:
    """Paragraph keys of some texts, with the small sketches that are their fingerprints."""

    def __init__(self, texts: list[bytes], cells: int = CELLS) -> None:
        self.keys, self.size = paragraph_keys(texts)
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.cells = sketch(self.keys, np.repeat(np.arange(len(texts)), self.size), len(texts), cells)

    def chosen(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, place in ``rows``) of the texts at ``rows``."""
        n = self.size[rows]
        place = np.repeat(np.arange(len(rows)), n)
        return self.keys[np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], place


def differences(a: Sets, rows_a: np.ndarray, b: Sets, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs only in the first and only in the second text of each pair, from subtracted sketches."""
    only_a, only_b = np.zeros(len(rows_a), np.int64), np.zeros(len(rows_a), np.int64)
    todo = np.arange(len(rows_a))
    x, y = a.cells[rows_a], b.cells[rows_b]
    left = np.empty(x.shape, _CELL)
    for name in ("count", "key", "check"):
        left[name] = x[name] - y[name]
    while len(todo):
        done, owner, _, sign = peel(left)
        plus, minus = (np.bincount(owner[sign == s], minlength=len(todo)) for s in (1, -1))
        only_a[todo[done]], only_b[todo[done]] = plus[done], minus[done]
        todo, cells = todo[~done], left.shape[1] * GROWTH
        if len(todo):
            (ka, oa), (kb, ob) = a.chosen(rows_a[todo]), b.chosen(rows_b[todo])
            sign = np.concatenate([np.ones(len(ka), np.int64), -np.ones(len(kb), np.int64)])
            left = sketch(np.concatenate([ka, kb]), np.concatenate([oa, ob]), len(todo), cells, sign)
    return only_a, only_b


def likeness(a: Sets, rows_a: np.ndarray, b: Sets, rows_b: np.ndarray) -> np.ndarray:
    """Shared paragraphs over all paragraphs of each pair; 1 where neither text has any."""
    only_a, only_b = differences(a, rows_a, b, rows_b)
    union = a.size[rows_a] + only_b
    return np.where(union > 0, (a.size[rows_a] - only_a) / np.maximum(1, union), 1.0)


_FIRST = -(2**63)


def _deal(bounds: list[int], schema: pa.Schema):
    """Each row to the range its id falls into, and the first rows of a range also to the end of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(bounds, np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = np.maximum(0, np.searchsorted(starts, key, "right") - 1)
            again = np.flatnonzero(np.isin(key, starts))
            for rows, bucket, tail in ((None, own, False), (again, (own[again] - 1) % max(1, len(starts)), True)):
                part = batch if rows is None else batch.take(pa.array(rows))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(part.num_rows, tail)), *part.columns], schema=schema)

    return run


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    ``edited`` is the text with its last half replaced by the start of the next document's text, in ascending order
    of id; the last document is followed by the first. Ids are integers; null comes first; rows that repeat an id
    follow each other in the order of their texts. A null text is empty; an empty table gives no rows. The rows are
    dealt to ranges of ids and sorted there once; a range also holds the first row of the next one.
    """
    rows = plain(docs, id_col, text_col).select(
        F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("id").cast("bigint"), F.lit(_FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * tasks
    low = rows.agg(F.min("key").alias("low"), F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 50 * ranges).alias("at")).first()
    bounds = sorted({low["low"], *low["at"]}) if low["low"] is not None else []
    ddl = "bucket int, tail boolean, id bigint, key bigint, text string"
    dealt = rows.mapInArrow(_deal(bounds, arrow_schema(ddl)), ddl).repartition(tasks, "bucket").sortWithinPartitions("bucket", "tail", "key", "text")
    out = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_print(cells, arrow_schema(out)), out)


def _print(cells: int, schema: pa.Schema):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        """Result rows of (id, text, next text); most rows are followed by their next text's own row."""
        texts = [t for _, t, _ in rows]
        follow = [n for _, _, n in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, follow)]
        starts = [k for k in range(len(rows)) if k + 1 == len(rows) or rows[k + 1][1] is not follow[k]]
        extra = [follow[k] for k in starts]
        own = Sets([t.encode() for t in (*texts, *extra)], cells)
        new = Sets([t.encode() for t in edited], cells)
        at = np.arange(len(rows))
        after = at + 1
        after[starts] = len(rows) + np.arange(len(starts))
        near = [likeness(own, at, new, at), likeness(own, at, own, after)]
        columns = [[i for i, _, _ in rows], [len(t) for t in texts], edited, encode(own.cells[: len(rows)]), encode(new.cells), *near]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        before, size = None, 0
        for part in slices(batches):
            for bucket, tail, i, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "tail", "id", "text"))):
                if before is not None and before[0] == bucket:
                    ready.append((before[1], before[2], text))
                    size += len(text)
                before = None if tail else (bucket, i, text)
                if size > SLICE_BYTES // 2:
                    yield batch(ready)
                    ready, size = [], 0
        if ready:
            yield batch(ready)

    return run
