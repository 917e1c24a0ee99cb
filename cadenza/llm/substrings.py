"""Substring deduplication by recompression: equal word sequences get equal names wherever they stand.

Three rounds name pairs of neighbouring symbols. A symbol's name is computed from its parts alone, so a name
means the same words in every task without a dictionary. A bit of the name puts a symbol into the left or the
right class of the round, and a left symbol followed by a right one becomes one symbol. Equal neighbours are of
one class: a run stays apart, each of its places is a boundary, and its anchors share one name that a batch
sends once. Whether a place is a boundary after round r depends on 2^(r-1) words on either side, and a symbol
spans at most 2^r words. Of every ``WINDOW`` words some boundary therefore lies 6 to 13 words after the start,
and it is the same in every copy: the 13 words around it are the window's anchor.

Job 1 finds anchors that occur more than once; names of 40 bits and a partition travel as packed arrays, one bit
for each comes back. Job 2 names the whole windows around repeated anchors (80 bits and a partition) and finds
for each name the batch where it starts first. The last step removes the words that later windows cover.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, plain, shared_folder, slices, stage

WINDOW = 20
ROUNDS = 3
#: An anchor is the words from ``BEFORE`` words before a boundary to ``AFTER`` words after it.
BEFORE, AFTER = 6, 7
#: Text bytes of one batch of neighbouring documents.
BATCH_BYTES = 8 << 20
#: Names that one task of a job compares.
TASK_NAMES = 1_500_000

_U = np.uint64
_C = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    x = a * _C[0]
    x += (b ^ _U(salt)) * _C[1]
    x ^= x >> _U(32)
    x *= _C[2]
    x ^= x >> _U(29)
    return x


class _WordNames(dict):
    """64-bit names of words, kept in the worker process; a name is never 0."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        name = xxhash.xxh3_64_intdigest(word) | 1
        if len(word) <= 64:
            self[word] = name
        return name


_names = _WordNames()
#: Words whose names a worker process keeps while a task runs.
KEPT_WORDS = 300_000


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, a 0 after each text; and the number of words of each text."""
    if len(_names) > KEPT_WORDS:
        _names.clear()
    parts, counts, end = [], np.zeros(len(texts), np.int64), np.zeros(1, _U)
    for k, t in enumerate(texts):
        got = t.split()
        counts[k] = len(got)
        parts += [np.fromiter(map(_names.__getitem__, got), _U, len(got)), end]
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), counts


def boundaries(words: np.ndarray) -> np.ndarray:
    """Places where a symbol starts after all rounds; a 0 separates texts."""
    name, start = words, np.arange(len(words))
    for r in range(ROUNDS):
        right = (_mix(name, name, r + 1) & _U(1)).astype(bool)
        real = name != 0
        head = np.zeros(len(name), bool)
        head[:-1] = (real & ~right)[:-1] & (real & right)[1:]
        keep = np.ones(len(name), bool)
        keep[1:] = ~head[:-1]
        pair = np.flatnonzero(head)
        named = name.copy()
        named[pair] = _mix(name[pair], name[pair + 1], 77 + r) | _U(1)
        name, start = named[keep], start[keep]
    return start[name != 0]


class Sequence:
    """The words of one batch with the names of their 4- and 8-word stretches."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        two = _mix(words[:-1], words[1:], 2)
        self.four = _mix(two[:-2], two[2:], 4) if len(two) > 2 else two[:0]
        self.eight = _mix(self.four[:-4], self.four[4:], 8) if len(self.four) > 4 else two[:0]
        self.ends = np.concatenate([[0], np.cumsum(words == 0)])

    def within(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those places from which ``size`` words lie in one text."""
        at = at[(at >= 0) & (at + size <= len(self.words))]
        return at[self.ends[at + size] == self.ends[at]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, name) of each anchor."""
        at = self.within(boundaries(self.words) - BEFORE, BEFORE + AFTER)
        return at, _mix(self.eight[at], _mix(self.four[at + 8], self.words[at + 12], 12), 13)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names of the window at each place; together they are taken for its words."""
        a, b, c = self.eight[at], self.eight[at + 8], self.four[at + 16]
        return _mix(_mix(a, b, 16), c, 20), _mix(_mix(b, c, 116), a, 120)


def _narrow(names: np.ndarray, parts: int) -> np.ndarray:
    """Partition and 40 more bits of each name in one number."""
    part = ((names >> _U(32)) * _U(parts)) >> _U(32)
    return (part << _U(40)) | (names & _U((1 << 40) - 1))


def _pack(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(blob: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(blob) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _runs(sorted_parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(sorted_parts)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(sorted_parts)]):
        if b > a:
            yield int(sorted_parts[a]), a, b


_BATCH = "batch bigint, ids array<bigint>, sizes array<bigint>, n_words bigint, body binary"


def _batches(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """Documents in ascending order, some MB in a row; the rows' numbers ascend with their documents."""
    schema = arrow_schema(_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            body = pack.compress(b"".join(texts))
            words = sum(len(t.split()) for t in texts)
            return pa.RecordBatch.from_pylist([{"batch": number, "ids": ids, "sizes": [len(t) for t in texts], "n_words": words, "body": body}], schema)

        for part in slices(batches):
            for i, t in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= batch_bytes:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    rows = plain(docs, id_col, text_col)
    return rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, _BATCH)


def _write_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """A table in the shared folder, bucketed so that joins on ``key`` do not move it."""
    spark, name = df.sparkSession, f"substrings_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 - resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def _texts(body: bytes, sizes: list[int]) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes)]


def _sequence(texts: list[bytes]) -> tuple[Sequence, np.ndarray]:
    words, counts = word_names(texts)
    return Sequence(words), counts


def _flags(answer: list | None, values: np.ndarray) -> np.ndarray:
    """The bits that came back for the sorted distinct ``values`` of a batch."""
    out = np.zeros(len(values), bool)
    at = 0
    for x in sorted(answer or [], key=lambda x: x["part"]):
        out[at : at + x["n"]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).astype(bool)
        at += x["n"]
    return out


def _anchor_names(seq: Sequence, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, index into the sorted distinct names, those names)"""
    at, names = seq.anchors()
    distinct, inverse = np.unique(_narrow(names, parts), return_inverse=True)
    return at, inverse, distinct


def _candidates(seq: Sequence, parts: int, answer: list | None) -> np.ndarray:
    """Starts of the windows whose anchor occurs more than once, in this batch or in any other."""
    at, inverse, distinct = _anchor_names(seq, parts)
    if not len(at):
        return at
    repeated = (np.bincount(inverse, minlength=len(distinct)) > 1) | _flags(answer, distinct)
    hit = at[repeated[inverse]]
    mark = np.zeros(len(seq.words) + 1, np.int32)
    np.add.at(mark, np.maximum(0, hit + BEFORE + AFTER - WINDOW), 1)
    np.add.at(mark, hit + 1, -1)
    return seq.within(np.flatnonzero(np.cumsum(mark) > 0), WINDOW)


def _window_order(seq: Sequence, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its name in the order, long names, short names): by name, then by place."""
    a, b = seq.windows(at)
    b = b & _U(0xFFFF)
    order = np.lexsort((b, a))
    first = np.ones(len(at), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, first, a, b


def _part(a: np.ndarray, parts: int) -> np.ndarray:
    return ((a >> _U(32)) * _U(parts)) >> _U(32)


_SENT = "part int, batch bigint, names binary, more binary"
_BACK = "batch bigint, part int, n int, bits binary"


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _send_anchors(parts: int):
    schema = arrow_schema(_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in ("batch", "sizes", "body")}
                distinct = _anchor_names(_sequence(_texts(x["body"], x["sizes"]))[0], parts)[2]
                rows = [{"part": p, "batch": x["batch"], "names": _pack(distinct[a:b], 5), "more": None} for p, a, b in _runs(distinct >> _U(40))]
                if rows:
                    yield _rows(schema, rows)
        _names.clear()

    return run


def _collect(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
    return [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("part", "batch", "names", "more")))]


def _answer(sent: list[tuple], sizes: list[int], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema, at, rows = arrow_back(), 0, []
    for (part, batch, _, _), n in zip(sent, sizes):
        rows.append({"batch": batch, "part": part, "n": n, "bits": np.packbits(flags[at : at + n]).tobytes()})
        at += n
        if len(rows) == 4096:
            yield _rows(schema, rows)
            rows = []
    if rows:
        yield _rows(schema, rows)


def arrow_back() -> pa.Schema:
    return pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each name sent: does another batch send it too?"""
    sent = _collect(batches)
    if sent:
        names = [_unpack(x[2], 5) | (_U(x[0]) << _U(40)) for x in sent]
        _, inverse, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        yield from _answer(sent, [len(n) for n in names], count[inverse] > 1)


def _send_windows(parts: int):
    schema = arrow_schema(_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in ("batch", "sizes", "body", "anchors")}
                seq = _sequence(_texts(x["body"], x["sizes"]))[0]
                order, first, a, b = _window_order(seq, _candidates(seq, parts, x["anchors"]))
                own = order[first]
                a, b = a[own], b[own]
                rows = [
                    {"part": p, "batch": x["batch"], "names": a[s:e].astype("<u8").tobytes(), "more": _pack(b[s:e], 2)}
                    for p, s, e in _runs(_part(a, parts))
                ]
                if rows:
                    yield _rows(schema, rows)
        _names.clear()

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each name sent: does an earlier batch send it too?"""
    sent = _collect(batches)
    if sent:
        sizes = [len(x[2]) // 8 for x in sent]
        a = np.frombuffer(b"".join(x[2] for x in sent), "<u8")
        b = _unpack(b"".join(x[3] for x in sent), 2)
        batch = np.repeat(np.array([x[1] for x in sent], np.int64), sizes)
        order = np.lexsort((batch, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        flags = np.zeros(len(a), bool)
        flags[order[1:]] = same
        yield from _answer(sent, sizes, flags)


_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _remove(parts: int):
    schema = arrow_schema(_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in ("batch", "ids", "sizes", "body", "anchors", "windows")}
                texts = _texts(x["body"], x["sizes"])
                seq, counts = _sequence(texts)
                at = _candidates(seq, parts, x["anchors"])
                order, first, a, _ = _window_order(seq, at)
                gone = np.zeros(len(at), bool)
                gone[order[~first]] = True
                gone[order[first]] = _flags(x["windows"], a[order[first]])
                mark = np.zeros(len(seq.words) + 1, np.int32)
                np.add.at(mark, at[gone], 1)
                np.add.at(mark, at[gone] + WINDOW, -1)
                covered = np.cumsum(mark)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(covered)])
                start = np.concatenate([[0], np.cumsum(counts + 1)])
                n_removed = (removed[start[1:]] - removed[start[:-1]]).tolist()
                kept = []
                for k, t in enumerate(texts):
                    got = t.split()
                    if n_removed[k]:
                        got = [got[i] for i in np.flatnonzero(~covered[start[k] : start[k] + len(got)]).tolist()]
                    kept.append(b" ".join(got))
                for s in range(0, len(texts), 2000):
                    e = s + 2000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x["ids"][s:e], pa.int64()), pa.array(counts[s:e]), pa.array(n_removed[s:e], pa.int64()), pa.array(kept[s:e], pa.binary()).cast(pa.string())],
                        schema=schema,
                    )
        _names.clear()

    return run


def _by_batch(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("batch").agg(F.collect_list(F.struct("part", "n", "bits")).alias(name))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, task_names: int = TASK_NAMES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words of its repeated windows.

    A word goes if a window of 20 words that covers it also starts earlier: in a document of smaller id, or before
    it in the same one. Windows are judged on the input. Ids are integers; null counts as the smallest. Rows that
    repeat an id are taken as documents of their own in the order of their texts. A null or empty text has no
    words; an empty table gives no rows; columns not named are ignored. ``kept`` is the words left, with single
    spaces.
    """
    rows = _batches(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col, batch_bytes)
    spark = docs.sparkSession
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = _write_buckets(rows, "batch", buckets)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    tasks = max(4, -(-total // (2 * task_names)))
    parts = 4 * tasks
    sent = table.select("batch", "sizes", "body").mapInArrow(_send_anchors(parts), _SENT)
    anchors = stage(_by_batch(sent.repartition(tasks, "part").mapInArrow(_repeated, _BACK), "anchors"), "anchors")
    asked = table.join(anchors, "batch", "left")
    sent = asked.select("batch", "sizes", "body", "anchors").mapInArrow(_send_windows(parts), _SENT)
    windows = stage(_by_batch(sent.repartition(tasks, "part").mapInArrow(_later, _BACK), "windows"), "windows")
    full = asked.join(windows, "batch", "left")
    return full.select("batch", "ids", "sizes", "body", "anchors", "windows").mapInArrow(_remove(parts), _OUT)
