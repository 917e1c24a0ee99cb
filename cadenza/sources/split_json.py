"""Records of one large JSON array, read by many tasks: byte ranges are cut at record borders.

``{"tracks": [{...}, {...}]}`` on one line cannot be split by Spark's JSON reader. Its text reader can: with the comma
as line separator a range gets the fragments that start in it. Whether a comma stands inside a string, and how deep it is
nested, depends on all text before, so the fragments are read twice: first each range tells what it changes (quotes and
depth, for both possible starts), a running sum over the ranges of a file gives every range its start, and then each range
gives out its whole records. A record that crosses ranges comes as pieces, which are few and put together at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.session import ensure_checkpoint_dir
from cadenza.sources.payloads import PAYLOAD_SCHEMAS, _exists

#: A quote that is not escaped: an even number of backslashes stands before it.
_QUOTE = re.compile(r'(?<!\\)(?:\\\\)*"')
#: Records are the elements of the array inside the outer object.
RECORD_DEPTH = 2
#: What a piece is: a whole record; the end, or an inner part, of one begun before the range; the begin of one that goes
#: on behind it; or only the number of records that end in the range.
WHOLE, END, BEGIN, COUNT = range(4)


def _outside(fragment: str, inside: int) -> tuple[list[str], int]:
    """The stretches of a fragment that are not in strings, and whether its end is inside one."""
    parts = _QUOTE.split(fragment) if '"' in fragment else [fragment]
    return parts[inside::2], (inside + len(parts) - 1) % 2


def _depth(stretches: list[str]) -> int:
    return sum(s.count("{") + s.count("[") - s.count("}") - s.count("]") for s in stretches)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _changes(batches: Iterator) -> Iterator:
    """(file, start, flips, depth outside, depth inside, fragments): what each range changes."""
    import pyarrow as pa

    key, state = None, None
    for batch in batches:
        for file, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
            if (file, start) != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "flips", "out", "in"), (*key, state[0], state[1], state[2])))])
                key, state = (file, start), [0, 0, 0]
            for k in (0, 1):
                state[1 + k] += _depth(_outside(value, (state[0] + k) % 2)[0])
            state[0] = _outside(value, state[0])[1]
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "flips", "out", "in"), (*key, state[0], state[1], state[2])))])


class _Records:
    """Cuts the fragments of one range; ``ends`` counts the records that end in it."""

    def __init__(self, inside: int, depth: int) -> None:
        self.inside, self.depth, self.ends = inside, depth, 0
        #: Whether the record at hand begins in this range, and its fragments so far.
        self.begun, self.held = depth < RECORD_DEPTH, []

    def _end(self) -> tuple[int, str]:
        piece = (WHOLE if self.begun else END), ",".join(self.held)
        self.held, self.begun, self.ends = [], True, self.ends + 1
        return piece

    def add(self, fragment: str) -> Iterator[tuple[int, str]]:
        """Pieces that are complete after this fragment and the comma behind it."""
        stretches, inside = _outside(fragment, self.inside)
        depth = self.depth + _depth(stretches)
        if min(self.depth, depth) >= RECORD_DEPTH:
            self.held.append(fragment)
            self.inside, self.depth = inside, depth
        else:
            yield from self._edge(fragment)
        if not self.inside and self.depth == RECORD_DEPTH:
            yield self._end()

    def _edge(self, fragment: str) -> Iterator[tuple[int, str]]:
        """A fragment in which the array begins or ends, or that lies outside of it, character by character."""
        text, escaped = [], False
        for c in fragment:
            if self.inside:
                self.inside = int(escaped or c != '"')
                escaped = c == "\\" and not escaped
            elif c == '"':
                self.inside = 1
            elif c in "{[":
                self.depth += 1
                if self.depth == RECORD_DEPTH:
                    text, self.held, self.begun = [], [], True
                    continue
            elif c in "}]":
                self.depth -= 1
                if self.depth == RECORD_DEPTH - 1:
                    self.held.append("".join(text))
                    yield self._end()
            text.append(c)
        if self.depth >= RECORD_DEPTH:
            self.held.append("".join(text))

    def rest(self) -> list[tuple[int, str]]:
        """The piece that the end of the range cuts off, if the range does not end at a border."""
        return [(BEGIN if self.begun else END, ",".join(self.held))] if self.held and self.depth >= RECORD_DEPTH else []


def _cut(batches: Iterator) -> Iterator:
    """(file, start, ends, place, text): pieces of records, and for each range the number of records that end in it."""
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("ends", pa.int64()), ("place", pa.int32()), ("text", pa.string())])
    out: list[tuple] = []
    key, range_ = None, None

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema=schema)

    def close() -> None:
        out.extend((*key, range_.ends, place, text) for place, text in range_.rest())
        out.append((*key, range_.ends, COUNT, ""))

    for batch in batches:
        for file, start, value, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value", "inside", "depth"))):
            if (file, start) != key:
                if key is not None:
                    close()
                key, range_ = (file, start), _Records(inside, depth)
            out.extend((*key, range_.ends, place, text) for place, text in range_.add(value))
        if len(out) > 2000:
            yield ready()
            out.clear()
    if key is not None:
        close()
        yield ready()


def read_split_payload(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    """Rows like those of ``read_payload``, one for each record of the payload's array; a missing file gives none.

    The outer object holds one array, under the payload's name, and besides it scalars only. For payloads whose
    records do not depend on their place: tracks, audio features, artists. Null records stay null.
    """
    schema = PAYLOAD_SCHEMAS[kind]
    name, element = schema.split(" array<", 1)
    if "," in name or kind in ("playlist", "recent"):
        raise ValueError(f"{kind} has fields beside its array")
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], schema)
    ensure_checkpoint_dir(spark)
    fragments = _fragments(spark, path)
    changes = fragments.mapInArrow(_changes, "file string, start bigint, flips bigint, out bigint, `in` bigint").checkpoint()
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    inside = changes.withColumn("inside", F.coalesce(F.sum("flips").over(before), zero) % 2)
    own = F.when(F.col("inside") == 1, F.col("in")).otherwise(F.col("out"))
    # One small row for each byte range of the files.
    states = inside.withColumn("depth", F.coalesce(F.sum(own).over(before), zero)).select("file", "start", "inside", "depth")
    cut = fragments.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", "inside", "depth")
    pieces = cut.mapInArrow(_cut, "file string, start bigint, ends bigint, place int, text string").checkpoint()

    whole = pieces.where(F.col("place") == WHOLE).select("text")
    offset = pieces.where(F.col("place") == COUNT).select("file", "start", F.coalesce(F.sum("ends").over(before), zero).alias("before"))
    crossing = pieces.where(F.col("place").isin(END, BEGIN)).join(offset, ["file", "start"])
    record = F.col("before") + F.when(F.col("place") == BEGIN, F.col("ends")).otherwise(0)
    parts = crossing.groupBy("file", record.alias("record")).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = parts.select(F.array_join(F.transform("p", lambda p: p["text"]), ",").alias("text"))
    return _parsed(whole.unionByName(joined), name, element[:-1])


def _parsed(records: DataFrame, name: str, element: str) -> DataFrame:
    """Each record's text as a payload row of one record; an empty array has no record."""
    body = F.from_json(F.concat(F.lit(f'{{"{name}":['), F.col("text"), F.lit("]}")), f"{name} array<{element}>")
    return records.where(F.col("text").rlike(r"\S")).select(body[name].alias(name))
