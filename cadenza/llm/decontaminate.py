"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import plain, slices

#: Words of one window of an item; an item with fewer words is one window.
WINDOW = 10
#: Characters of items in one automaton; more items make more automata, each of bounded size.
BLOCK_CHARS = 600_000
#: Words of one piece of a long item; pieces overlap by a window less one word.
PIECE_WORDS = 20_000

_KEPT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: letters A-Z lower-cased, cut at ASCII characters that are no letter or digit."""
    return text.translate(_KEPT).split()


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``step`` is the transition table of each state, ``link`` its suffix link, ``length`` its longest word
    sequence. A state knows the items in which its sequences occur by its own ends and those of the states whose
    links lead to it.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[str | None]] = [set()]
        self.short: dict[int, dict[int, set[str]]] = {}
        pairs = set()
        self.shortest = window
        for name, item in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item]
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for w in ids:
                last = self._extend(last, w, own)
                own[last].add(name)
            if 0 < len(ids) < window:
                self.shortest = min(self.shortest, len(ids))
                self.short.setdefault(last, {}).setdefault(len(ids), set()).add(name)
        self.base = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * self.base + b for a, b in pairs], np.int64))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            own[self.link[s]] |= own[s]
        own[0] = set()
        self.items = own

    def _extend(self, last: int, w: int, own: list[set[str]]) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w, own)
        new = self._state(length[last] + 1, own)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w, own)
        return new

    def _state(self, size: int, own: list[set[str]]) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(size)
        own.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int, own: list[set[str]]) -> int:
        copy = self._state(self.length[p] + 1, own)
        self.step[copy] = dict(self.step[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, ids: list[int]) -> Iterator[tuple[int, int, int, set[str]]]:
        """(start, end, longest match, items) for each place where a window of an item ends."""
        state = matched = 0
        step, link, length, window = self.step, self.link, self.length, self.window
        for i, w in enumerate(ids):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w not in step[state]:
                continue
            state, matched = step[state][w], matched + 1
            s = state
            if matched >= window:
                while length[link[s]] >= window:
                    s = link[s]
                yield i + 1 - window, i + 1, matched, self.items[s]
            if self.short:
                while s > 0:
                    for size, names in self.short.get(s, {}).items():
                        if size <= matched:
                            yield i + 1 - size, i + 1, matched, names
                    s = link[s]

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches whose words and neighbouring pairs all occur in items: the first two steps of every match."""
        if not len(ids):
            return
        if self.shortest == 1:
            good = ids > 0
        else:
            good = np.zeros(len(ids), bool)
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            code = ids[both].astype(np.int64) * self.base + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            if len(self.pairs):
                good[both[self.pairs[at] == code]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        more = 0 if self.shortest == 1 else 1
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + more >= self.shortest:
                yield a, b + more


class _Ids(dict):
    def __missing__(self, _key: bytes) -> int:
        return 0


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(item, piece, words): the words of each item, long ones in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for name, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                got = words((text or "").encode())
                for at in range(0, max(1, len(got) - window + 1), PIECE_WORDS):
                    if got:
                        rows.append({"item": name, "piece": at, "words": b" ".join(got[at : at + PIECE_WORDS + window - 1])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("piece", pa.int64()), ("words", pa.binary())]))

    return items.withColumn("id", F.col("id").cast("string")).mapInArrow(run, "item string, piece bigint, words binary")


def automata(items: DataFrame, *, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Automaton]:
    """Automata that together hold all items, each over about ``block_chars`` characters of them.

    Items without words take part in nothing. Rows that repeat an id add their windows to it, and so do those with a
    null id to the null one.
    """
    pieces = _pieces(plain(items, id_col, text_col), window)
    size = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for k in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == k).collect()
        yield Automaton(sorted(((r["item"], bytes(r["words"]).split(b" ")) for r in rows), key=lambda x: (_by_id(x[0]), x[1])), window)


def _by_id(name: str | None) -> tuple[bool, str]:
    """Sort key of item ids, null last."""
    return name is None, name or ""


def find_contamination(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, text, n_words, spans (array of word ranges, end exclusive, disjoint),
    longest (longest match in words), items (sorted ids of items with an occurring window, one null for all without id),
    and the columns ``keep``.

    The documents stream past each automaton inside the tasks that read them; no shuffle. An automaton is bounded
    by ``block_chars``; more items mean more passes over the same rows in the same job. Null texts have no words;
    repeated rows each get their row; an empty item table or document table gives no hits or no rows.
    """
    spark = docs.sparkSession
    named = {f"keep_{k}": c for k, c in enumerate(keep)}
    rows = plain(docs, id_col, text_col, **named).withColumns(
        {"n_words": F.lit(None).cast("bigint"), "spans": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
         "longest": F.lit(0).cast("bigint"), "items": F.expr("cast(array() as array<string>)")}
    )
    for automaton in automata(items, window=window, id_col=item_col, text_col=item_text_col, block_chars=block_chars):
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(automaton)), rows.schema)
    return rows.select(F.col("id").alias("doc_id"), "text", "n_words", "spans", "longest", "items", *(F.col(k).alias(c) for k, c in named.items()))


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        known = _Ids(automaton.vocabulary)
        for part in slices(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            ids, starts, at = [], [], 0
            for t in texts:
                got = words(t) if t else []
                ids.append(np.fromiter(map(known.__getitem__, got), np.int32, len(got)))
                starts.append(at)
                at += len(got) + 1
                ids.append(np.zeros(1, np.int32))
            flat = np.concatenate(ids)
            hits: dict[int, list] = {}
            begin = np.array(starts)
            for a, b in automaton.candidates(flat):
                row = int(np.searchsorted(begin, a, "right")) - 1
                for s, e, matched, names in automaton.scan(flat[a:b].tolist()):
                    hits.setdefault(row, []).append((a + s - starts[row], a + e - starts[row], matched, names))
            counts = [n - s - 1 for s, n in zip(starts, [*starts[1:], at])]
            spans, longest, items = (part.column(c).to_pylist() for c in ("spans", "longest", "items"))
            for row, found in hits.items():
                spans[row] = _merge([(x["start"], x["end"]) for x in spans[row]] + [(s, e) for s, e, _, _ in found])
                longest[row] = max(longest[row], max(m for _, _, m, _ in found))
                items[row] = sorted(set(items[row]).union(*(names for _, _, _, names in found)), key=_by_id)
            new = {"n_words": counts, "spans": spans, "longest": longest, "items": items}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else part.column(k) for k, f in enumerate(part.schema)], schema=part.schema
            )

    return run


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def hit_words() -> Column:
    """Words inside spans, as a column over the result of ``find_contamination``."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(found: DataFrame, *, max_coverage: float = 0.5) -> DataFrame:
    """The rows of ``find_contamination`` with hit spans cut out of ``text``.

    A document of which more than ``max_coverage`` of the words are hit goes altogether.
    """
    kept = found.where(F.col("n_words").isNull() | (hit_words() <= F.col("n_words") * max_coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            for row, spans in enumerate(part.column("spans").to_pylist()):
                if spans:
                    raw = texts[row].encode()
                    at = [m.span() for m in _WORD.finditer(raw.translate(_KEPT))]
                    parts, done = [], 0
                    for x in spans:
                        parts.append(raw[done : at[x["start"]][0]])
                        done = at[x["end"] - 1][1]
                    texts[row] = b"".join([*parts, raw[done:]]).decode()
            k = part.schema.get_field_index("text")
            yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    return kept.mapInArrow(run, kept.schema)


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_coverage: float = 0.5, **options) -> DataFrame:
    """The documents, all columns, after ``decontaminate``; documents without hits stay as they are."""
    keep = {f"keep_{k}": c for k, c in enumerate(docs.columns) if c != text_col}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in keep.items()))
    found = decontaminate(find_contamination(rows, items, keep=tuple(keep), **options), max_coverage=max_coverage)
    back = {c: k for k, c in keep.items()} | {text_col: "text"}
    return found.select(*(F.col(back[c]).alias(c) for c in docs.columns))
