"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths slide over windows of fixed length; the largest response of each filter in a window goes
into a softmax layer. A filter is a table of weights for each of its places and byte values, so a response is a sum
of looked-up rows; for whole texts the tables of two neighbouring places are joined into one over byte pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, crc_mod, plain, slices
from cadenza.plans.skew import top_k

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Learning documents of each language at most: of more distinct texts, those with the smallest hashes.
SAMPLE = 600
#: Texts that pass the first cut by hash, as a multiple of the sample; their number is estimated to 2 %.
MARGIN, ESTIMATE = 1.5, 0.02
#: Windows of one learning document at most, evenly spread over it.
WINDOWS = 4
FOLD, HELD_OUT = 4, 2
UNKNOWN = "und"

_REACH = max(WIDTHS) - 1
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, windows of each text): all of each text, padded with spaces; each window ends with the first
    bytes of what follows, so that every place of the text starts a response of every width."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts], np.int64)
    body = b"".join(t.ljust(n * window) for t, n in zip(texts, counts.tolist())) + b" " * _REACH
    flat = np.frombuffer(body, np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(flat, window + _REACH)[::window].copy()
    out[np.cumsum(counts) - 1, window:] = 32
    return out, counts


@dataclass
class ByteNet:
    """``tables`` holds, for each width, weights by place, byte and filter."""

    languages: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    shift: np.ndarray | None = None

    def __post_init__(self) -> None:
        if not self.tables:
            rng, n = np.random.default_rng(1), len(WIDTHS) * FILTERS
            self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
            self.bias = np.zeros(n, np.float32)
            self.out = rng.normal(0, 0.2, (n, len(self.languages))).astype(np.float32)
            self.shift = np.zeros(len(self.languages), np.float32)

    def responses(self, x: np.ndarray, places: bool = False):
        """Largest response of each filter in each window, and with ``places`` where it is."""
        size, most, where = x.shape[1] - _REACH, [], []
        for table in self.tables:
            r = table[0][x[:, :size]]
            for o in range(1, len(table)):
                r += table[o][x[:, o : o + size]]
            if places:
                where.append(r.argmax(axis=1))
                most.append(np.take_along_axis(r, where[-1][:, None, :], 1)[:, 0])
            else:
                most.append(r.max(axis=1))
        return (np.concatenate(most, axis=1), where) if places else np.concatenate(most, axis=1)

    def paired(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width the tables to add up: (place, table over a byte pair or one byte)."""
        out = []
        for table in self.tables:
            parts, o = [], 0
            while o < len(table):
                if o + 1 < len(table):
                    parts.append((o, (table[o][:, None, :] + table[o + 1][None, :, :]).reshape(65536, FILTERS)))
                else:
                    parts.append((o, table[o]))
                o += 2
            out.append(parts)
        return out

    def log_odds(self, largest: np.ndarray) -> np.ndarray:
        return np.maximum(largest + self.bias, 0) @ self.out + self.shift


def train(windows: np.ndarray, answer: np.ndarray, languages: list[str], *, epochs: int = 12, batch: int = 128, rate: float = 0.01) -> ByteNet:
    """Adam steps on the cross entropy; only the places of the largest responses pass gradients on."""
    net, rng = ByteNet(languages), np.random.default_rng(2)
    params = [*net.tables, net.bias, net.out, net.shift]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    k = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = windows[rows]
            largest, where = net.responses(x, places=True)
            active = np.maximum(largest + net.bias, 0)
            z = active @ net.out + net.shift
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), answer[rows]] -= 1
            p /= len(rows)
            down = (p @ net.out.T) * (active > 0)
            grads, row = [], np.arange(len(rows))[:, None]
            for i, table in enumerate(net.tables):
                part = down[:, i * FILTERS : (i + 1) * FILTERS]
                cell = [x[row, where[i] + o].astype(np.int64) * FILTERS + np.arange(FILTERS) for o in range(len(table))]
                grads.append(np.stack([np.bincount(c.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS) for c in cell]))
            grads += [down.sum(axis=0), active.T @ p, p.sum(axis=0)]
            k += 1
            for i, (w, g) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w -= (rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """A network from rows with text and language whose crc32(id as text) mod 4 is not 2; None without such rows.

    Copies of a text under one language teach once: the sample is the ``sample`` distinct texts of each language
    with the smallest hashes. The number of distinct texts is estimated only to let few more than those through.
    """
    rows = plain(docs, id_col, text_col, lang=lang_col).where("text is not null and lang is not null")
    rows = rows.where(F.coalesce(crc_mod(F.col("id"), FOLD), F.lit(0)) != HELD_OUT)
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", ESTIMATE).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    bounds = {lang: min(2**63 - 1, int(MARGIN * sample / n * 2**63)) for lang, n in sizes.items()}
    chosen = rows.where(F.coalesce(*(F.when(F.col("lang") == lang, F.lit(bounds[lang])) for lang in languages)) >= F.col("h"))
    ddl = "lang string, h bigint, windows binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of about MARGIN * sample texts of each language
        for part in slices(batches):
            out = []
            for lang, t, h in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("h").to_pylist()):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    got = cut([t])[0]
                    out.append((lang, h, got[np.unique(np.linspace(0, len(got) - 1, WINDOWS).astype(int))].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    texts = chosen.mapInArrow(run, ddl).groupBy("lang", "h").agg(F.min("windows").alias("windows"))
    got = sorted(top_k(texts, ["lang"], [F.col("h")], sample).select("lang", "h", "windows").collect())
    if not got:
        return None
    windows = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW + _REACH) for r in got]
    answer = np.repeat([languages.index(r["lang"]) for r in got], [len(w) for w in windows])
    return train(np.concatenate(windows), answer, languages)


def predict(docs: DataFrame, net: ByteNet | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): language of every whole text and its probability.

    The mean over a text's windows decides. ``und`` with score 0 where a text is null or has no letter, or no
    language was learned. Every row gets its row, repeated ones too; nothing is shuffled.
    """
    rows = plain(docs, id_col, text_col)
    ddl = f"doc_id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.paired() if net else None
        for part in slices(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if net and t and has_letter(t)]
            if known:
                windows, counts = cut([texts[k] for k in known])
                z = np.add.reduceat(_whole(net, tables, windows), np.concatenate([[0], np.cumsum(counts)[:-1]])) / counts[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for k, best, top in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    lang[k], score[k] = net.languages[best], top
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return rows.mapInArrow(run, ddl)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def _whole(net: ByteNet, tables: list, windows: np.ndarray, rows: int = 64) -> np.ndarray:
    """Log odds of each window, a few windows at a time so that the responses stay in the processor's cache."""
    size = windows.shape[1] - _REACH
    largest = np.empty((len(windows), len(tables) * FILTERS), np.float32)
    for at in range(0, len(windows), rows):
        x = windows[at : at + rows]
        wide = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        for i, parts in enumerate(tables):
            total = None
            for o, table in parts:
                got = table.take((wide if len(table) > 256 else x)[:, o : o + size], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            largest[at : at + rows, i * FILTERS : (i + 1) * FILTERS] = total.max(axis=1)
    return net.log_odds(largest)
