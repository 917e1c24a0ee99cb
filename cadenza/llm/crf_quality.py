"""Document quality from a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are shares of letters, symbols and repetitions in the line itself and in
the lines before and after it; a transition matrix joins neighbouring labels. The marginals of the forward-backward
pass, weighted with the lines' lengths, make the document's share of good text, and a logistic curve fitted on the
learning rows turns that share into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, crc_mod, plain, slices

#: Learning documents of each label at most; of more labelled rows a hash of the id picks about as many.
SAMPLE = 1500
#: Lines that one document teaches at most: evenly spread stretches, each of so many lines.
STRETCHES, LINES = 8, 32
FOLD = 5
CUT = 0.3

_LOWER, _UPPER, _DIGIT, _SPACE, _PIPE, _BANG, _SYMBOL, _POINT, _LINE = range(9)
_CLASS = np.full(256, _POINT, np.uint8)
for _kind, _chars in (
    (_LOWER, bytes(range(97, 123)) + bytes(range(128, 256))), (_UPPER, bytes(range(65, 91))), (_DIGIT, b"0123456789"),
    (_SPACE, b" \t\r\x0b\x0c"), (_PIPE, b"|"), (_BANG, b"!"), (_SYMBOL, b"$%*#&@^~=<>{}[]\\/_+"), (_LINE, b"\n"),
):
    _CLASS[list(_chars)] = _kind
_BYTE = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[list(b" \t\r\x0b\x0c\n")] = 0
#: Features of a line before those of its neighbours are added.
OWN = 10


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, weight of each line, lines of each text); a text without line ends is one line."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[raw]
    ends = np.flatnonzero(raw == 10)
    n = len(ends)
    size = np.diff(np.concatenate([[-1], ends])) - 1
    line = np.repeat(np.arange(n), size + 1)
    share = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float32)
    counts = np.array([t.count(b"\n") + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), counts)

    blank = (kind == _SPACE) | (kind == _LINE)
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    word = np.add.reduceat(_BYTE[raw], start) if len(start) else np.zeros(0, np.uint64)
    of = line[start]
    words = np.bincount(of, minlength=n)
    again = np.zeros(len(start), bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    first = np.concatenate([[0], np.cumsum(words)])
    place = (np.arange(len(start)) - first[of]).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((word ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93))])
    name = total[first[1:]] - total[first[:-1]]
    same_before = np.zeros(n, bool)
    same_before[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    key = name ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    seen = np.ones(n, bool)
    seen[np.unique(key, return_index=True)[1]] = False

    full = words > 0
    letters = np.maximum(1, share[:, _LOWER] + share[:, _UPPER])
    each = np.maximum(1, words)
    x = np.stack(
        [
            np.ones(n), np.log1p(size) / 8, share[:, _UPPER] / letters, np.minimum(3, share[:, _SYMBOL] / each), np.minimum(2, share[:, _PIPE] / each),
            np.minimum(3, share[:, _BANG] / each), np.bincount(of, again, n) / each, same_before & full, seen & full, share[:, _DIGIT] / np.maximum(1, size),
        ],
        axis=1,
    ).astype(np.float32)
    around = np.zeros((n, 2 * OWN), np.float32)
    inside = doc[1:] == doc[:-1]
    around[1:, :OWN][inside] = x[:-1][inside]
    around[:-1, OWN:][inside] = x[1:][inside]
    return np.concatenate([x, around], axis=1), size + 1.0, counts


@dataclass
class LineField:
    """Weights of a two-label chain: label 1 is good."""

    weights: np.ndarray
    step: np.ndarray
    slope: float = 8.0
    shift: float = -4.0

    def marginals(self, x: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(line is good) by scaled forward-backward, all texts side by side; with ``pairs`` also the summed
        probabilities of neighbouring labels."""
        psi = np.stack([np.zeros(len(x)), np.clip(x @ self.weights, -30, 30)], axis=1)
        psi = np.exp(psi - psi.max(axis=1, keepdims=True))
        move = np.exp(self.step)
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = np.argsort(-counts, kind="stable")
        begin, high = start[order], int(counts.max(initial=0))
        active = np.searchsorted(-counts[order], -np.arange(high), "left")
        front, back = np.zeros((len(x), 2)), np.ones((len(x), 2))
        for t in range(high):
            at = begin[: active[t]] + t
            a = psi[at] if t == 0 else (front[at - 1] @ move) * psi[at]
            front[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(high - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            b = (psi[at + 1] * back[at + 1]) @ move.T
            back[at] = b / b.sum(axis=1, keepdims=True)
        both = front * back
        good = both[:, 1] / both.sum(axis=1)
        if not pairs:
            return good
        left = np.ones(len(x), bool)
        left[start + counts - 1] = False
        i = np.flatnonzero(left)
        joint = front[i][:, :, None] * move[None] * (psi[i + 1] * back[i + 1])[:, None, :]
        return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0), i

    def shares(self, x: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of good text of each document."""
        good = self.marginals(x, counts)
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.shares(*line_features(texts)) + self.shift)))


def fit(x: np.ndarray, weight: np.ndarray, counts: np.ndarray, quality: np.ndarray, *, rounds: int = 2, steps: int = 60) -> LineField:
    """Maximum likelihood by Adam steps on labels of lines, which at first are those of their documents.

    After each round the lines of bad documents that the field finds good become good, but for the worst one.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    y = quality[doc].astype(float)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    balance = np.where(quality[doc] == 1, 1.0, max(1.0, quality.mean() / max(1e-9, 1 - quality.mean())))
    for _ in range(rounds):
        theta = np.concatenate([field.weights, field.step.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            field.weights, field.step = theta[:-4], theta[-4:].reshape(2, 2)
            good, joint, i = field.marginals(x, counts, pairs=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
            grad = np.concatenate([x.T @ ((y - good) * balance), (seen - joint).ravel()]) / len(x) - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        field.weights, field.step = theta[:-4], theta[-4:].reshape(2, 2)
        good = field.marginals(x, counts)
        y = np.where(quality[doc] == 1, 1.0, (good > 0.5).astype(float))
        worst = np.minimum.reduceat(good, start)
        y[(quality[doc] == 0) & (good <= worst[doc])] = 0.0
    share = field.shares(x, weight, counts)
    a, b = 8.0, -4.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * share + b)))
        g = quality - p
        h = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * share * share).sum(), (h * share).sum()], [(h * share).sum(), h.sum()]]) + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, np.array([(g * share).sum() - 1e-2 * a, g.sum() - 1e-2 * b]))
        a, b = a + move[0], b + move[1]
        if abs(move).max() < 1e-8:
            break
    field.slope, field.shift = float(a), float(b)
    return field


def spread_lines(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lines that teach, lines of each text): all of a short text, evenly spread stretches of a long one."""
    start, out, kept = np.concatenate([[0], np.cumsum(counts)[:-1]]), [], []
    for a, n in zip(start.tolist(), counts.tolist()):
        at = np.arange(n)
        if n > STRETCHES * LINES:
            at = (np.linspace(0, n - LINES, STRETCHES).astype(int)[:, None] + np.arange(LINES)).ravel()
        out.append(a + at)
        kept.append(len(at))
    return np.concatenate(out) if out else np.zeros(0, int), np.array(kept, int)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = FOLD, sample: int = SAMPLE) -> LineField:
    """A field from the labelled rows whose crc32(id as text) mod ``fold`` is not 0, about ``sample`` of each label.

    Of a document at most ``STRETCHES`` stretches of ``LINES`` lines teach, which are taken as neighbours; of rows
    that repeat an id the one whose text has the smallest hash, of labels the smallest. Rows with a null id or label
    teach nothing; with fewer than two labels the field keeps its start values, with
    which every text scores alike.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(crc_mod(F.col("id"), fold) != 0)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return LineField(np.zeros(3 * OWN), np.zeros((2, 2)))
    rank = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = known.where(rank < share * 1_000_000).groupBy("id").agg(F.min("label").alias("label"))
    rows = plain(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("label", "text")
    ddl = "label int, lines int, x binary, weight binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, weight, counts = line_features([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            at, counts = spread_lines(counts)
            x, weight, at = x[at], weight[at], np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(counts, pa.int32()), *(pa.array([p.tobytes() for p in np.split(v, at)], pa.binary()) for v in (x, weight))], schema=schema
            )

    got = sorted(rows.mapInArrow(run, ddl).collect())
    if len({r["label"] for r in got}) < 2:
        return LineField(np.zeros(3 * OWN), np.zeros((2, 2)))
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, 3 * OWN)
    weight = np.frombuffer(b"".join(r["weight"] for r in got))
    return fit(x.astype(float), weight, np.array([r["lines"] for r in got]), np.array([r["label"] for r in got], float))


def score(docs: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; a null or empty text is one empty line. Nothing is shuffled."""
    rows = plain(docs, id_col, text_col)
    ddl = f"doc_id {rows.schema['id'].dataType.simpleString()}, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(field.scores(texts))], schema=schema)

    return rows.mapInArrow(run, ddl)


def keep_good(docs: DataFrame, field: LineField, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents whose score reaches ``cut``, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = [t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()]
            yield part.filter(pa.array(field.scores(texts) >= cut))

    return docs.mapInArrow(run, docs.schema)
