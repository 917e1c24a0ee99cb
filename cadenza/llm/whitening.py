"""Whitening of embeddings by an incremental eigendecomposition of their covariance.

Entries become integers, so the means are exact sums. Each task starts from the zero matrix and takes its rows up
one by one: row k+1 adds k/(k+1) times the outer product of its distance from the mean so far, a centred rank-one
update. An update of a known spectrum solves the secular equation 1 + rho * sum(z_j^2 / (d_j - x)) = 0 between
neighbouring poles; directions that the update does not touch, and all but one of equal eigenvalues, are deflated
before. Spectra of tasks are combined in a tree of fixed width, the eigenpairs of one being rank-one updates of the
other, with one more for the distance of the two means. A Rayleigh-Ritz step over all rows, summed by Spark in the
basis found so far, makes the eigenpairs good to double precision. What passes through the driver is squares of
the dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, plain, stage

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Spectra that one task combines.
WIDTH = 16
#: Entries beyond this (after scaling) count as not finite: their sums would leave 64 bits.
LARGEST = float(1 << 46)
#: Eigenvalues up to this share of the largest are rounding noise; such directions have no component.
NOISE = 1e-12
_EPS = np.finfo(float).eps


@dataclass
class Spectrum:
    """Rows so far, their mean, and the eigenpairs of their scatter matrix (eigenvalues ascending, vectors in columns)."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, row: np.ndarray) -> None:
        gap = row - self.mean
        if self.n:
            self.update(gap, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + gap / self.n

    def merge(self, other: Spectrum) -> None:
        """The spectrum of both sets of rows."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        gap = other.mean - self.mean
        if self.n:
            self.update(gap, self.n * other.n / (self.n + other.n))
        self.mean = self.mean + gap * (other.n / (self.n + other.n))
        self.n += other.n

    def update(self, v: np.ndarray, rho: float) -> None:
        """Adds ``rho`` times the outer product of ``v``."""
        self.values, self.vectors = rank_one(self.values, self.vectors, v, rho)


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of Q diag(d) Q' + rho v v', from those of the first part (``d`` ascending, not negative; rho > 0)."""
    z = v @ q
    size = float(z @ z)
    if not size * rho > 0:
        return d, q
    z, rho = z / size**0.5, rho * size
    least = 8 * _EPS * max(d[-1], rho)
    # Equal eigenvalues: a reflection within their directions leaves one of them to the update.
    far = np.diff(d) > least
    if not far.all():
        edge = np.flatnonzero(np.concatenate([[True], far, [True]]))
        q = q.copy()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            length = np.linalg.norm(z[a:b])
            if b - a > 1 and length > 0:
                w = z[a:b].copy()
                w[0] += length if w[0] >= 0 else -length
                w /= np.linalg.norm(w)
                sign = -1.0 if z[a] >= 0 else 1.0
                q[:, a:b] -= 2 * np.outer(q[:, a:b] @ w, w)
                z[a:b] = 0
                z[a] = sign * length
    live = np.flatnonzero(rho * np.abs(z) > least)
    if not len(live):
        return d, q
    poles, weight = d[live], z[live]
    base, shift = secular_roots(poles, weight, rho)
    # Differences of poles and roots, each from the pole its root is measured from.
    apart = (poles[:, None] - poles[base][None, :]) - shift[None, :]
    new = poles[base] + shift
    # The vector for which these roots are exact, so that the eigenvectors are orthogonal: the product over all roots
    # x_k - d_i by the one over all other poles d_j - d_i, paired so that each factor is near 1.
    m = len(live)
    gaps = poles[None, :] - poles[:, None]
    factor = -apart
    factor[:, :-1] /= np.where(np.tri(m, m - 1, -1, dtype=bool), gaps[:, :-1], gaps[:, 1:])
    exact = np.sqrt(np.abs(np.prod(factor, axis=1)))
    vectors = np.copysign(exact, weight)[:, None] / apart
    vectors /= np.linalg.norm(vectors, axis=0)
    d, q = d.copy(), q if not far.all() else q.copy()
    d[live] = new
    q[:, live] = q[:, live] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)), one right of each pole: (the nearer pole, distance from it).

    The sums left and right of a root are replaced by one pole each with the same value and slope, all roots side
    by side; a step that leaves its bracket is halved instead.
    """
    m = len(d)
    square = rho * z * z
    right = np.append(d[1:], d[-1] + square.sum())
    width = right - d
    own = np.arange(m)
    middle = 1 + (square[None, :] / (d[None, :] - (d + width / 2)[:, None])).sum(axis=1)
    base = np.where((middle >= 0) | (own == m - 1), own, own + 1)
    delta = d[None, :] - d[base][:, None]  # poles as seen from each root's origin
    low = np.where(base == own, np.where(middle >= 0, 0.0, width / 2), -width / 2)
    high = np.where(base == own, np.where(middle >= 0, width / 2, width), 0.0)
    x = np.where(base == own, width / 2, -width / 2)
    left_pole = delta[own, own]
    right_pole = np.append(delta[own[:-1], own[:-1] + 1], np.inf)
    left = np.tri(m)
    go = own
    for _ in range(rounds):
        y, a, b = x[go], left_pole[go] - x[go], right_pole[go] - x[go]
        every = len(go) == m
        sides = left if every else left[go]
        gap = (delta if every else delta[go]) - y[:, None]
        part = square / gap
        slope = part / gap
        both, psi = part.sum(axis=1), np.einsum("ij,ij->i", part, sides)
        phi, f = both - psi, 1 + both
        low[go], high[go] = np.where(f < 0, y, low[go]), np.where(f > 0, y, high[go])
        dpsi = np.einsum("ij,ij->i", slope, sides)
        dphi = slope.sum(axis=1) - dpsi
        # psi ~ r + s / (left - y) and phi ~ t + u / (right - y) with value and slope as here; the last has no right pole.
        last = ~np.isfinite(b)
        b = np.where(last, 1.0, b)
        s, u = a * a * dpsi, np.where(last, 0.0, b * b * dphi)
        c = 1 + psi - a * dpsi + np.where(last, 0.0, phi - b * dphi)
        p, w = c * (a + b) + s + u, c * a * b + s * b + u * a
        root = np.sqrt(np.maximum(p * p - 4 * c * w, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = y + np.where(last, a + s / c, np.where(p >= 0, 2 * w / (p + root), (p - root) / (2 * c)))
        new = np.where((new > low[go]) & (new < high[go]), new, (low[go] + high[go]) / 2)
        more = (np.abs(f) > 4 * _EPS * m * (1 + phi - psi)) & (new != y)
        go = go[more]
        if not len(go):
            break
        x[go] = new[more]
    return base, np.where(x == 0, np.finfo(float).tiny, x)


def integers(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their entries as scaled integers): of ``d`` finite entries that do not leave the range."""
    import pyarrow.compute as pc

    flat = vectors.flatten()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(flat, pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    right = np.flatnonzero(size == d)
    rows = values[start[right][:, None] + np.arange(d)[None, :]] if len(right) else np.zeros((0, d))
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * rows)
        fine = (np.abs(scaled) <= LARGEST).all(axis=1) if d else np.zeros(len(rows), bool)
    return right[fine], scaled[fine].astype(np.int64) + OFFSET


@dataclass
class Whitening:
    """A fitted map: exact row count and sums, unit eigenvectors (in columns) and eigenvalues, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def d(self) -> int:
        return len(self.sums)

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean goes off in integers, its fraction after that."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n*x - S)^2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        y = x - whole
        bound = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if bound * bound * max(1, self.d) < 1 << 62:
            g = self.n * y - np.array(rest, np.int64)
            return (g * g).sum(axis=1).tolist()
        g = y.astype(object) * self.n - np.array(rest, object)
        return (g * g).sum(axis=1).tolist()


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, of equally frequent ones the largest; 0 if no vector has entries."""
    n = F.size("vec")
    found = vectors.where("vec is not null").groupBy(n.alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension."""
    ddl = "j int, n bigint, s decimal(38,0)"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        n, s = 0, [0] * d
        for batch in batches:
            x = integers(batch.column("vec"), d)[1]
            for k in range(0, len(x), 4096):
                part = x[k : k + 4096]
                n += len(part)
                s = [a + b for a, b in zip(s, part.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, s), pa.decimal128(38, 0))], schema=schema)

    got = vectors.select("vec").mapInArrow(run, ddl).groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return max((r["n"] for r in got), default=0), [int(r["s"]) for r in sorted(got)]


_SPECTRUM = "part bigint, n bigint, mean binary, vals binary, vecs binary"


def _row(part: int, s: Spectrum, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (s.mean, s.values, s.vectors))], schema=schema
    )


def _read(d: int, n: int, mean: bytes, values: bytes, vectors: bytes) -> Spectrum:
    return Spectrum(n, np.frombuffer(mean), np.frombuffer(values), np.frombuffer(vectors).reshape(d, d))


def partial_spectra(vectors: DataFrame, d: int, origin: list[int]) -> DataFrame:
    """A spectrum for each task, numbered without gaps of meaning; rows are taken relative to an integer ``origin``."""
    schema = arrow_schema(_SPECTRUM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, start = Spectrum.empty(d), np.array(origin, np.int64)
        for batch in batches:
            for row in (integers(batch.column("vec"), d)[1] - start).astype(float):
                s.add(row)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s, schema)

    return vectors.select("vec").mapInArrow(run, _SPECTRUM)


def combine(spectra: DataFrame, d: int, width: int = WIDTH) -> Spectrum:
    """All spectra as one: ``width`` of them meet in a task, until one is left; each level is written."""
    schema = arrow_schema(_SPECTRUM)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "mean", "vals", "vecs"))))
        s = _read(d, *rows[0][1:])
        for r in rows[1:]:
            s.merge(_read(d, *r[1:]))
        return pa.Table.from_batches([_row(rows[0][0] // width, s, schema)])

    now = stage(spectra, "spectra")
    high = now.agg(F.max("part")).first()[0]
    while high:
        now = stage(now.groupBy((F.floor(F.col("part") / width)).alias("whole")).applyInArrow(join, _SPECTRUM), "spectra")
        high = high // width
    got = now.first()
    return _read(d, *got[1:]) if got else Spectrum.empty(d)


def _products(vectors: DataFrame, w: Whitening, basis: np.ndarray) -> np.ndarray:
    """Sum over all rows of the outer products of centred rows in ``basis``."""
    k = basis.shape[1]
    ddl = "i int, v array<double>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = w.centre(integers(batch.column("vec"), w.d)[1]) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    parts = vectors.select("vec").mapInArrow(run, ddl).select("i", F.posexplode("v").alias("j", "x"))
    out = np.zeros((k, k))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return (out + out.T) / 2


def fit(vectors: DataFrame, *, vec_col: str = "embedding", components: int = COMPONENTS, width: int = WIDTH) -> Whitening | None:
    """The whitening of all usable rows of ``vectors``; None without one.

    A row is usable if its vector has the dimension of most rows and no null, non-finite or overlarge
    (``LARGEST``) entry. Directions without variance have no component, so there may be fewer than ``components``.
    """
    rows = vectors.select(F.col(vec_col).alias("vec"))
    d = dimension(rows)
    n, sums = _sums(rows, d) if d else (0, [])
    if not n:
        return None
    found = combine(partial_spectra(rows, d, [s // n for s in sums]), d, width)
    start = Whitening(n, sums, found.values[::-1], found.vectors[:, ::-1], 0.0)
    basis = np.linalg.qr(start.vectors)[0]
    ritz = _products(rows, start, basis) / n
    values, turn = np.linalg.eigh(ritz)
    values, turn = values[::-1], turn[:, ::-1]
    keep = values[:components] > NOISE * max(values[0], 0.0)
    out = Whitening(n, sums, values[:components][keep], (basis @ turn)[:, :components][:, keep], float(np.trace(ritz)))
    if len(out.values):
        out.identity_error = float(np.abs(_products(rows, out, out.vectors / np.sqrt(out.values)) / n - np.eye(len(out.values))).max())
    return out


def whiten(vectors: DataFrame, w: Whitening | None, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Rows are taken as they come, repeated ids and vectors included; null ids stay null. Other columns are ignored.
    Nothing is shuffled. Without usable rows, or where all of them are equal, there are no rows.
    """
    rows = plain(vectors, id_col, vec_col)
    ddl = f"vec_id {rows.schema['id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            if w is None or not len(w.values):
                continue
            at, x = integers(batch.column("text"), w.d)
            if not len(at):
                continue
            k, m = len(w.values), len(at)
            y = w.centre(x) @ w.vectors / np.sqrt(w.values)
            ids = batch.column("id").take(pa.array(np.repeat(at, k)))
            deviation = pa.array([Decimal(v) for v in w.deviations(x)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), deviation,
                pa.array(y.ravel()), pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, ddl)
