"""Slots in which one listener holds every track are added up in whole rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from cadenza.functions.columns import RANK_DIGITS
from cadenza.operators.neighbours import _slot_sums

ENTRY = pa.struct([("track_id", pa.int64()), ("x", pa.float64())])
OWN = pa.struct([*ENTRY, ("split", pa.bool_())])


class Dealt:
    """Stands for the dealt rows: keeps the function that Spark would run on them."""

    schema = T.StructType([T.StructField("others", T.ArrayType(T.StructType([T.StructField("track_id", T.LongType())])))])

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _rows(histories, tracks, split=()):
    own, others = [], []
    for h in histories:
        own.append([{"track_id": t, "x": x, "split": t in split} for t, x in h if t in tracks])
        others.append([{"track_id": t, "x": x} for t, x in h])
    columns = [pa.array([7] * len(own)), pa.array(own, pa.list_(OWN)), pa.array(others, pa.list_(ENTRY))]
    return pa.RecordBatch.from_arrays(columns, names=["slot", "own", "others"])


def _sums(rows, k, step):
    out = [b.to_pylist() for b in _slot_sums(Dealt(), k, step).run([rows])]
    return [(r["i"], r["j"], r["s"]) for part in out for r in part]


@pytest.mark.parametrize("step", [3, 50, 1_000_000])
def test_whole_rows_give_the_same_lists(step):
    rng = np.random.default_rng(3)
    values = [-1.0, 0.5, 1.0, 2.0]
    one = [(t, float(rng.choice(values))) for t in range(30)]
    few = [[(int(t), float(rng.choice(values))) for t in rng.choice(40, 4, replace=False)] for _ in range(12)]
    histories, tracks, k = [one[:16], one[16:], *few], set(range(0, 40, 3)), 4
    expected = {}
    for h in histories:
        for i, x in h:
            for j, y in h:
                if i in tracks and i != j:
                    expected[i, j] = expected.get((i, j), 0.0) + x * y
    best = set()
    for i in tracks:
        mine = sorted((-round(s, RANK_DIGITS), j) for (a, j), s in expected.items() if a == i and s != 0)
        best |= {(i, j, -s) for s, j in (mine if i == 9 else mine[:k])}
    assert {(i, j, round(s, RANK_DIGITS)) for i, j, s in _sums(_rows(histories, tracks, split={9}), k, step)} == best


def test_products_of_a_held_catalog_are_not_sorted(monkeypatch):
    n, sorted_sizes, unique = 400, [], np.unique
    monkeypatch.setattr(np, "unique", lambda a, **kw: sorted_sizes.append(len(a)) or unique(a, **kw))
    pieces = [[(t, 1.0 + t % 5) for t in range(n)]]
    got = _sums(_rows(pieces, set(range(100))), 5, 20_000)
    assert len(got) == 500 and {j for i, j, _ in got if i == 4} == {9, 14, 19, 24, 29}
    assert max(sorted_sizes) <= n + 100  # the entries, not the 40,000 products
