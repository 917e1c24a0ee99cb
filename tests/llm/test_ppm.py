"""Partial matching against a plain statement of its rule."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import ppm
from cadenza.llm.common import crc_mod

DOCS = "doc_id long, text string, word string, n int, batch string, learns int"


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "b", 0) for i, t in texts], DOCS).repartition(parts)


def symbols(text, order):
    raw = [0] * order + list("".join(c.lower() if c.isascii() else c for c in text or "").encode()) + [256]
    return [(tuple(raw[i - order : i]), raw[i]) for i in range(order, len(raw))]


def brute_cost(nodes, context, symbol):
    excluded, cost = set(), 0.0
    for k in range(len(context), -1, -1):
        node = nodes.get(context[len(context) - k :], {})
        left = {s: n for s, n in node.items() if s not in excluded}
        mass = 2 * sum(left.values())
        if symbol in left:
            return cost + math.log10((2 * left[symbol] - 1) / mass)
        if left:
            cost += math.log10(len(left) / mass)
        excluded |= set(node)
    return cost - math.log10(257 - len(excluded))


def brute(texts, learns, order):
    nodes, words = defaultdict(Counter), Counter()
    tokens = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    for i, t in texts:
        if learns(i):
            words.update(tokens(t))
            for context, s in symbols(t, order):
                for k in range(order + 1):
                    nodes[context[order - k :]][s] += 1
    n, size = sum(words.values()), sum(words.values()) + 0.1 * (len(words) + 1)
    out = []
    for i, t in texts:
        own = tokens(t)
        out.append((i, len(own), sum(w in words for w in own), n, sum(math.log10((words[w] + 0.1) / size) for w in own), sum(brute_cost(nodes, c, s) for c, s in symbols(t, order))))
    return out


def random_texts(seed, n=60):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice(["the", "The", "cat", "ÀB", "éa", "x\ty", "  ", "日本", "zz\n", "a\x85b", "q　r"])
    out = [(i, " ".join(pick() for _ in range(rnd.choice([0, 1, 5, 30])))) for i in range(n)]
    return out + [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a\x00b"), (3, "the cat the cat"), (3, "the cat the cat"), (1004, "never seen WORDS 12345")]


@pytest.mark.parametrize("order", [0, 2, 5])
def test_scores_are_those_of_the_rule(spark, order):
    texts = random_texts(order)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    df = table(spark, texts)
    got = ppm.score(df, crc_mod(F.col("doc_id"), 10) != 0, order=order, batch_bytes=700).collect()
    want = brute(texts, lambda i: not held(i), order)
    key = lambda r: (r[0], r[1], round(r[4], 6), round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a[:4]) == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])


def test_probabilities_of_a_context_add_up():
    nodes = {(): Counter({97: 3, 98: 1, 256: 1}), (97,): Counter({98: 2})}
    assert sum(10 ** brute_cost(nodes, (97,), s) for s in range(257)) == pytest.approx(1)


def test_long_text_comes_in_stretches(spark, monkeypatch):
    text = " ".join(random.Random(5).choice(["ab", "abc", "é"]) for _ in range(4000)) + "x" * 900
    texts = [text.encode(), b" a ", b""]

    def words():
        found = ppm._Words()
        parts = list(found.codes(texts))
        return found.known.to_pylist(), np.concatenate([c for c, _ in parts]).tolist(), np.concatenate([o for _, o in parts]).tolist()

    whole, grams = words(), [g for _, part in ppm._grams(iter(texts), 5) for g in part.tolist()]
    assert [whole[0][c] for c in whole[1]] == text.encode().split() + [b"a", b"", b"", b""]
    monkeypatch.setattr(ppm, "STRETCH", 512)
    assert whole == words()
    assert grams == [g for _, part in ppm._grams(iter(texts), 5) for g in part.tolist()]


def test_defined_results_without_learning_rows(spark):
    assert ppm.score(table(spark, [], 1), F.lit(True)).collect() == []
    (row,) = ppm.score(table(spark, [(None, "ab c")], 1), F.lit(None).cast("boolean")).collect()
    assert row.doc_id is None and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(-5 * math.log10(257))


def test_adaptive_code_learns_the_text(spark):
    texts = [(1, "abab" * 50), (2, "ab"), (3, None), (4, "")]
    got = {r.doc_id: r.score for r in ppm.adaptive_score(table(spark, texts), order=3).collect()}
    for i, t in texts:
        nodes, want = defaultdict(Counter), 0.0
        for context, s in symbols(t, 3):
            want += brute_cost(nodes, context, s)
            for k in range(4):
                nodes[context[3 - k :]][s] += 1
        assert got[i] == pytest.approx(want)
    assert got[1] / 201 > got[2] / 3
