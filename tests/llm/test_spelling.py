"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cadenza.llm import spelling

DOCS = "doc_id long, text string, word string, n int, key string"


def brute_counts(texts, least, often, damage):
    found = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= often}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute_variants(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def key(row):
    return row[0]


@pytest.mark.parametrize("seed, letters, shortest", [(1, "ab", 6), (2, "abcÀé", 6), (3, "ab", 1), (4, "abcdefgh", 7)])
def test_all_pairs_one_edit_apart_are_found(spark, seed, letters, shortest):
    rnd = random.Random(seed)
    words = {}
    for _ in range(250):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(shortest, shortest + 5)))
        words[w] = rnd.choice([1, 2, 5, 25, 30, 125, 700])
    for w in list(words)[:60]:  # chains of variants
        k = rnd.randrange(len(w))
        words[w[:k] + rnd.choice(letters) + w[k + rnd.randrange(2) :]] = 5 * words[w]
    df = spark.createDataFrame([(w, n, "x", "y") for w, n in words.items()], "word string, n long, form string, a string")
    for levels in (1, 2, 3):
        got = spelling.variants(df, levels=levels).collect()
        assert sorted((tuple(r) for r in got), key=key) == brute_variants(words, 5)


def test_query_over_texts(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdeÉü") for _ in range(rnd.randrange(5, 10))) for _ in range(40)]
    texts = [(i, " ".join(rnd.choice(base).capitalize() + rnd.choice(["", ".", "1", "×"]) for _ in range(200))) for i in range(60)]
    texts += [(None, "Ababab " * 9), (5, None), (6, ""), (7, "12 ."), (8, "x" * 5000), (8, "ababab, " * 8)]
    df = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in texts], DOCS)
    for damage in (None, 3, 199):
        counts = brute_counts(texts, 6, 5, damage)
        words = spelling.word_counts(df, damage=damage)
        assert {r.word: r.n for r in words.collect()} == counts
        assert sorted((tuple(r) for r in spelling.variants(words).collect()), key=key) == brute_variants(counts, 5)


def test_empty_table_and_bad_ratio(spark):
    words = spelling.word_counts(spark.createDataFrame([], DOCS))
    assert spelling.variants(words).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(words, ratio=1)
