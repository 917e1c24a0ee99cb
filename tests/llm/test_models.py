"""Held-out accuracy of the fitted models, and their parts against plain sums."""

import itertools
import zlib

import numpy as np

from cadenza.llm import crf_quality, language_id, queries

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    got = queries.QUERIES["op1_byte_network"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def _taught(monkeypatch):
    """What ``learn`` hands to ``train``: number of windows of each language."""
    taught = {}

    def train(windows, answer, languages):
        taught.update({lang: int((answer == k).sum()) for k, lang in enumerate(languages)})
        return language_id.ByteNet(languages)

    monkeypatch.setattr(language_id, "train", train)
    return taught


def test_copies_of_a_text_teach_once(spark, monkeypatch):
    taught = _taught(monkeypatch)
    other = [(f"document {k} of a language", lang) for lang, n in (("de", 300), ("en", 300), ("fr", 8)) for k in range(n)]
    for hot in ("one hot text", "another hot text"):
        rows = [(k, *r) for k, r in enumerate([(hot, "de")] * 3000 + other)]
        rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
        language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), sample=40)
        assert taught == {"de": 40, "en": 40, "fr": len({t for _, t, lang in rows if lang == "fr"})}


def test_a_table_of_copies_is_learned(spark, monkeypatch):
    taught = _taught(monkeypatch)
    for text in ("first", "second", "third", "fourth"):
        docs = spark.range(5000).selectExpr("id as doc_id", f"'{text}' as text", "'en' as lang")
        assert language_id.learn(docs) is not None and taught == {"en": 1}


def test_quality_of_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op6_line_crf"](spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_marginals_are_sums_over_all_labelings():
    rng = np.random.default_rng(5)
    counts = np.array([3, 1, 4])
    x, field = rng.normal(size=(8, 30)), crf_quality.LineField(rng.normal(size=30), rng.normal(size=(2, 2)))
    got, at = field.marginals(x, counts), 0
    for n in counts:
        unary, total, good = x[at : at + n] @ field.weights, 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(unary[k] * y[k] for k in range(n)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_line_features_of_a_small_text():
    x, weight, counts = crf_quality.line_features([b"Abc abc abc\nAbc abc abc\n\nA|b !!", b""])
    assert counts.tolist() == [4, 1] and weight.tolist() == [12, 12, 1, 7, 1]
    own = x[:, : crf_quality.OWN]
    assert np.allclose(own[:, 6], [1 / 3, 1 / 3, 0, 0, 0]) and own[:, 7].tolist() == [0, 1, 0, 0, 0] and own[3, 5] == 1
    assert (x[4, crf_quality.OWN :] == 0).all() and x[1, crf_quality.OWN] == 1


def test_paired_tables_give_the_same_responses():
    net, rng = language_id.ByteNet(["a", "b"]), np.random.default_rng(0)
    windows, counts = language_id.cut([rng.integers(32, 255, n, dtype=np.uint8).tobytes() for n in (1, 255, 256, 257, 1000)], 256)
    assert counts.tolist() == [1, 1, 1, 2, 4] and windows.shape[1] == 259
    want = net.log_odds(net.responses(windows))
    assert np.allclose(language_id._whole(net, net.paired(), windows, rows=3), want, atol=1e-4)


def test_windows_run_on_into_what_follows():
    text = bytes(range(65, 91)) * 20
    windows, counts = language_id.cut([text, b"zz"], 256)
    assert bytes(windows[0]) == text[:259] and bytes(windows[counts[0]]) == b"zz" + b" " * 257


def test_long_and_repeated_documents_teach_a_bounded_number_of_lines(spark):
    at, kept = crf_quality.spread_lines(np.array([3, 0, 1000, 256]))
    assert kept.tolist() == [3, 0, 256, 256] and at[:3].tolist() == [0, 1, 2] and at[3] == 3 and at[258] == 1002 and len(set(at.tolist())) == len(at)
    good = "\n".join(f"this is a plain line of words number {i}" for i in range(40))
    bad = "\n".join("$$$ BUY NOW !!! $$$ ||| ***" for _ in range(40))
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(1, bad), (1, good), (None, bad)]
    labels = [(i, i % 2) for i in range(40)] + [(1, 0), (1, 1), (2, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = crf_quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    again = crf_quality.learn(docs.repartition(3), spark.createDataFrame(labels[::-1], "doc_id long, quality int"))
    assert np.allclose(field.weights, again.weights, atol=1e-6)
    assert field.scores([good.encode()])[0] > 0.5 > field.scores([bad.encode()])[0]
