"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from cadenza.llm import bloom_lookup, crf_quality, decontaminate, language_id, lsh_forest, packing, personal_data, queries, substrings, tool_calls, warc

LONG = "word " * 60_000 + "x" * 50_000
ROWS = [
    (1, "hello there my good friend of old\nsecond line 10.0.0.1", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, LONG, "en", "s"),
    (5, "hello there my good friend of old\nsecond line 10.0.0.1", "en", None), (5, "hello there my good friend of old\nsecond line 10.0.0.1", "en", None),
    (None, "a text without an id", "de", "s"), (6, "12 34 !!", None, "s"), (7, "   \x00", "en", "s"), (5, "another text with the same id", "de", "s"),
]
NAMES = "doc_id long, text string, lang string, id string"
CLASH = ["key", "node", "bucket", "label", "n", "spans", "base", "prefix", "batch", "own", "pair", "tail", "n_words"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, NAMES)
    return df.withColumns({c: df["id"] for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


ITEMS = [(1, "hello there my good friend of old second line 10"), (None, "never"), (2, None), (3, "")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def jobs(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    field = crf_quality.LineField(np.zeros(30), np.zeros((2, 2)))
    net = language_id.ByteNet(["de", "en"])
    return {
        "language": (lambda d: language_id.predict(d, net), 1), "pack": (lambda d: packing.pack_documents(d, path), None), "substrings": (substrings.remove_repeats, 1),
        "contamination": (lambda d: decontaminate.find_contamination(d, items(spark)), 1), "quality": (lambda d: crf_quality.score(d, field), 1),
        "personal": (personal_data.find, 1), "near": (lsh_forest.near_duplicates, 1), "fingerprint": (bloom_lookup.edited_fingerprints, 1),
    }


@pytest.mark.parametrize("name", ["language", "pack", "substrings", "contamination", "quality", "personal", "near", "fingerprint"])
def test_every_row_has_its_result_and_empty_tables_none(spark, edge, empty, name):
    job, per_row = jobs(spark)[name]
    assert job(empty).count() == 0
    ids = [r["doc_id"] for r in job(edge).collect()]
    want = [r[0] for r in ROWS]
    if per_row:
        assert sorted(ids, key=str) == sorted(want, key=str)
    else:
        assert set(ids) == set(want)


def test_defined_results_of_edge_rows(spark, edge):
    by = lambda df: {r["doc_id"]: r for r in df.collect() if r["doc_id"] != 5}
    lang = by(language_id.predict(edge, language_id.ByteNet(["de", "en"])))
    assert [lang[k].lang_pred for k in (2, 3, 6, 7)] == ["und"] * 4 and lang[1].lang_pred in ("de", "en") and lang[2].score == 0
    assert language_id.predict(edge, None).where("lang_pred <> 'und'").count() == 0
    near = by(lsh_forest.near_duplicates(edge))
    assert (near[1].class_id, near[1].n_links) == (1, 2) and (near[2].class_id, near[2].n_links) == (2, 0) and near[3].n_links == 0
    kept = lsh_forest.keep_one(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 7, None]
    found = by(decontaminate.find_contamination(edge, items(spark)))
    assert found[1]["items"] == ["1"] and found[2].n_words == 0 and found[4].n_words == 60_001
    removed = by(substrings.remove_repeats(edge))
    assert removed[4].n_words == 60_001 and removed[4].n_removed > 59_000 and removed[2].kept == ""
    pieces = [r for r in packing.pack_documents(edge, public_tokenizers.path("word_bpe_49k.json")).collect() if r.doc_id in (2, 3)]
    assert [(r.length, r.doc_tokens, bytes(r.ids)) for r in pieces] == [(1, 1, b"\x01\0\0\0")] * 2
    prints = by(bloom_lookup.edited_fingerprints(edge))
    assert prints[2].fingerprint == prints[3].fingerprint and prints[2].n_chars == 0 and prints[2].near_next == 1.0


def test_whole_documents_pass_the_filters(spark, edge, empty):
    for clean in (lambda d: decontaminate.clean(d, items(spark)), personal_data.mask, lsh_forest.keep_one):
        assert clean(edge).columns == edge.columns and clean(empty).count() == 0
    masked = [r.text for r in personal_data.mask(edge).collect() if r.doc_id == 1]
    assert masked == ["hello there my good friend of old\nsecond line <ip>"]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    field = crf_quality.learn(edge, labels)
    assert crf_quality.keep_good(edge, field).columns == edge.columns and crf_quality.keep_good(empty, field).count() == 0
    assert language_id.learn(empty) is None


def test_no_items_no_pages_no_calls(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(edge, none).where("size(spans) > 0").count() == 0
    assert warc.build_derivatives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    calls = spark.createDataFrame([], "conv_id long, call_id string, name string, arguments string, depends_on array<string>, position long")
    assert tool_calls.link_calls(calls, spark.createDataFrame([], "conv_id long, call_id string, content string, position long"), {}).count() == 0


def test_items_without_id_are_hits(spark, tmp_path):
    passage, known = "one two three four five six seven eight nine ten", "a b c d e f g h i j"
    docs = [(1, f"x {passage} y z u v w q r s t p o m"), (2, f"{passage} {known}"), (3, "nothing of it")]
    benchmark = [(None, passage), (None, passage + " more"), (7, known)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(benchmark, "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op5_suffix_automaton"](spark, str(tmp_path)).collect()}
    # As in the SQL: all items without id count as one, and the digest is of the known ids only.
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(got[k].n_hit, got[k].n_items, got[k].items_sha256) for k in (1, 2, 3)] == [(10, 1, digest("")), (20, 2, digest("7")), (0, 0, digest(""))]
    for chars in (600_000, 20):
        texts = {r.doc_id: r.text for r in decontaminate.clean(docs, benchmark, block_chars=chars).collect()}
        assert texts == {1: "x  y z u v w q r s t p o m", 3: "nothing of it"}


def test_one_document_follows_itself(spark):
    r = bloom_lookup.edited_fingerprints(spark.createDataFrame([(1, "abcd\nefgh")], "doc_id long, text string")).first()
    assert r.edited == "abcd\nabcd" and r.near_next == 1.0


def test_personal_data_is_counted_by_kind(spark, tmp_path):
    texts = ["a@b.c d@e.f and g@h.i", "1.2.3.4 or 5.6.7.8", "4111 1111 1111 1111", "+1 (555) 123-4567, x@y.z", "+1.2.3.4567.89", "none", None]
    rows = [(n, t, "en", "s") for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op7_weak_supervision(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found} == {
        0: (3, 0, 0, 0), 1: (0, 2, 0, 0), 2: (0, 0, 1, 0), 3: (1, 0, 0, 1), 4: (0, 0, 0, 1), 5: (0, 0, 0, 0), 6: (0, 0, 0, 0),
    }
    assert {r["base_sha256"] for r in found if r["doc_id"] == 0} == {hashlib.sha256(b"email:0:5,email:6:11,email:16:21").hexdigest()}
