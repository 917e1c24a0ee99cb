"""The whole pipeline on planted texts against a plain version of its rules."""

import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from cadenza.llm import crf_quality, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def planted():
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdkmprst" for b in "aeiou" for c in ("n", "l", "ra", "mi")]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    page = lambda: "\n".join(prose(12).capitalize() + "." for _ in range(8))
    texts = [page() for _ in range(60)]
    junk = ["\n".join("$$$ BUY NOW !!! *** CLICK ||| $$$ %%%" for _ in range(6 + i % 5)) + f"\n$$$ {i} !!!" for i in range(40)]
    item = prose(30)
    copies = [texts[0], texts[1].replace(".", " !", 1), texts[2] + " bara"]
    leaks = [texts[5] + "\n" + item + "\n" + texts[6], item + " " + prose(4)]
    mails = [f"{page()}\nwrite to some.body{i}@example.com today" for i in range(6)]
    every = texts + junk + copies + leaks + mails + [None, "", "a"]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(every)]
    return rows, item


def plain(rows, item, field):
    """(id, text) of what is left before packing."""
    kept = [(i, t or "") for i, t, *_ in rows if field.scores([(t or "").encode()])[0] >= crf_quality.CUT]
    shingles = {}
    for i, t in kept:
        w = words(t)
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in shingles}
    for a in shingles:  # small enough for all pairs
        for b in shingles:
            if a < b and shingles[a] and shingles[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    out = []
    windows = {tuple(words(item)[k : k + 10]) for k in range(len(words(item)) - 9)}
    for i, t in kept:
        if group[i] != i:
            continue
        low = "".join(c.lower() if c.isascii() else c for c in t)
        spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
        hit = [False] * len(spots)
        for k in range(len(spots) - 9):
            if tuple(low[a:b] for a, b in spots[k : k + 10]) in windows:
                hit[k : k + 10] = [True] * 10
        if sum(hit) > 0.5 * len(hit):
            continue
        text, done, k = "", 0, 0
        while k < len(hit):
            if hit[k]:
                e = k
                while e + 1 < len(hit) and hit[e + 1]:
                    e += 1
                text, done, k = text + t[done : spots[k][0]], spots[e][1], e
            k += 1
        text += t[done:]
        out.append((i, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", text)))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("corpus")


def test_pipeline_against_plain_rules(spark, folder, monkeypatch):
    rows, item = planted()
    docs = spark.createDataFrame(rows, DOCS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    taught = {}
    learn = crf_quality.learn
    monkeypatch.setattr(crf_quality, "learn", lambda *a, **k: taught.setdefault("field", learn(*a, **k)))

    got = corpus_pipeline.run(spark, str(folder)).collect()
    want = plain(rows, item, taught["field"])
    ids = {i for i, _ in want}
    assert not ids & set(range(60, 100)) and not ids & {100, 101, 102} and 104 not in ids and {0, 1, 2, 103} <= ids
    assert "@" not in dict(want)[105] and item not in dict(want)[103]

    tokenizer = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == ids
    for i, text in want:
        tokens = tokenizer.encode(text, add_special_tokens=False).ids + [packing.END]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = b"".join(t.to_bytes(4, "little") for t in tokens[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(tokens), zlib.crc32(own))
            at += r.length
        assert at == len(tokens)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    for name, ddl in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{folder}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/empty").collect() == []
    rows = [(1, "plain words here", "xx", "s", 16, "k"), (1, "plain words here", "xx", "s", 16, "k"), (None, None, None, None, None, None), (2, "", "", "", 0, "k"), (3, "tie " * 9000, "xx", "s", 1, "k")]
    docs = spark.createDataFrame(rows, DOCS + ", keep_0 string")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, f"{folder}/empty")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_0"]
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 2, 3]
