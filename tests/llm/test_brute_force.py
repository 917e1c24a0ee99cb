"""Each operator against a plain statement of its rule on small fixtures."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from cadenza.llm import bloom_lookup, decontaminate, lsh_forest, packing, personal_data, substrings, tool_calls, warc

DOCS = "doc_id long, text string"


def random_texts(seed, n=80, words=12, longest=120):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        w = [f"w{rnd.randrange(words)}" for _ in range(rnd.choice([0, 1, 4, 9, 19, 20, 21, 40, longest]))]
        if out and rnd.random() < 0.5:
            source = rnd.choice(out).split()
            a = rnd.randrange(len(source) + 1)
            k = rnd.randrange(len(w) + 1)
            w[k:k] = source[a : a + rnd.randrange(60)]
        out.append(" ".join(w))
    return out


# packing


def test_tokens_are_those_of_the_whole_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.tokenizer(path)
    texts = ["", "it's O'Neil <|endoftext|> a<|ENDOFTEXT|>b", "ΣΑΣ İst ẞ é x y\x85z \x1cq\x00", "1234 ½ ª \t\nx", "日本語 text😀!!", "L'école DON'T 'S", "a" * 3000]
    for text, ids in zip(texts * 2, own.ids(texts * 2)):
        assert own.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_another_vocabulary_goes_through_its_own_tokenizer():
    own = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.cuts and packing.tokenizer(public_tokenizers.path("word_bpe_49k.json")).cuts
    texts = ["", "It's O'Neil  and\n\ntwo lines", "日本語 é 12"]
    assert [i.tolist() for i in own.ids(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_of_pieces_is_bounded():
    own = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"), kept=20_000)
    texts = [" ".join(f"w{a}x{b}" for b in range(30)) for a in range(40)]
    assert [i.tolist() for t in texts for i in own.ids([t])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.held < 40_000


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 64), packing.Limits(64, 8, 20), packing.Limits(128, 256, 128)])
def test_packing_round_trip_and_limits(spark, limits):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = random_texts(1)
    rows = [(i, t, "ask this") for i, t in enumerate(texts)]
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS + ", prompt string"), path, limits, prompt_col="prompt").collect()
    tok = packing.tokenizer(path).tokenizer
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        mine = sorted(pieces[i], key=lambda r: r.start)
        prompt = tok.encode("ask this", add_special_tokens=False).ids
        want = prompt + tok.encode(text, add_special_tokens=False).ids + [1]
        got = np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist()
        assert got == want and all(r.doc_tokens == len(want) for r in mine)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
        assert sum(r.loss_tokens for r in mine) == len(want) - len(prompt)
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rows)
        assert [r.offset for r in rows] == list(np.cumsum([0] + [r.length for r in rows])[:-1])
        assert total <= limits.tokens and len(rows) <= limits.segments and sum(r.loss_tokens for r in rows) <= limits.loss
        padding += 0 if total & (total - 1) == 0 else limits.tokens - total
    assert padding == 0
    digest = packing.digest(spark.createDataFrame(out)).first()
    assert digest.ids_crc32 == zlib.crc32(bytes(out[0].ids))


# substrings


def plain_repeats(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("words", [2, 3, 300])
def test_repeated_windows(spark, words):
    docs = list(enumerate(random_texts(words, words=words))) + [(900, "a " * 70), (901, "a " * 25), (902, "x y \x1c " * 30)]
    got = substrings.remove_repeats(spark.createDataFrame(docs, DOCS), batch_bytes=2500, task_names=500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == plain_repeats(docs)


# decontamination


def plain_hits(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = split(text), set(), set()
    for name, item in items:
        x = split(item)
        k = min(n, len(x))
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
        for p in range(len(w) - k + 1) if windows else ():
            if tuple(w[p : p + k]) in windows:
                hit.update(range(p, p + k))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [150, 10**6])
def test_suffix_automaton_hits(spark, block):
    texts = random_texts(5, words=6, longest=60)
    items = [(k, t) for k, t in enumerate(random_texts(6, n=12, words=6, longest=30))] + [(50, "W1 w2"), (51, None), (52, "Éa, w3"), (53, "zz"), (50, "w5 w5 w5")]
    texts += ["w1-W2!w4", "éa w3", "Éa W3", "zz", "w0 " * 60]
    got = decontaminate.find_contamination(
        spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(items, "item_id long, text string"), block_chars=block
    ).withColumn("hit", decontaminate.hit_words()).collect()
    for r in got:
        assert (r.n_words, r.hit, r["items"]) == plain_hits(texts[r.doc_id], items)


def test_spans_are_cut_and_mostly_hit_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "Before, ONE two  three four five six seven eight nine ten! after " + "x " * 20, 7), (2, item, 8), (3, "clean é", 9), (4, None, 1)]
    got = decontaminate.clean(spark.createDataFrame(docs, DOCS + ", spans int"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.text, r.spans) for r in got.collect() if r.text) == [(1, "Before, ! after " + "x " * 20, 7), (3, "clean é", 9)]
    assert got.where("text is null").count() == 1


# n-gram join


def plain_groups(docs):
    sets = {}
    for i, t in docs:
        w = [x.decode() for x in decontaminate.words((t or "").encode())]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    link = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(link[i]))
    return out


@pytest.mark.parametrize("block", [4, 1000])
def test_near_duplicates(spark, block):
    rnd, docs = random.Random(8), []
    for i in range(25):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([2, 6, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(99)}"
            docs.append((len(docs), rnd.choice([" ", ", "]).join(copy).upper() if rnd.random() < 0.3 else " ".join(copy)))
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, DOCS), block=block, group_block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == plain_groups(docs)


def test_prefixes_shrink_to_the_target_recall():
    assert lsh_forest.prefix_depth(0.8, 16, 8, 0.9999) == 3
    assert lsh_forest.prefix_depth(0.8, 16, 8, 0.5) > lsh_forest.prefix_depth(0.8, 16, 8, 0.99) >= 3
    assert lsh_forest.prefix_depth(0.8, 2, 8, 1.0) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([k])) for k in range(101, 120)] + [(bytes([7]), bytes([7]))]
    got = dict(lsh_forest.components(spark.createDataFrame(edges, "a binary, b binary")).collect())
    assert {bytes(k)[0]: bytes(v)[0] for k, v in got.items()} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 120)}}


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            double = lambda x: x - 9 if x > 9 else x
            luhn = sum(int(c) if i % 2 == 0 else double(2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0
            keep = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if keep[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rnd = random.Random(3)
    parts = ["a", "B", "@", ".", "1", "2", "007", "55", "300", "-", " ", "+", "(", ")", "_", "é", "😀", "\n", "4111111111111111", "x@y.z", "1.2.3.4", "+1 555", "a@b.com_x@d.e"]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(50)))) for i in range(1500)]
    found = personal_data.candidates(spark.createDataFrame(docs, DOCS)).select("doc_id", personal_data.joined(personal_data.F.col("base")).alias("b"))
    for r in found.collect():
        assert r.b == ",".join(plain_spans(docs[r.doc_id][1]))


def test_hostile_texts_end(spark):
    docs = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 50_000), (4, "a." * 50_000 + "@"), (5, "+1" * 50_000)]
    assert personal_data.candidates(spark.createDataFrame(docs, DOCS)).where("size(base) > 0").count() == 0


def test_added_spans_and_masks(spark):
    docs = [(k, f"please call +1 (743) 555-{1000 + k} or mail joe{k}@mail.com; host 10.0.0.{k}") for k in range(40)]
    docs += [(100, "call me by phone at 743 555-3824 or mail joe [at] mail.com"), (101, "no data here"), (102, "order 743 555-3824x")]
    found = personal_data.find(spark.createDataFrame(docs, DOCS)).select("doc_id", personal_data.joined(personal_data.F.col("spans")).alias("s"))
    got = {r.doc_id: r.s for r in found.collect()}
    assert got[100] == "email:41:58,phone:20:32" and got[101] == got[102] == ""
    masked = {r.doc_id: r.text for r in personal_data.mask(spark.createDataFrame(docs, DOCS)).collect()}
    assert masked[7] == "please call <phone> or mail <email>; host <ip>" and masked[101] == "no data here"


def test_labelers_that_agree_are_trusted():
    patterns = [((1, 1, 1, 1), 60), ((0, 0, -1, 1), 30), ((1, 1, -1, 1), 40), ((0, 1, 0, 0), 20)]
    model, p = personal_data.estimate(patterns)
    assert p[0] > 0.99 and p[2] > 0.9 and p[1] < 0.5 and p[3] < 0.5 and model["right"][0][1] > 0.8


# fingerprints


def test_sketch_gives_back_differences():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 5, 40, 400):
        shared, a, b = (rnd.integers(0, 2**63, k, dtype=np.uint64) for k in (500, n, n // 2))
        keys = np.concatenate([shared, a, shared, b])
        sign = np.repeat([1, -1], [500 + n, 500 + n // 2])
        cells = bloom_lookup.CELLS
        while True:
            done, _, found, way = bloom_lookup.peel(bloom_lookup.sketch(keys, np.zeros(len(keys), np.int64), 1, cells, sign))
            if done[0]:
                break
            cells *= bloom_lookup.GROWTH
        assert set(found[way == 1]) == set(a) and set(found[way == -1]) == set(b) and cells <= 24 * 4**4


def test_fingerprints_against_plain_sets(spark):
    texts = ["\n".join(t[k : k + 60] for k in range(0, len(t), 60)) for t in random_texts(4, n=40)]
    texts[5], texts[9] = "é😀 " * 7 + "\n\nx\nx\nx", texts[8]
    got = {r.doc_id: r for r in bloom_lookup.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}

    def alike(a, b):
        a, b = (set(bloom_lookup.paragraph_keys([t.encode()])[0].tolist()) for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, after))
    assert got[8].fingerprint == got[9].fingerprint and got[8].near_next == 1.0
    cells = bloom_lookup.decode([got[8].fingerprint, got[10].fingerprint])
    assert cells.shape == (2, bloom_lookup.CELLS) and base64.b64encode(cells[0].tobytes()).decode() == got[8].fingerprint


# WARC


def test_derivatives_round_trip(spark):
    page = (
        '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var x="<p>no</p>";</script></head><body><nav><a href="/x?a=1&amp;b=2">go</a></nav>'
        "<!-- hidden --><p>One<br>two &eacute; &#x41;</p><style>p{}</style><div>  three   <b>four</b></div><p>5 < 6</body></html>"
    )
    pages = [(1, "http://h.example/d/", page), (2, None, None), (3, "bad[url", "<script>never closed"), (1, "http://h.example/d/", page)]
    out = warc.build_derivatives(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(out) == 8
    by = {(r.id, r.warc_type): r for r in out}
    conversion, metadata = by[1, "conversion"], by[1, "metadata"]
    assert conversion.content == "go\nOne\ntwo é A\nthree four\n5 < 6"
    assert "title: A & B\r\n" in metadata.content and "outlink: http://h.example/x?a=1&b=2\r\n" in metadata.content and "language: fr" in metadata.content
    assert metadata.content.startswith(f"source-payload-digest: {conversion.source_digest}\r\nsource-content-type: text/html; charset=utf-8\r\n")
    for r in out:
        headers, block = warc.parse(bytes(r.record))
        h = dict(headers)
        assert block.decode() == r.content and h["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert h["WARC-Refers-To"] == r.refers_to and h["WARC-Record-ID"] == r.record_id and h.get("WARC-Target-URI") == r.target_uri
    assert conversion.concurrent_to == metadata.record_id and metadata.concurrent_to == conversion.record_id and conversion.refers_to == metadata.refers_to
    assert by[3, "conversion"].content == by[2, "conversion"].content == ""
    assert warc.digest(b"") == "sha1:" + base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert warc.plain_text("<script" * 50_000) == "" and warc.plain_text("<" * 100_000)


# tool calls


def test_calls_links_and_canonical_json(spark):
    schemas = {"get": {"n": ("integer", True), "deep": ("object", False)}, "put": {}}
    calls = [
        (1, "a", "get", '{"n": 1, "deep": {"z": [1, 2.50], "b": null}}', ["b", "c"], 0), (1, "b", "get", '{"n": "1"}', ["c"], 1), (1, "c", "put", "{}", None, 2),
        (1, "d", "put", "{}", ["e"], 3), (1, "e", "put", "{}", ["d"], 4), (1, "f", "what", "[]", ["gone", None], 5), (1, "c", "put", '{"x":1}', None, 9),
        (1, None, "put", None, None, 6), (2, "a", "put", '{"x": 1, "a": 2}', ["d"], 0), (None, "q", None, "{", [], 1),
    ]
    results = [(1, "a", "two", 5), (1, "a", "one", 4), (1, "zz", "lost", 0), (1, None, "nobody", 1), (1, "c", None, 2)]
    out = tool_calls.link_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, depends_on array<string>, position long"),
        spark.createDataFrame(results, "conv_id long, call_id string, content string, position long"), schemas,
    ).collect()
    got = {(r.conv_id, r.call_id, r.status == "orphan"): r for r in out}
    assert len(out) == 11
    pick = lambda c, i: (got[c, i, False].level, got[c, i, False].status, got[c, i, False].errors, got[c, i, False].n_results)
    assert pick(1, "a") == (2, "ok", "", 2) and pick(1, "b") == (1, "invalid", "n is not integer", 0) and pick(1, "c") == (0, "invalid", "repeated id", 1)
    assert pick(1, "d") == (None, "cycle", "", 0) and pick(1, "f") == (0, "invalid", "malformed arguments;unknown dependency", 0)
    assert pick(1, None)[1:] == ("invalid", "malformed arguments;no id", 0) and pick(2, "a") == (0, "invalid", "unknown a;unknown dependency;unknown x", 0)
    assert got[1, "zz", True].json == '{"call_id":"zz","result":"lost"}' and got[1, None, True].status == "orphan"
    text = got[1, "a", False].json
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")) and json.loads(text)["result"] == "one"
    assert Counter(r.status for r in out)["cycle"] == 2
