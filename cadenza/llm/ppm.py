"""Scores of texts by prediction by partial matching over bytes, beside a smoothed unigram model of words.

The trie of all byte contexts up to ``ORDER`` bytes is a table with a row for each node: the context, its totals and
the counts of the bytes that follow. Tasks count the grams (context of full length, next symbol) of batches of
documents; Spark adds the counts up and the shorter contexts follow from them. A symbol that a context has not seen
is coded by an escape of probability kinds / (2 * total), a seen one by (2 * count - 1) / (2 * total), and the
symbols of the longer context are excluded from the next shorter one. The cost of a symbol depends on its gram
alone, so it is worked out once for each distinct gram and sent to the batches that asked for it, as are counts of
words. Nothing of the size of the vocabulary is broadcast or collected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, give_back, plain, slices, stage, stage_buckets

#: Bytes of context; at most 5, so that a gram fits into 64 bits.
ORDER = 5
#: The end of a text is a symbol after the 256 bytes. Before its start a text has NUL bytes as context.
END, SYMBOLS = 256, 257
_BITS = 9
FOLD = 10
#: Text bytes of a batch, and of the stretch of it that is worked on at a time.
BATCH_BYTES, STRETCH = 24 << 20, 1 << 19
#: Added to the count of each word of the unigram model.
ADDED = 0.1

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _batches(rows: DataFrame, limit: int) -> DataFrame:
    """(batch, ids, sizes, learns, body): neighbouring documents, A-Z lower-cased and compressed, of about ``limit`` bytes."""
    ddl = f"batch bigint, ids array<{rows.schema['id'].dataType.simpleString()}>, sizes array<bigint>, learns array<boolean>, body binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = [], [], []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal number, size
            body = pa.compress(b"".join(held[1]), "zstd", asbytes=True)
            columns = [[number], [held[0]], [[len(t) for t in held[1]]], [held[2]], [body]]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            for part in held:
                part.clear()
            number, size = number + 1, 0
            return out

        for part in slices(batches):
            for key, text, learns in zip(*(part.column(c).to_pylist() for c in ("id", "text", "learns"))):
                body = (text or b"").lower()
                if size and size + len(body) > limit:
                    yield row()
                held[0].append(key), held[1].append(body), held[2].append(learns)
                size += len(body) + 64
        if held[0]:
            yield row()

    return rows.mapInArrow(run, ddl)


def _texts(sizes: list[int], body: bytes) -> Iterator[bytes]:
    text = pa.decompress(body, sum(sizes), "zstd", asbytes=True)
    at = 0
    for size in sizes:
        yield text[at : at + size]
        at += size


def _grams(texts: Iterator[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each symbol, its gram), about ``STRETCH`` symbols at a time; long texts come in several stretches."""
    parts: list[np.ndarray] = []
    owner: list[tuple[int, int]] = []
    size = 0

    def cut() -> tuple[np.ndarray, np.ndarray]:
        raw = np.concatenate(parts)
        gram = np.zeros(len(raw) - order, np.int64)
        for k in range(order):
            gram |= raw[k : k + len(gram)] << (8 * (order - 1 - k) + _BITS)
        gram |= raw[order:]
        of = np.repeat(np.array([i for i, _ in owner]), [n for _, n in owner])
        real = np.ones(len(raw), bool)
        real[np.concatenate([[0], np.cumsum([n + order for _, n in owner])[:-1]])[:, None] + np.arange(order)] = False
        return of, gram[real[order:]]

    for i, text in enumerate(texts):
        before = np.zeros(order, np.int64)
        for at in range(0, len(text) + 1, STRETCH):
            piece = np.frombuffer(text, np.uint8)[at : at + STRETCH].astype(np.int64)
            if at + STRETCH > len(text):
                piece = np.append(piece, END)
            parts += [before, piece]
            owner.append((i, len(piece)))
            before = np.concatenate([before, piece])[-order:] if order else before
            size += len(piece)
            if size >= STRETCH:
                yield cut()
                parts, owner, size = [], [], 0
    if owner:
        yield cut()


def _stretches(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(text of each stretch, the stretch): long texts are cut after white space."""
    of, out = [], []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > STRETCH and (end := _SPACE.search(text, at + STRETCH)):
            of.append(i), out.append(text[at : end.end()])
            at = end.end()
        of.append(i), out.append(text[at:])
    return of, out


class _Words:
    """Codes of the tokens of a batch, some stretches at a time; ``known`` has the distinct words in order of appearance.

    The end of a text is the empty word, code 0.
    """

    def __init__(self) -> None:
        self.known = pa.array([b""], pa.binary())

    def codes(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(code of each token, its text); the ends come last."""
        import pyarrow.compute as pc

        of, parts = _stretches(texts)
        ends = np.cumsum([len(p) for p in parts])
        first = 0
        while first < len(parts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 4 * STRETCH, "right")))
            split = pc.ascii_split_whitespace(pa.array(parts[first:last], pa.binary()).cast(pa.string()))
            owner = np.repeat(np.array(of[first:last], np.int32), pc.list_value_length(split).to_numpy())
            chunk = split.flatten().cast(pa.binary()).dictionary_encode()
            place = pc.index_in(chunk.dictionary, self.known)
            new = chunk.dictionary.filter(place.is_null())
            to = place.to_numpy(zero_copy_only=False).astype(float)
            to[np.isnan(to)] = len(self.known) + np.arange(len(new))
            if len(new):
                self.known = pa.concat_arrays([self.known, new])
            code = to.astype(np.int32)[chunk.indices.to_numpy()]
            yield code[code > 0], owner[code > 0]
            first = last
        yield np.zeros(len(texts), np.int32), np.arange(len(texts), dtype=np.int32)


def _word_counts(texts: list[bytes], learns: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a batch, and how often they occur in learning texts."""
    words, n = _Words(), np.zeros(0, np.int64)
    for code, owner in words.codes(texts):
        more = np.bincount(code[learns[owner]], minlength=len(words.known))
        more[: len(n)] += n
        n = more
    return words.known, n


def _ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            words, n = _word_counts(list(_texts(x["sizes"], x["body"])), np.array(x["learns"], bool))
            for k in range(0, len(words), 100_000):
                part = words[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), x["batch"])), pa.array(np.arange(k, k + len(part))), part, pa.array(n[k : k + len(part)])],
                    names=["batch", "key", "word", "n"],
                )


def _distinct_grams(x: dict, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a batch in order, and how often they occur in learning texts."""
    found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    learns = np.array(x["learns"])
    waiting, size = [found], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        gram, to = np.unique(np.concatenate([g for g, _ in waiting]), return_inverse=True)
        return gram, np.bincount(to, np.concatenate([n for _, n in waiting]), len(gram)).astype(np.int64)

    for of, gram in _grams(_texts(x["sizes"], x["body"]), order):
        own = learns[of]
        for part, counted in ((gram[own], 1), (gram[~own], 0)):
            if len(part):
                value, n = np.unique(part, return_counts=True)
                waiting.append((value, n * counted))
                size += len(value)
        if size > 2 << 20:
            waiting, size = [merged()], 0
    return merged()


def _ask_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                gram, n = _distinct_grams(x, order)
                for k in range(0, len(gram), 100_000):
                    part = gram[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x["batch"])), pa.array(part), pa.array(n[k : k + len(part)])], names=["batch", "gram", "n"])
                give_back()

    return run


class _Lookup:
    """Values of 64-bit keys by open addressing, many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._place(keys[left], step)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, step = left[~won], step + 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, all of which are there."""
        at = self._place(keys, 0)
        out = self.values[at]
        left, step = np.flatnonzero(self.keys[at] != keys), 1
        while len(left):
            at = self._place(keys[left], step)
            out[left] = self.values[at]
            left, step = left[self.keys[at] != keys[left]], step + 1
        return out


def trie(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(depth, context, total, kinds, covered, following): a row for each node, from (gram, n) of full length.

    ``following`` maps a symbol to its count. ``covered`` is what the symbols of the node count for in the node of the
    context without its first byte: they are excluded there after an escape.
    """
    context, symbol = F.shiftright("gram", _BITS), F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    seen = counts.where("n > 0").select(context.alias("context"), symbol.alias("symbol"), "n")
    suffix = lambda k: F.col("context").bitwiseAND(F.lit((1 << (8 * k)) - 1))
    levels = [seen.select(F.lit(order).alias("depth"), "context", "symbol", "n")]
    for k in range(order - 1, -1, -1):
        levels.append(levels[-1].groupBy(suffix(k).alias("context"), "symbol").agg(F.sum("n").alias("n")).select(F.lit(k).alias("depth"), "context", "symbol", "n"))
    arcs = levels[0]
    for level in levels[1:]:
        arcs = arcs.unionByName(level)
    arcs = stage(arcs, "trie-arcs")
    mask = F.expr("cast(shiftleft(1L, 8 * (depth - 1)) - 1 as bigint)")
    above = arcs.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "symbol", F.col("n").alias("shorter"))
    both = arcs.withColumn("suffix", F.when(F.col("depth") > 0, F.col("context").bitwiseAND(mask))).join(above, ["depth", "suffix", "symbol"], "left")
    nodes = both.groupBy("depth", "context").agg(
        F.sum("n").alias("total"), F.count("*").cast("int").alias("kinds"), F.sum("shorter").alias("covered"),
        F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("following"),
    )
    return stage(nodes, "trie-nodes")


def gram_costs(asked: DataFrame, nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, cost) of distinct grams: log10 of the probability of the symbol after its context."""
    context, symbol = F.shiftright("gram", _BITS), F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    now = asked.select("gram", context.alias("context"), symbol.alias("symbol"))
    for k in range(order, -1, -1):
        level = nodes.where(F.col("depth") == k).select(F.col("context").alias(f"c{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("total", "kinds", "covered", "following")))
        # Nodes of at most one byte are 257, of at most 257 symbols each.
        now = now.withColumn(f"c{k}", F.col("context").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(F.broadcast(level) if k < 2 else level, f"c{k}", "left")
        now = now.withColumn(f"n{k}", F.try_element_at(f"following{k}", F.col("symbol"))).drop(f"c{k}", f"following{k}")

    def log_share(part: Column, whole: Column) -> Column:
        return F.log10(part / (2 * whole))

    cost = -F.log10(SYMBOLS - F.coalesce("kinds0", F.lit(0)))
    for k in range(order + 1):
        if k < order:
            total, kinds = F.col(f"total{k}") - F.coalesce(f"covered{k + 1}", F.lit(0)), F.col(f"kinds{k}") - F.coalesce(f"kinds{k + 1}", F.lit(0))
        else:
            total, kinds = F.col(f"total{k}"), F.col(f"kinds{k}")
        passed = F.when(kinds > 0, log_share(kinds, total)).otherwise(0.0)
        cost = F.when(F.col(f"n{k}").isNotNull(), log_share(2 * F.col(f"n{k}") - 1, total)).otherwise(passed + cost)
    return now.select("gram", cost.alias("cost"))


def _score(order: int, size: float, ddl: str):
    """Adds up the answers over each text; ``size`` is the smoothed number of tokens."""
    schema = arrow_schema(ddl)

    def run(_: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        key, value = answers.column("key").to_numpy(), answers.column("value").to_numpy()
        gram = value < 0
        cost = _Lookup(key[gram], value[gram])
        count = np.zeros(int((~gram).sum()))
        count[key[~gram]] = value[~gram]
        log, seen = np.log10((count + ADDED) / size), (count > 0).astype(float)
        del key, value, gram, count
        out = []
        for x in texts.to_pylist():
            every = list(_texts(x["sizes"], x["body"]))
            n, known, sums, total = (np.zeros(len(every)) for _ in range(4))
            for code, owner in _Words().codes(every):
                n += np.bincount(owner, minlength=len(every))
                known += np.bincount(owner, seen[code], len(every))
                sums += np.bincount(owner, log[code], len(every))
            for owner, grams in _grams(iter(every), order):
                total += np.bincount(owner, cost[grams], len(every))
            out.append(pa.Table.from_arrays(
                [pa.array(x["ids"], schema[0].type), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(total)],
                schema=schema,
            ))
        del cost, log, seen, answers, texts
        give_back()
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, learns: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from the rows where ``learns``.

    Texts are their UTF-8 bytes with A-Z lower-cased. Tokens are runs without ASCII white space, and one end. The
    base is the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens: c is a token's count, N the number of
    all, V of distinct tokens in learning texts; n_known counts tokens with c > 0. ``score`` is the log10
    probability of the bytes and the end; a symbol that the trie has never seen shares what is left evenly with the
    others. A null text is an empty one, and ``learns`` that is null is false. Rows that repeat an id or a text are
    texts of their own. Without learning rows every symbol has probability 1/257; an empty table gives no rows.
    """
    if not 0 <= order <= 5:
        raise ValueError("order must be 0 to 5")
    rows = plain(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns")), "id", "text", learns="learns")
    id_type = rows.schema["id"].dataType.simpleString()
    buckets = max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = stage_buckets(_batches(rows, batch_bytes), "ppm-texts", "batch", buckets)

    def added_up(asked: DataFrame, key: str) -> DataFrame:
        """Counts over all batches beside each batch's own row; one row of each key is its first. One shuffle."""
        same = Window.partitionBy(key)
        return asked.withColumns({"n": F.sum("n").over(same), "first": F.min("batch").over(same) == F.col("batch")})

    asked = texts.mapInArrow(_ask_words, "batch bigint, key bigint, word binary, n bigint")
    words = stage(added_up(asked, "word").drop("word"), "ppm-words")
    found = words.where("first and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()

    asked = texts.mapInArrow(_ask_grams(order), "batch bigint, gram bigint, n bigint")
    grams = stage_buckets(added_up(asked.repartition(buckets, "gram"), "gram"), "ppm-grams", "gram", buckets)
    counts = grams.where("first").select("gram", "n")
    costs = gram_costs(counts, trie(counts, order), order)

    # A count of a word is not negative, the cost of a gram is.
    answers = words.select("batch", "key", F.col("n").cast("double").alias("value")).unionByName(
        grams.select("batch", "gram").join(costs, "gram").select("batch", F.col("gram").alias("key"), F.col("cost").alias("value"))
    )
    ddl = f"doc_id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double"
    size = found["tokens"] + ADDED * (found["distinct"] + 1)
    scored = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(order, size, ddl), ddl)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(found["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def adaptive_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, score): log10 probability of each text by a trie that starts empty and learns the text as it goes.

    Same escapes, exclusions and normalisation as ``score``; memory grows with one text. Nothing is shuffled.
    """
    rows = plain(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), "id", "text")
    ddl = f"doc_id {rows.schema['id'].dataType.simpleString()}, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = [_adaptive((t or b"").lower(), order) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], schema=schema)

    return rows.mapInArrow(run, ddl)


def _adaptive(text: bytes, order: int) -> float:
    nodes: dict[bytes, Counter] = {}
    text, total = bytes(order) + text, 0.0
    for at in range(order, len(text) + 1):
        symbol = text[at] if at < len(text) else END
        excluded: Counter = Counter()
        for k in range(order, -1, -1):
            node = nodes.setdefault(text[at - k : at], Counter())
            if len(node) > len(excluded):
                mass = node.total() - sum(node[s] for s in excluded)
                if symbol in node:
                    total += math.log10((2 * node[symbol] - 1) / (2 * mass))
                    break
                total += math.log10((len(node) - len(excluded)) / (2 * mass))
            excluded = node
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for k in range(order + 1):
            nodes.setdefault(text[at - k : at], Counter())[symbol] += 1
    return total
