"""Spelling variants by asymmetric q-chunks: pairs of words one edit apart, and the form each variant stands for.

Of a pair the longer word (or either of two equally long ones) contributes two disjoint chunks, its first and its
second half; the other contributes its positional grams of the chunk's size. One edit touches at most one of the
two chunks: the first half is kept in its place, or the second one at a shift that the difference of the lengths
fixes (0, or one to the left). Of all grams only those at such places can join, so only they are sent.

A common half would bring thousands of words together. What the kept chunk leaves of both words is one edit
apart as well, so it is chunked by the same rule, ``LEVELS`` times, and all kept chunks make the key. Candidates
are verified by edit distance. Everything is joins and aggregates; no group is collected but a word's own matches.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import plain, stage

#: Code points of a word at least, and occurrences of one.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Levels of chunks in a key: two leave about a quarter of a word open.
LEVELS = 2

_RUN = "[A-Za-zÀ-ÿ]"


def word_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None
) -> DataFrame:
    """(word, n): maximal runs of letters of all whole texts, A-Z lower-cased, with ``min_length`` code points and ``min_count`` occurrences.

    With ``damage``, a run whose crc32 of ``<id>:<run>`` it divides loses the code point at crc32 mod length first
    (a null id is written as nothing).
    """
    runs = plain(docs, id_col, text_col).select("id", F.explode(F.regexp_extract_all("text", F.lit(f"{_RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select("word", h.alias("h")).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def chunk_keys(word: Column, size: Column, levels: int = LEVELS) -> Column:
    """The keys of ``word`` against words of ``size`` code points: kept chunks of each level, and which half they are.

    ``size`` is the word's own length on the side of the chunks, and that or one more on the side of the grams.
    """
    ways: list[tuple[Column, Column]] = [(size.cast("string"), word)]
    for _ in range(levels):
        half, further = F.floor(size / 2).cast("int"), []
        for key, rest in ways:
            place = half + F.length(rest) - size  # of the second half
            for name, start, left in (
                ("a", F.lit(0), F.substring(rest, half + 1, size)),
                ("b", place, F.concat(F.substring(rest, F.lit(1), place), F.substring(rest, place + half + 1, size))),
            ):
                further.append((F.concat(key, F.lit(f":{name}"), F.substring(rest, start + 1, half)), left))
        ways, size = further, size - half
    return F.array_distinct(F.array(*(key for key, _ in ways)))


def near_words(words: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """(a, b, n_a, n_b): each pair of different words one edit apart, once; a is the longer or, of equal length, the smaller."""
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(chunk_keys(F.col("word"), size, levels)).alias("key"))
    grams = words.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"),
        F.explode(F.concat(chunk_keys(F.col("word"), size, levels), chunk_keys(F.col("word"), size + 1, levels))).alias("key"),
    )
    once = (F.length("b") < F.length("a")) | (F.col("a") < F.col("b"))
    found = chunks.join(grams, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b", "n_a", "n_b").distinct()


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of words that have a form, by pointer doubling; chains have at most ``longest`` steps."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stage(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return now


def variants(words: DataFrame, *, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts ``n``.

    Near words are one inserted, deleted or replaced code point apart. The form is the near word of largest n, of
    equally frequent ones the smallest in code-point order, if that n is at least ``ratio`` times the word's;
    otherwise form and form_n are null. The root is the last word that forms lead to, the word itself without one.
    ``ratio`` is above 1, so chains end. An empty table gives no rows; other columns are ignored.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = stage(words.select("word", "n"), "spelling-words")
    pairs = near_words(words, levels=levels)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    known = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(known, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    known = stage(
        known.select(
            "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    low, high = known.agg(F.min("n"), F.max("n")).first()
    longest = int(math.log(high / low) / math.log(ratio) + 1e-9) if high else 0
    roots = _roots(known.where("form is not null"), longest)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
