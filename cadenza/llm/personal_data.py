"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns propose further spans. Regex, gazetteer and
context labelers vote on every candidate, base spans included; the counts of the vote patterns, a few hundred rows
at most, are all that expectation-maximisation needs to estimate each labeler's reliability and each pattern's
probability. A logistic classifier trained on those probabilities decides on the proposed spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import plain, stage

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive runs that start where no earlier character could extend them match the same spans as
#: the plain forms, in time proportional to the text.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{2,64}}+ ?[(\[{{]at[)\]}}] ?{_HOST}{{1,63}}+(?: ?(?:\.|[(\[{{]dot[)\]}}]) ?[A-Za-z0-9-]{{2,24}}+){{1,4}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}+[0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(])\(?+[0-9]{3}\)?+[ .-]{1,2}+[0-9]{3}[ .-]{1,2}+[0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be worth running.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
_NEEDS_LOOSE = {"email": "at[)\\]}]", "ip": "[0-9] ?\\. ?[0-9]", "card": "[0-9]{4}[ ._/-]", "phone": "[0-9]{3}\\)?[ .-]"}
#: Gazetteers: mail domains' last labels, first digits of card issuers, first parts of networks that are no host's.
TOP_LEVEL = "com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at|us|ca|mx"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
NO_HOST = "0|22[4-9]|2[3-5][0-9]"
CUES = {
    "email": "mail|contact|write|courriel|correo|schreib", "ip": "\\bip\\b|server|host|addr|login|adresse",
    "card": "card|visa|master|credit|carte|karte|tarjeta", "phone": "phone|tel|call|fax|mobil|cell|anruf",
}
COUNTER_CUES = "version|build|isbn|issn|invoice|order|section|chapter|release"
#: Characters before a span in which cues count.
NEAR = 40
LABELERS = ("shape", "gazetteer", "context", "edge")
ACCEPT = 0.9

_SPAN = "struct<kind:int,start:int,end:int,shape:int,gazetteer:int,context:int,edge:int>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        d = _digits(s)
        return F.length(d).between(13, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, s: Column, text: Column, start: Column, end: Column) -> dict[str, Column]:
    """1 for, 0 against, -1 no vote."""
    before = F.lower(F.substring(text, F.greatest(F.lit(1), start - NEAR + 1), F.least(start, F.lit(NEAR))))
    shape = {"email": s.rlike("@"), "ip": valid("ip", F.regexp_replace(s, " ", "")), "card": F.length(_digits(s)).between(13, 19) & _luhn(_digits(s)),
             "phone": F.length(_digits(s)).between(10, 15)}[kind]
    listed = {
        "email": F.when(F.lower(s).rlike(rf"(?:\.|dot[)\]}}]) ?(?:{TOP_LEVEL})$"), 1).otherwise(-1),
        "ip": F.when(s.rlike(rf"^(?:{NO_HOST})\b"), 0).otherwise(-1),
        "card": F.when(_digits(s).rlike(f"^(?:{ISSUERS})"), 1).otherwise(0),
        "phone": F.when(_digits(s).rlike("^0{3}|0{7}$"), 0).otherwise(-1),
    }[kind]
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(COUNTER_CUES), 0).otherwise(-1)
    around = F.concat(F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(" "), F.substring(text, end + 1, F.lit(1)))
    return {"shape": shape.cast("int"), "gazetteer": listed, "context": context, "edge": (~around.rlike(r"[\p{L}\p{N}_@]")).cast("int")}


def _spans(kind: str, text: Column, matches: Column, pieces: Column, strict: bool) -> Column:
    """Spans with votes of the matches that count, from the matches and what lies between them."""
    parts = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(
        m.alias("s"), F.length(p).alias("gap"), F.length(m).alias("n"), (valid(kind, m) if strict else F.lit(True)).alias("ok")))
    none = F.expr("cast(array() as array<struct<s:string,start:int,end:int>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        more = F.concat(acc["found"], F.array(F.struct(x["s"].alias("s"), start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["ok"], more).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda acc: acc["found"])
    kind_id = F.lit(KINDS.index(kind))

    def voted(x: Column) -> Column:
        v = _votes(kind, x["s"], text, x["start"], x["end"])
        return F.struct(kind_id.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *(v[n].alias(n) for n in LABELERS)).cast(_SPAN)

    return F.transform(found, voted)


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``base`` and ``proposed``, arrays of spans with votes, to rows with a column ``text``.

    Ends are exclusive and count code points. Proposed spans do not overlap base spans.
    """
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    jobs = [(f"{form}_{kind}", kind, table[kind], needs[kind], form == "base") for form, table, needs in (("base", BASE, _NEEDS), ("loose", LOOSE, _NEEDS_LOOSE)) for kind in KINDS]
    out = rows.withColumn("body", F.coalesce("text", F.lit("")))
    out = out.withColumns({f"m_{name}": F.when(F.col("body").rlike(need), F.regexp_extract_all("body", F.lit(pattern), F.lit(0))) for name, _, pattern, need, _ in jobs})
    out = out.withColumns({f"p_{name}": F.when(F.size(f"m_{name}") > 0, F.split("body", pattern, -1)) for name, _, pattern, _, _ in jobs})
    out = out.withColumns(
        {f"s_{name}": F.when(F.size(f"m_{name}") > 0, _spans(kind, F.col("body"), F.col(f"m_{name}"), F.col(f"p_{name}"), strict)).otherwise(none) for name, kind, _, _, strict in jobs}
    )
    base = F.concat(*(F.col(f"s_base_{k}") for k in KINDS))
    loose = F.concat(*(F.col(f"s_loose_{k}") for k in KINDS))
    out = out.withColumn("base", base).withColumn("loose", loose)
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return out.withColumn("proposed", F.when(F.size("loose") > 0, F.filter("loose", clear)).otherwise(none)).select(*rows.columns, "base", "proposed")


def estimate(patterns: list[tuple], rounds: int = 100) -> tuple[dict, list[float]]:
    """Expectation-maximisation over (votes, count): reliabilities of each labeler, probability of each pattern."""
    right = [[0.8, 0.8] for _ in LABELERS]  # P(vote 0 | no), P(vote 1 | yes)
    prior, posterior = 0.7, [0.5] * len(patterns)
    for _ in range(rounds):
        for k, (votes, _) in enumerate(patterns):
            yes, no = math.log(prior), math.log(1 - prior)
            for (r0, r1), v in zip(right, votes):
                if v >= 0:
                    yes += math.log(r1 if v else 1 - r1)
                    no += math.log(1 - r0 if v else r0)
            posterior[k] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.01, sum(p * n for p, (_, n) in zip(posterior, patterns)) / max(1, total)))
        for j in range(len(LABELERS)):
            for label in (0, 1):
                seen = [(p if label else 1 - p, n, v[j]) for p, (v, n) in zip(posterior, patterns) if v[j] >= 0]
                agree = sum(p * n for p, n, v in seen if v == label)
                right[j][label] = min(0.98, max(0.55, (agree + 8) / (sum(p * n for p, n, _ in seen) + 10)))
    return {"prior": prior, "right": right}, posterior


def _features(kind: int, votes: tuple) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(1, len(KINDS))), *(float(v == s) for v in votes for s in (0, 1))]


def train(rows: list[tuple], posterior: list[float], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of the logistic classifier: gradient steps on (kind, votes, count) with soft labels."""
    x = [_features(kind, votes) for kind, votes, _ in rows]
    count = [math.log1p(n) for _, _, n in rows]
    w = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    for _ in range(steps):
        grad = [-0.01 * a for a in w]
        for f, n, p in zip(x, count, posterior):
            z = sum(a * b for a, b in zip(w, f))
            g = n * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / max(1e-9, sum(count))
            for j, b in enumerate(f):
                grad[j] += g * b
        w = [a + rate * g for a, g in zip(w, grad)]
    return w


def learn(found: DataFrame) -> list[float]:
    """Classifier weights from the votes on all base and proposed spans of ``candidates``."""
    each = found.select(F.explode(F.concat("base", "proposed")).alias("x")).groupBy("x.kind", *(f"x.{n}" for n in LABELERS)).agg(F.count("*").alias("n"))
    rows = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in each.collect())
    return train(rows, estimate([(v, n) for _, v, n in rows])[1]) if rows else [-1.0] + [0.0] * (len(KINDS) - 1 + 2 * len(LABELERS))


def decide(found: DataFrame, weights: list[float], accept: float = ACCEPT) -> DataFrame:
    """Adds ``spans``: the base spans and the proposed ones that the classifier accepts, by kind, then start."""

    def probability(x: Column) -> Column:
        z = F.lit(weights[0])
        for k in range(1, len(KINDS)):
            z = z + F.when(x["kind"] == k, weights[k]).otherwise(0.0)
        for j, n in enumerate(LABELERS):
            a = len(KINDS) + 2 * j
            z = z + F.when(x[n] == 0, weights[a]).when(x[n] == 1, weights[a + 1]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    added = F.filter("proposed", lambda x: probability(x) >= accept)
    return found.withColumn("spans", F.array_sort(F.concat("base", added)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every whole text; the candidates are written once to the shared folder.

    A null text is empty. Every row gets its row, repeated ones too. Without any candidate nothing is accepted.
    """
    rows = plain(docs, id_col, text_col)
    found = stage(candidates(rows).select(F.col("id").alias("doc_id"), "base", "proposed"), "candidates")
    return decide(found, learn(found))


def mask(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one."""
    named = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(docs.columns)]
    found = stage(candidates(docs.select(F.col(text_col).alias("text"), *named)), "candidates")
    spans = decide(found, learn(found)).withColumn("sorted", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"]))))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def add(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, F.concat(acc["done"], F.array(gap, names[x["kind"]]))).otherwise(acc["done"]).alias("done"))

    whole = F.aggregate("sorted", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("done")), add,
                        lambda acc: F.concat(F.array_join(acc["done"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("sorted") > 0, whole).otherwise(F.col("text"))
    return spans.select(*((text if c == text_col else F.col(f"keep_{k}")).alias(c) for k, c in enumerate(docs.columns)))
