"""Personal data in whole texts: exact base patterns, and more spans by weak supervision.

Base spans are e-mail and IP addresses, payment cards and phone numbers, found by
fixed patterns and checked by their rules. Further candidates are words that hold a
digit. Labelers vote on every candidate: the base patterns, weaker shapes, word lists
(gazetteers) for the candidate, and word lists for what stands before it. Expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is,
and thus how likely each candidate is personal data; a naive Bayes classifier of spans is
trained on these soft labels. Candidates that it accepts and that touch no base span are
added as kind `other`; base spans always stay.

All row work is column expressions. What reaches the driver are counts per vote pattern
and per (feature, vote pattern): their number is fixed by the labelers, not by the data.

The work for a text grows with its length, and with the number of its matches times
that number's root.

A null text is empty. Ties and repeated rows give equal results; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.session import written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive runs and starts at the beginning of a run find the same
#: matches as the plain patterns, in time proportional to the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit, up to their last letter or digit.
CANDIDATE = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9]*+[0-9](?:[^\x20\x09-\x0D]*[A-Za-z0-9])?"
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
ROUNDS = 30
ACCEPT = 0.5
#: Word lists of the labelers.
OWN_WORDS = ("mail", "phone", "tel", "ssn", "iban", "passw", "secret", "token", "key", "akia", "user", "pin")
PLAIN_WORDS = ("http", "www", ".html", ".jpg", ".pdf", "page", "fig", "sec", "vol", "no.")
BEFORE_OWN = ("phone", "tel", "call", "mobile", "fax", "mail", "email", "contact", "ip", "host", "card", "visa", "account", "iban", "ssn", "passport", "password", "key", "token", "id", "user", "born")
BEFORE_PLAIN = ("page", "chapter", "section", "figure", "table", "version", "step", "year", "in", "of", "the", "about", "volume", "part", "line")


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches and the gaps around them: one more gap than matches."""
    there = text.rlike("[0-9]") & (text.contains(needs) if needs else F.lit(True)) if needs != "@" else text.contains("@")
    return F.when(there, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")))


def _let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: Column) -> Column:
    """Running sums from `start` on. The array grows by copying, so for short arrays only."""
    empty = F.struct(start.cast("long").alias("at"), F.expr("cast(array() AS array<bigint>)").alias("sums"))

    def add(acc, x):
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.concat(acc["sums"], F.array(at)).alias("sums"))

    return F.aggregate(values, empty, add, lambda acc: acc["sums"])


def _ends(widths: Column) -> Column:
    """Running sums of an array of any length: within blocks of its length's square root, from
    the running sums of the blocks, so that the copying grows with the length times its root."""
    def summed(parts):
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        begun = F.concat(F.array(F.lit(0).cast("long")), _running(totals, F.lit(0)))
        return _let(begun, lambda b: F.flatten(F.transform(parts, lambda p, k: _running(p, F.get(b, k)))))

    def cut(w):
        block = F.ceil(F.sqrt(F.size(w))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / block).cast("int") - 1), lambda k: F.slice(w, k * block + 1, block))

    return _let(widths, lambda w: _let(cut(w), summed))


def _spans(found: Column) -> Column:
    """array<struct<start, end, m, gap>> in code points, from matches and gaps.

    Of the gap before a match its last 40 code points are kept, for the word before it.
    """
    def placed(f):
        at = F.sequence(F.lit(0), F.size(f["m"]) - 1)
        widths = F.transform(at, lambda i: F.length(F.get(f["g"], i)) + F.length(F.get(f["m"], i)))
        return _let(_ends(widths), lambda ends: F.transform(f["m"], lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("m"), F.right(F.get(f["g"], i), F.lit(40)).alias("gap"))))

    none = F.expr("cast(array() AS array<struct<start: bigint, end: bigint, m: string, gap: string>>)")
    return _let(found, lambda f: F.when(f.isNotNull() & (F.size(f["m"]) > 0), placed(f)).otherwise(none))


def _overlaps(spans: Column, c: Column) -> Column:
    """Whether a span of `spans`, in order and apart from each other, overlaps `c`: the last one
    that begins before the end of `c` is found by halving."""
    steps = F.sequence(F.ceil(F.log2(F.size(spans) + 1)).cast("int"), F.lit(0), F.lit(-1))

    def step(before, b):
        ahead = (before + F.call_function("shiftleft", F.lit(1), b)).cast("int")
        return F.when((ahead <= F.size(spans)) & (F.get(spans, ahead - 1)["start"] < c["end"]), ahead).otherwise(before)

    before = F.aggregate(steps, F.lit(0), step)
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(_let(before, lambda n: (n > 0) & (F.get(spans, n - 1)["end"] > c["start"])))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _checked(at: int, kind: str) -> Column:
    valid = F.filter(f"s_{kind}", lambda s: _valid(kind, s["m"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("k"), s["end"].alias("end")))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _votes(c: Column, base: Column) -> Column:      # base: the spans of each kind
    """One letter per labeler: y for personal data, n for not, - for no opinion."""
    word, before = F.lower(c["m"]), F.lower(F.regexp_extract(c["gap"], r"([A-Za-z]+)[^A-Za-z]{0,4}$", 1))
    digits = F.length(_digits(c["m"]))
    return F.concat(
        F.when(F.exists(base, lambda spans: _overlaps(spans, c)), "y").otherwise("-"),
        F.when(c["m"].rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|[0-9]{3}[-.][0-9]{4}$") | (digits >= 9), "y").when(digits <= 2, "n").otherwise("-"),
        F.when(_any(word, OWN_WORDS), "y").when(_any(word, PLAIN_WORDS), "n").otherwise("-"),
        F.when(before.isin(*BEFORE_OWN), "y").when(before.isin(*BEFORE_PLAIN), "n").otherwise("-"),
        F.when((F.length(c["m"]) >= 16) & word.rlike("[a-z]"), "y").when(F.length(c["m"]) <= 4, "n").otherwise("-"))


def _features(c: Column) -> Column:
    """Coarse properties of a span for the final classifier, each with few values."""
    digits, length = F.length(_digits(c["m"])), F.length(c["m"])
    return F.array(
        F.concat(F.lit("length="), F.least(F.floor(F.log2(length)), F.lit(6)).cast("string")),
        F.concat(F.lit("digits="), F.least(F.floor(F.log2(digits)), F.lit(5)).cast("string")),
        F.concat(F.lit("share="), F.floor(4 * digits / length).cast("string")),
        F.concat(F.lit("letters="), c["m"].rlike("[A-Za-z]").cast("string")),
        F.concat(F.lit("capitals="), c["m"].rlike("^[A-Z0-9]+$").cast("string")),
        F.concat(F.lit("marks="), F.least(length - F.length(F.regexp_replace(c["m"], "[@=.:/_-]", "")), F.lit(4)).cast("string")),
        F.concat(F.lit("equals="), c["m"].contains("=").cast("string")),
        F.concat(F.lit("quote="), c["gap"].endswith('"').cast("string")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and asked spans of every row; texts are read in place and not moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", *[_matches(F.col("text"), PATTERNS[k], NEEDS[k]).alias(f"f_{k}") for k in KINDS], _matches(F.col("text"), CANDIDATE, "").alias("f_asked"))
    rows = rows.select("doc_id", *[_spans(F.col(f"f_{k}")).alias(f"s_{k}") for k in KINDS], _spans(F.col("f_asked")).alias("s_asked"))
    rows = rows.select("doc_id", F.array_sort(F.concat(*[_checked(at, k) for at, k in enumerate(KINDS)])).alias("base"), "s_asked")
    def of_kind(at):
        return F.filter("base", lambda b: b["k"] == at)

    kinds = F.array(*[of_kind(at) for at in range(len(KINDS))])
    asked = _let(kinds, lambda base: F.transform("s_asked", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _votes(c, base).alias("votes"), _features(c).alias("features"))))
    return rows.select("doc_id", "base", asked.alias("asked"))


def reliabilities(counts: dict[str, int]) -> tuple[float, list[dict[str, dict[str, float]]], dict[str, float]]:
    """Share of personal data, each labeler's chances of its votes, and the posterior of each pattern."""
    labelers = len(next(iter(counts), ""))
    belief = {v: min(0.95, max(0.05, 0.4 + 0.25 * (v.count("y") - v.count("n")))) for v in counts}
    prior, chances = 0.5, []
    for _ in range(ROUNDS):
        total = sum(counts.values())
        weight = {"y": sum(n * belief[v] for v, n in sorted(counts.items()))}
        weight["n"] = total - weight["y"]
        prior = min(0.99, max(0.01, weight["y"] / total)) if total else 0.5
        chances = []
        for j in range(labelers):
            table = {cls: {vote: 1.0 for vote in "yn-"} for cls in "yn"}
            for v, n in sorted(counts.items()):
                table["y"][v[j]] += n * belief[v]
                table["n"][v[j]] += n * (1 - belief[v])
            chances.append({cls: {vote: x / (weight[cls] + 3) for vote, x in votes.items()} for cls, votes in table.items()})
        for v in counts:
            z = math.log(prior / (1 - prior)) + sum(math.log(chances[j]["y"][c] / chances[j]["n"][c]) for j, c in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return prior, chances, belief


def train(spans: DataFrame) -> tuple[float, dict[str, float]]:
    """The classifier: its bias and the log odds of each feature value."""
    asked = spans.select(F.explode("asked").alias("c")).select("c.votes", "c.features")
    counts = {r["votes"]: r["n"] for r in asked.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return -30.0, {}
    prior, _, belief = reliabilities(counts)
    seen = asked.select("votes", F.explode("features").alias("feature")).groupBy("votes", "feature").agg(F.count("*").alias("n")).collect()
    sums: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    for r in sorted(seen):
        sums[r["feature"]][0] += r["n"] * belief[r["votes"]]
        sums[r["feature"]][1] += r["n"] * (1 - belief[r["votes"]])
    yes = sum(n * belief[v] for v, n in sorted(counts.items()))
    no = sum(counts.values()) - yes
    odds = {f: math.log(a / (yes + 1)) - math.log(b / (no + 1)) for f, (a, b) in sorted(sums.items())}
    return math.log((yes + 1) / (no + 1)), odds


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (start, k, end) of every row; k 4 is `other`."""
    spans = written(candidates(docs), "span-candidates")
    bias, odds = train(spans)
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair]) if odds else None

    def accepted(c):
        score = F.aggregate(c["features"], F.lit(bias), lambda z, f: z + F.coalesce(table[f], F.lit(0.0)))
        apart = ~c["votes"].startswith("y")      # the first labeler is the base spans
        return apart & (score >= math.log(ACCEPT / (1 - ACCEPT)))

    none = F.expr("cast(array() AS array<struct<start: bigint, k: int, end: bigint>>)")
    added = F.transform(F.filter("asked", accepted), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("k"), c["end"].alias("end"))) if odds else none
    return spans.select("doc_id", "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "other")])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of every row."""
    def count(at):
        return F.size(F.filter("base", lambda s: s["k"] == at)).cast("long")

    counts = [count(at).alias(f"n_{kind}") for at, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
