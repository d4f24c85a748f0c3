"""Temperature mixing of sources, realised as budgeted permutations of blocks.

A source with token share s gets the weight s^a / sum(s^a). The exponent a is found by
bisection, several halvings per pass over the short table of sources: the smallest one
that keeps the ratio of the most to the least repeated source within a limit, or the
one at which the weights reach an entropy. The budget is the smallest in which every
source is seen at least once, so no document is lost.

A source's documents are dealt into blocks by hash. Each epoch permutes the blocks
and the documents in them by hashes of their own; whole epochs take all, the last
one takes documents while they fit into what is left of the source's budget.

A null source is a source; null and empty texts have no tokens, and a source without
any is seen once. Rows of one doc_id and text share their place; repeated rows are
dealt each. Empty tables give empty results. Columns of other names are carried by
`mixed_documents` and not read else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.session import cut, written

BLOCK_ROWS = 1024
SEED = 17
POINTS = 15         # exponents tried per pass: four halvings
PASSES = 8


@dataclass(frozen=True)
class Target:
    """Give one: the largest ratio of repetitions, or an entropy in nats."""

    repetitions: float | None = None
    entropy: float | None = None


def token_count(text):
    """Words between white space; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measured(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, ratio of repetitions) at each exponent, in one pass over the sources."""
    share, columns = F.col("share"), []
    for i, a in enumerate(exponents):
        weight = F.pow(share, F.lit(a))
        columns += [F.sum(weight).alias(f"z{i}"), F.sum(weight * F.log(share)).alias(f"l{i}"),
                    F.max(F.pow(share, F.lit(a - 1))).alias(f"x{i}"), F.min(F.pow(share, F.lit(a - 1))).alias(f"n{i}")]
    row = sources.where("share > 0").agg(*columns).first()
    return [(math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], row[f"x{i}"] / row[f"n{i}"]) if row[f"z{i}"] else (0.0, 1.0)
            for i, a in enumerate(exponents)]


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] that meets the target; both measures fall as it grows."""
    low, high = 0.0, 1.0
    if target.entropy is not None:
        met = lambda m: m[0] <= target.entropy
    else:
        met = lambda m: m[1] <= target.repetitions
    if met(_measured(sources, [low])[0]):
        return low
    for _ in range(PASSES):
        tried = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        first = next((k for k, m in enumerate(_measured(sources, tried)) if met(m)), POINTS)
        low, high = (tried[first - 1] if first else low), (tried[first] if first < POINTS else high)
    return round(high, 9)


def budgets(docs: DataFrame, target: Target) -> DataFrame:
    """source, rows, tokens, share, weight, budget, epochs, blocks: the short table of sources.

    `docs` has source and n_tokens. `epochs` is the budget over the source's tokens.
    """
    sums = docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    sums = written(sums, "source-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0))
    a = exponent(shares, target)
    weighed = shares.withColumn("raw", F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    z, least = weighed.agg(F.sum("raw"), F.max(F.when(F.col("share") > 0, F.col("tokens") / F.col("raw")))).first()
    weight = F.col("raw") / F.lit(z) if z else F.lit(0.0)
    budget = F.round(F.col("raw") * F.lit(least or 0.0)).cast("long")
    out = weighed.select("source", "rows", "tokens", "share", weight.alias("weight"), F.greatest(budget, "tokens").alias("budget"))
    out = out.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1))
    out = out.withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0))
    return written(out.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)), "source-budgets")


def _row_hash():
    """A hash of the row's own content; rows without a doc_id are told apart by their text."""
    return F.xxhash64("doc_id", F.col("text"))


def _block():
    return F.pmod(F.xxhash64("h", F.lit(SEED)), "blocks")


def _block_key(epoch):
    return F.xxhash64(F.lit(SEED), "source", epoch, "block")


def _doc_key(epoch):
    return F.xxhash64(F.lit(SEED), epoch, "h")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h, n_tokens of every row, written once."""
    named = documents(docs, "doc_id", "source", "text")
    return written(named.select("doc_id", "source", _row_hash().alias("h"), token_count(F.col("text")).alias("n_tokens")), "row-sizes")


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their source's row of the short table; nulls meet nulls."""
    key = table.withColumnRenamed("source", "__source")
    return rows.join(key, rows["source"].eqNullSafe(key["__source"]), "left").drop("__source")


def permuted(rows: DataFrame, table: DataFrame, last_only: bool = False) -> DataFrame:
    """Every copy of a row: epoch, block, where its tokens start in the source's stream, and whether it is taken.

    A window covers a block's rows or a source's blocks (one per BLOCK_ROWS rows), never
    a source's rows.
    """
    dealt = _with_source(rows, table.select("source", "tokens", "whole", "rest", "blocks")).withColumn("block", _block())
    first = F.col("whole") if last_only else F.lit(0).cast("long")
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    dealt = dealt.withColumn("epoch", F.explode(F.when(first <= last, F.sequence(first, last))))
    dealt = dealt.withColumn("bk", _block_key(F.col("epoch"))).withColumn("dk", _doc_key(F.col("epoch")))
    place = ["source", "epoch", "bk", "block"]
    inside = Window.partitionBy(*place).orderBy("dk", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(*place).agg(F.sum("n_tokens").alias("block_tokens"))
    across = Window.partitionBy("source", "epoch").orderBy("bk", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bk").alias("k"), F.col("block").alias("b"), F.coalesce(F.sum("block_tokens").over(across), F.lit(0)).alias("before"))
    laid = dealt.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    laid = laid.join(blocks, laid["source"].eqNullSafe(blocks["s"]) & (laid["epoch"] == blocks["e"]) & (laid["bk"] == blocks["k"]) & (laid["block"] == blocks["b"]))
    laid = laid.withColumn("in_epoch", F.col("before") + F.col("inside"))
    taken = (F.col("epoch") < F.col("whole")) | (F.col("in_epoch") + F.col("n_tokens") <= F.col("rest"))
    return laid.withColumn("taken", taken).withColumn("start", F.col("epoch") * F.col("tokens") + F.col("in_epoch"))


def mixture(docs: DataFrame, target: Target) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, start, budget of every copy in the mixture."""
    rows = sizes(docs)
    table = budgets(rows, target)
    out = permuted(rows, table).where("taken").select("doc_id", "source", "n_tokens", "epoch", "block", "start")
    return _with_source(out, table.select("source", "budget"))


def mixed_documents(docs: DataFrame, target: Target) -> DataFrame:
    """The mixture's rows with all columns of `docs`; texts are not shuffled.

    What the last epoch takes of a source is a prefix in the order of its keys, so the
    last key taken per source, and how many of its rows fit, decide each row where it
    stands. Only where equal rows share the last key and some of them do not fit are
    those rows, and no others, written and numbered.
    """
    rows = sizes(docs)
    table = budgets(rows, target)
    keys = permuted(rows, table, last_only=True).groupBy("source", "bk", "block", "dk").agg(F.count_if("taken").alias("fit"), F.count("*").alias("equal"))
    last = keys.where("fit > 0").groupBy("source").agg(F.max(F.struct(F.struct("bk", "block", "dk").alias("key"), "fit", "equal")).alias("upto"))
    plan = _with_source(table.select("source", "whole", "rest", "blocks"), last)
    plan = written(plan.select(F.struct("source", "whole", "blocks", "upto").alias("__plan")), "mixing-plan")
    named = docs.join(plan, docs["source"].eqNullSafe(F.col("__plan.source")), "left")
    h = F.xxhash64(docs["doc_id"], docs["text"])
    block = F.pmod(F.xxhash64(h, F.lit(SEED)), F.col("__plan.blocks"))
    key = F.struct(F.xxhash64(F.lit(SEED), docs["source"], F.col("__plan.whole"), block).alias("bk"), block.alias("block"), F.xxhash64(F.lit(SEED), F.col("__plan.whole"), h).alias("dk"))
    upto = F.col("__plan.upto")
    split = F.coalesce((key == upto["key"]) & (upto["fit"] < upto["equal"]), F.lit(False))
    carry = [F.col(f"`{c}`") for c in docs.columns]

    def copies(part: DataFrame, once_more) -> DataFrame:
        times = F.col("__plan.whole") + F.when(once_more, 1).otherwise(0)
        return part.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)))).select(*carry)

    if plan.where("__plan.upto.fit < __plan.upto.equal").isEmpty():
        return copies(named, key <= upto["key"])
    equal = cut(named.where(split).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    in_part = Window.partitionBy("__plan.source", "__part").orderBy("__at")
    parts = equal.groupBy(F.col("__plan.source").alias("__source"), F.col("__part").alias("__of")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__source", "__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = equal.withColumn("__in", F.row_number().over(in_part))
    numbered = numbered.join(parts, numbered["__plan.source"].eqNullSafe(parts["__source"]) & (numbered["__part"] == parts["__of"]))
    return copies(named.where(~split), key <= upto["key"]).unionByName(copies(numbered, F.col("__before") + F.col("__in") <= upto["fit"]))
