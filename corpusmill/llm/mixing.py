"""Source mixing at a temperature, in DataFrame functions only.

Weights are source token shares raised to an exponent: 1 keeps the shares, 0 makes
all sources equal. The exponent is bisected (64 cuts of the interval at once) until the
weights have the target entropy, or the most repeated source the target number of
repeats. The weights are realised within a token budget by block permutations: a
source's documents lie in hash blocks of at most about ``BLOCK_ROWS`` rows, as many as a power of
two; each epoch takes the blocks in a permutation of its own and the documents of a block likewise; whole epochs
are taken while the source's share of the budget lasts, then whole blocks, then the
documents of one block.

Only aggregates of the source table are brought to the driver (64 numbers a step).
Within a block and an epoch rows are numbered together, never within a source.

Defined cases: a null source is a source of its own; a null or empty text has 0
tokens; a source without tokens has weight 0 and, where every document is to be used
once, one epoch; documents with a null or repeated id are drawn like others; repeated rows
(equal in id and text) are drawn one by one, and share a block; a very long text is drawn whole or not at all;
all columns are kept, but those that the result adds replace columns of their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import row_key, stored

BLOCK_ROWS = 50_000
CUTS, STEPS = 64, 4


@dataclass(frozen=True)
class MixTarget:
    """Either an entropy in nats, or the most often a source may be repeated.

    ``budget``: tokens to draw; without one, as many as use every source at least once.
    """

    repeats: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(totals: DataFrame, target: MixTarget) -> float:
    """The largest exponent (nearest to the natural shares) that meets the target.

    For a repeat limit: the smallest, so the mix is as even as the limit allows."""
    low, high = 0.0, 1.0
    top = totals.agg(F.max("tokens")).first()[0]
    if not top:
        return 1.0
    ratio = F.col("tokens") / float(top)
    for _ in range(STEPS):
        cuts = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        at = totals.where("tokens > 0").select(ratio.alias("r"), F.explode(F.array(*map(F.lit, cuts))).alias("x"))
        power = F.pow("r", "x")
        rows = (
            at.groupBy("x")
            .agg(
                (F.log(F.sum(power)) - F.sum(power * F.col("x") * F.log("r")) / F.sum(power)).alias("entropy"),
                (F.max(power / F.col("r")) / F.min(power / F.col("r"))).alias("repeats"),
            )
            .orderBy("x")
            .collect()
        )
        if target.entropy is not None:
            good = [r.x for r in rows if r.entropy >= target.entropy]
            low = max(good, default=0.0)
            high = min([x for x in cuts if x > low], default=low)
        else:
            good = [r.x for r in rows if r.repeats <= target.repeats]
            high = min(good, default=1.0)
            low = max([x for x in cuts if x < high], default=high)
        if low >= high:
            break
    return low if target.entropy is not None else high


def source_plan(totals: DataFrame, target: MixTarget) -> DataFrame:
    """(key, weight, epochs, rest): whole epochs of each source and tokens of one more."""
    alpha = exponent(totals, target)
    powered = totals.withColumn("power", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0))
    sums = powered.agg(F.sum("power").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power"))).alias("unit")).first()
    z, unit = sums["z"] or 1.0, sums["unit"] or 0.0
    budget = float(target.budget) if target.budget is not None else z * unit
    wanted = F.col("power") / z * budget
    whole = F.floor(wanted / F.col("tokens") + 1e-9)
    return powered.select(
        "key",
        "tokens",
        F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("rows") / BLOCK_ROWS)), F.lit(0))).cast("long").alias("blocks"),
        (F.col("power") / z).alias("weight"),
        F.when(F.col("tokens") > 0, whole).otherwise(0 if target.budget is not None else 1).cast("int").alias("epochs"),
        F.when(F.col("tokens") > 0, F.greatest(wanted - whole * F.col("tokens"), F.lit(0.0))).otherwise(0.0).alias("rest"),
    )


MARKS = ("mix_epoch", "mix_weight", "mix_order")


def block_turn(block: Column, blocks: Column, *salt: Column) -> Column:
    """The place of ``block`` among ``blocks`` (a power of two) in a permutation of its own for each
    ``salt``: odd factors and a shift with exclusive or, both one to one on that many bits."""
    factor = lambda i: F.xxhash64(F.lit(i), *salt).bitwiseAND((1 << 20) - 1) * 2 + 1
    half = F.ceil(F.log2(blocks) / 2).cast("int")
    mixed = (block * factor(1) + F.xxhash64(F.lit(2), *salt).bitwiseAND((1 << 20) - 1)).bitwiseAND(blocks - 1)
    mixed = mixed.bitwiseXOR(F.call_function("shiftright", mixed, half))
    return (mixed * factor(3)).bitwiseAND(blocks - 1)


def mix_sources(docs: DataFrame, target: MixTarget = MixTarget(), seed: int = 11) -> DataFrame:
    """The drawn rows of ``docs`` with ``mix_epoch``, ``mix_weight`` and ``mix_order``, the
    place (0 to 1) at which the row comes in its source's run and so in the mix."""
    keyed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c not in MARKS]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"),
        token_count(F.col("text")).alias("mix_tokens"),
        F.xxhash64(F.lit(seed), row_key()).alias("mix_hash"),
    )
    totals = stored(keyed.groupBy("key").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    plan = stored(source_plan(totals, target), "mix-plan")
    draws = keyed.join(plan, "key").withColumn("mix_block", F.pmod("mix_hash", F.col("blocks")))
    turn = lambda epoch: block_turn(F.col("mix_block"), F.col("blocks"), F.lit(seed), F.col("key"), epoch)
    blocks = (
        draws.where("rest > 0")
        .withColumn("turn", turn(F.col("epochs")))
        .groupBy("key", "mix_block", "turn", "rest")
        .agg(F.sum("mix_tokens").alias("tokens"))
    )
    upto = Window.partitionBy("key").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = stored(
        blocks.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        .where("before < rest")
        .select("key", "mix_block", F.col("before").cast("double").alias("before"), (F.col("before") + F.col("tokens") <= F.col("rest")).alias("whole")),
        "mix-blocks",
    )
    total = F.col("tokens") * F.col("epochs") + F.col("rest")

    def order(epoch: Column) -> Column:
        """Block, then document, scaled to the source's run."""
        share = (F.xxhash64(F.lit(seed), epoch, "mix_hash").bitwiseAND((1 << 40) - 1) + 0.5) / (1 << 40)
        return F.least(F.lit(1.0), (epoch + (turn(epoch) + share) / F.col("blocks")) * F.col("tokens") / total)

    names = ["row.*", *MARKS]
    whole = (
        draws.where("epochs > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumns({"mix_weight": F.col("weight"), "mix_order": F.coalesce(order(F.col("mix_epoch")), F.lit(0.0))})
    )
    part = draws.join(last, ["key", "mix_block"]).withColumns(
        {"mix_epoch": F.col("epochs"), "mix_weight": F.col("weight"), "mix_order": order(F.col("epochs"))}
    )
    running = Window.partitionBy("key", "mix_block").orderBy(F.xxhash64(F.lit(seed), "epochs", "mix_hash"), "mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        part.where("NOT whole")
        .withColumn("used", F.col("before") + F.coalesce(F.sum("mix_tokens").over(running), F.lit(0)))
        .where("used + mix_tokens <= rest")
    )
    return whole.select(names).unionByName(part.where("whole").select(names)).unionByName(cut.select(names))
