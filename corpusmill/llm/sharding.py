"""Shards by k-d tree partitioning, in DataFrame functions only.

The tree starts with all rows and the wanted number of leaves. A node is split along
the metadata dimension in which its rows spread widest, at the weighted quantile that
gives each side weight in proportion to its leaves, until every node is a leaf. The
quantiles of all nodes of a level are found together by distributed radix selection:
rows are counted by 16 bits of their place along the node's dimension, then by the
next 16, and so on; a node has at most 65,536 counts to order. Rows with equal places (copies, one large source) are told apart
by a hash of the row and its place in the table, so that no group is too large to split. Source and language
have no order of their own: a hash places them, so that a source's rows lie together.

The number of leaves is given, or follows from the bytes that a leaf may have. What reaches
the driver is one row a node, at most the number of shards. Slots within
a shard come from hash ranges of bounded size, so no shard is sorted in one task.

Defined cases: a null text has 0 bytes (size 8) and the checksum of no bytes; null
metadata are a value of their own, below others; rows without a ``doc_id`` are placed
like others; repeated rows are placed one by one; a very long text is one row of its size; other columns
are carried along whatever their names, but ``shard`` and ``slot`` replace those of the input; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, small_table, stored

OVERHEAD = 8
SLOT_ROWS = 50_000
PLACE_BITS, HASH_BITS, DIGIT = 20, 28, 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def document_dimensions() -> dict[str, Column]:
    """Metadata of a document as numbers: log size, and places for source and language."""
    spread = lambda c: F.when(F.col(c).isNull(), -1.0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20))
    return {"size": F.log2(size_of(F.col("text"))), "source": spread("source"), "lang": spread("lang")}


def kd_splits(rows: DataFrame, dims: list[str], weight: str, n_leaves: int) -> list[dict[int, dict]]:
    """The splits of each level, by node. ``rows`` (dims, weight, tie) is read several
    times, so it should be stored and narrow. Rows with their nodes are stored after each level, so that
    a plan looks up one level's splits and not those of all before; the table of the level before is deleted."""
    span = rows.agg(*[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))]).first()
    width = {d: (span[f"max_{d}"] or 0.0) - (span[f"min_{d}"] or 0.0) for d in dims}
    nodes, levels = {0: n_leaves}, []
    placed = rows.withColumn("shard", F.lit(0))
    while any(m > 1 for m in nodes.values()):
        open_nodes = [n for n, m in nodes.items() if m > 1]
        stats = (
            placed.where(F.col("shard").isin(open_nodes))
            .groupBy("shard")
            .agg(F.sum(weight).alias("w"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))])
            .collect()
        )
        if not stats:
            break
        splits = {}
        for s in stats:
            spread = {d: (s[f"max_{d}"] - s[f"min_{d}"]) / width[d] if width[d] else 0.0 for d in dims}
            dim = max(dims, key=lambda d: spread[d])
            m = nodes[s["shard"]]
            splits[s["shard"]] = {
                "dim": dim, "low": float(s[f"min_{dim}"]), "range": float(s[f"max_{dim}"] - s[f"min_{dim}"]),
                "goal": s["w"] * (m // 2) / m, "prefix": 0, "below": 0.0, "left": m // 2,
            }
        for shift in range(PLACE_BITS + HASH_BITS - DIGIT, -1, -DIGIT):
            splits = select_digit(placed, splits, weight, shift)
        for shard in open_nodes:
            if shard in splits:
                left = splits[shard]["left"]
                nodes[shard + left], nodes[shard] = nodes[shard] - left, left
            else:
                nodes[shard] = 1
        levels.append(splits)
        if any(m > 1 for m in nodes.values()):
            before, placed = placed, stored(descended(placed, dims, splits), "shard-level")
            if len(levels) > 1:
                discard(before)
    if len(levels) > 1:
        discard(placed)
    return levels


def descended(placed: DataFrame, dims: list[str], splits: dict[int, dict]) -> DataFrame:
    """``placed`` with each row's ``shard`` one level further down."""
    side = F.when(key_of(dims) >= F.col("split.prefix"), F.col("split.left")).otherwise(0)
    return with_split(placed, splits, "left").withColumn("shard", F.col("shard") + side).drop("split")


def with_shards(rows: DataFrame, dims: list[str], levels: list[dict[int, dict]]) -> DataFrame:
    """``rows`` (any columns beside dims and tie) with the ``shard`` that the splits give."""
    placed = rows.withColumn("shard", F.lit(0))
    for splits in levels:
        placed = descended(placed, dims, splits)
    return placed


SPLIT = "node int, dim string, low double, range double, prefix long, below double, goal double, left int"


def with_split(rows: DataFrame, splits: dict[int, dict], how: str = "inner") -> DataFrame:
    """``rows`` with their node's split as a struct. There is one split a node that is being
    split, at most half the number of shards, so the table of them is broadcast; the root's
    is a constant."""
    table = [(n, s["dim"], s["low"], s["range"], s["prefix"], s["below"], s["goal"], s["left"]) for n, s in splits.items()]
    names = [field.split()[0] for field in SPLIT.split(", ")]
    if list(splits) == [0]:
        kinds = [field.split()[1] for field in SPLIT.split(", ")]
        return rows.withColumn("split", F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(table[0], kinds, names, strict=True)]))
    held = small_table(rows.sparkSession, table, SPLIT).select("node", F.struct(*names).alias("split"))
    return rows.join(F.broadcast(held), F.col("shard") == F.col("node"), how).drop("node")


def key_of(dims: list[str]) -> Column:
    """A row's place along its node's dimension, then hash bits, in one integer."""
    value = F.coalesce(*[F.when(F.col("split.dim") == d, F.col(d)) for d in dims])
    share = F.when(F.col("split.range") > 0, (value - F.col("split.low")) / F.col("split.range")).otherwise(0.0)
    top = (1 << PLACE_BITS) - 1
    place = F.least(F.greatest(F.floor(share * top), F.lit(0)), F.lit(top)).cast("long")
    return place * (1 << HASH_BITS) + F.col("tie")


def select_digit(placed: DataFrame, splits: dict[int, dict], weight: str, shift: int) -> dict[int, dict]:
    """The next 16 bits of each node's split key: the first digit at which the weight
    below passes the goal. On the last digit the nearer of its two edges is taken."""
    dims = sorted({s["dim"] for s in splits.values()})
    counted = (
        with_split(placed, splits)
        .select("shard", "split.prefix", "split.below", "split.goal", F.col(weight).alias("weight"), F.shiftright(key_of(dims), shift).alias("digit"))
        .where(F.shiftright("digit", DIGIT) == F.col("prefix"))
        .groupBy("shard", "below", "goal", "digit")
        .agg(F.sum("weight").cast("double").alias("weight"))
    )
    upto = Window.partitionBy("shard").orderBy("digit")
    found = (
        counted.withColumn("upto", F.sum("weight").over(upto))
        .where(F.col("below") + F.col("upto") >= F.col("goal") - 1e-6)
        .groupBy("shard")
        .agg(F.min(F.struct("digit", "upto", "weight")).alias("first"))
        .collect()
    )
    out = {}
    for r in found:
        s = dict(splits[r["shard"]])
        before = s["below"] + r["first"]["upto"] - r["first"]["weight"]
        s["prefix"], over = r["first"]["digit"], s["below"] + r["first"]["upto"] - s["goal"]
        if shift == 0:
            s["prefix"] += over < s["goal"] - before
        s["below"] = before
        out[r["shard"]] = s
    return out


def with_slots(rows: DataFrame, counted: DataFrame, order: list[str]) -> DataFrame:
    """A gapless ``slot`` from 0 in each shard of ``rows`` (with shard and tie): hash ranges of
    about ``SLOT_ROWS`` rows are numbered one by one and offset by the rows of the ranges
    before. ``counted`` holds the shard and tie of the same rows, stored."""
    place = F.floor(F.col("tie") * F.col("ranges") / float(1 << HASH_BITS)).cast("int")
    ranges = counted.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("ranges"))
    upto = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        counted.join(ranges, "shard")
        .groupBy("shard", "ranges", place.alias("range"))
        .count()
        .withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
        .select("shard", "ranges", "range", "before"),
        "slot-offsets",
    )
    own = Window.partitionBy("shard", "range").orderBy("tie", *order)
    return (
        rows.join(offsets.select("shard", "ranges").distinct(), "shard")
        .withColumn("range", place)
        .withColumn("slot", F.row_number().over(own) - 1)
        .join(offsets.select("shard", "range", "before"), ["shard", "range"])
        .withColumn("slot", (F.col("slot") + F.col("before")).cast("long"))
        .drop("range", "ranges", "before")
    )


def measured(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """A stored table of size, checksum, dimensions and tie of each row, and the given columns of ``docs``
    as a struct ``row``; the names of the dimensions. The tie holds the row's place, which is fixed by storing it."""
    dims = {f"dim_{d}": c.cast("double") for d, c in document_dimensions().items()}
    wide = docs.select(
        F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"),
        crc_of(F.col("text")).alias("text_crc32"), F.lit(1).alias("one"), *[c.alias(d) for d, c in dims.items()],
    )
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(1 << HASH_BITS))
    return stored(wide.withColumn("tie", tie), "shard-rows"), list(dims)


def placed_rows(docs: DataFrame, law: str, keep: list[str], n_shards: int | None, target_bytes: int | None = None) -> DataFrame:
    """(row, doc_id, size, text_crc32, shard, slot) of each row: ``row`` has the columns ``keep``. The tree is
    built from the numbers alone; what is kept moves once, to its shard."""
    rows, dims = measured(docs, keep)
    if n_shards is None:
        n_shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    levels = kd_splits(rows.drop("row"), dims, "size" if law == "bytes" else "one", n_shards)
    placed = with_shards(rows, dims, levels).drop("one", *dims)
    counted = stored(placed.select("shard", "tie"), "shards")
    slotted = with_slots(placed, counted, ["doc_id", "text_crc32"])
    return slotted.select("row", "doc_id", "size", "text_crc32", F.col("shard").cast("int"), "slot")


def place_rows(docs: DataFrame, n_shards: int | None = None, law: str = "bytes", target_bytes: int | None = None) -> DataFrame:
    """All columns of ``docs`` with shard and slot: ``n_shards`` leaves, or as many as leave each
    about ``target_bytes`` (texts and 8 bytes a row)."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    return placed_rows(docs, law, keep, n_shards, target_bytes).select("row.*", "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 24, law: str = "bytes") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near equal
    bytes (``law`` "bytes") or numbers of rows ("rows")."""
    placed = placed_rows(docs, law, ["doc_id"], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
