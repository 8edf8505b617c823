"""Near-duplicate vectors by randomly rotated binary codes.

* Rows with the same direction are one node (a digest of the unit vector). Each node gets the
  signs of its coordinates under several random rotations, and per rotation the factor that
  corrects the code: its inner product with the vector. A code over its factor is an
  unbiased estimate of the vector, so the product of two, from different rotations, is an
  unbiased estimate of the cosine, with a known spread.
* Bands of the code are the buckets in which pairs meet. Their width follows the number of
  nodes, their number the recall asked for at the threshold itself (nearer pairs meet more
  surely). Only codes and factors go to the buckets. A pair is taken up in the first bucket
  that it shares, and only if the threshold lies within ``SURE`` spreads of its estimate; then the
  cosine is computed from the full vectors, in doubles, and decides.
* Groups of copies: where many nodes meet, those within half the threshold's angle of a common
  centre form a ball. All pairs of a ball are links, by the triangle inequality, and are only
  counted; towards others a ball stands as one item with a radius. A pair of items is
  settled by the angle of the centres and the radii, and opened only where these leave
  it undecided. So a group of near copies costs its size, not its square.
* A bucket with more than ``LIGHT`` items is cut into blocks; every pair of blocks is a unit of its
  own, with full vectors, that returns counts and a spanning forest instead of pairs. Its work
  is the square of what is left there: vectors close to each other that no ball holds.

Defined cases: null, empty and zero vectors and those with a null or non-finite component link
with nothing and keep themselves; vectors of different lengths don't link; repeated rows are
linked with each other and counted as others; a row with a null ``vec_id`` counts as a link
of others but names no component (null) and is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, stored
from corpusmill.llm.components import connected_components

#: Spreads of the estimate within which a pair is computed exactly.
SURE = 5.0
#: Items of a bucket whose pairs are proposed one by one; rows of a block of larger buckets.
LIGHT, BLOCK = 256, 1024
#: Nodes in a bucket from which a ball is tried, bands that are looked at for it, members that make a centre.
CROWD, BALL_BANDS, CENTRE = 32, 4, 64
#: Radians by which bounds are kept clear of rounding.
ROOM = 1e-6


@dataclass(frozen=True)
class Codes:
    """How vectors of a table are coded: threshold, bits a band, bands."""

    threshold: float
    bits: int
    bands: int
    seed: int = 11

    @classmethod
    def plan(cls, nodes: int, threshold: float, recall: float) -> Codes:
        bits = min(40, max(8, math.ceil(math.log2(max(2, nodes))) - 2))
        same = 1 - math.acos(threshold) / math.pi
        return cls(threshold, bits, min(127, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))))

    def rotations(self, dim: int) -> np.ndarray:
        count = max(2, -(-self.bits * self.bands // dim))
        rng = np.random.default_rng(self.seed)
        return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs and one factor a rotation, for rows of one length."""
        turned = np.einsum("rij,nj->nri", self.rotations(units.shape[1]), units)
        factors = np.abs(turned).sum(axis=2) / math.sqrt(units.shape[1])
        return np.packbits((turned > 0).reshape(len(units), -1), axis=1), factors.astype(np.float32)

    def keys(self, codes: np.ndarray, dim: int) -> np.ndarray:
        """One key a band: band, length and bits."""
        bits = np.unpackbits(codes, axis=1, count=self.bits * self.bands).reshape(len(codes), self.bands, self.bits)
        value = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        return value | np.int64((dim & 0xFFFF) << 40) | (np.arange(self.bands, dtype=np.int64) << 56)

    def decode(self, codes: np.ndarray, factors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two unbiased estimates of each vector from different rotations, and the
        square of the larger one's error across the vector."""
        turns = self.rotations(dim)
        signs = np.unpackbits(codes, axis=1, count=len(turns) * dim).reshape(len(codes), len(turns), dim) * 2.0 - 1.0
        half = len(turns) // 2
        parts, spread = [], []
        for own in (slice(0, half), slice(half, None)):
            weighed = signs[:, own] / (math.sqrt(dim) * factors[:, own, None])
            parts.append((np.einsum("nri,rij->nj", weighed, turns[own]) / weighed.shape[1]).astype(np.float32))
            spread.append((1 / factors[:, own].astype(float) ** 2 - 1).mean(axis=1) / weighed.shape[1])
        return parts[0], parts[1], np.maximum(*spread)


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in doubles; none for rows that link with nothing."""
    out: list[np.ndarray | None] = []
    for row in column.to_pylist():
        x = None if not row or None in row else np.array(row, float)
        if x is not None and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            out.append(x / math.sqrt(x @ x) + 0.0)
        else:
            out.append(None)
    return out


def directions(vectors: DataFrame, full: bool) -> DataFrame:
    """(vec_id, digest[, dim, unit]): the digest tells directions apart and is null for unusable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(batch.column(1))
            raw = [None if u is None else u.tobytes() for u in units]
            columns = [batch.column(0), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary())]
            if full:
                columns += [pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "digest", "dim", "unit"][: len(columns)])

    schema = "vec_id long, digest binary" + ", dim int, unit binary" * full
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, schema)


def binary_rows(column: pa.Array, kind: type, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Rows of equal length as a matrix."""
    values = column.to_numpy(zero_copy_only=False)[rows]
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def lengths(batch: pa.RecordBatch, name: str = "dim") -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column(name).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def coded(nodes: DataFrame, plan: Codes, keyed: bool = True) -> DataFrame:
    """``nodes`` (dim, unit and others) with code, factors and the keys of their bands."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in nodes.schema)}, code binary, factors binary" + ", keys array<long>" * keyed
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for dim, rows in lengths(part):
                    own = part.take(pa.array(rows))
                    codes, factors = plan.encode(binary_rows(own.column("unit"), float))
                    more = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([f.tobytes() for f in factors], pa.binary())]
                    if keyed:
                        more.append(pa.array(list(plan.keys(codes, dim)), pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([*own.columns, *more], names=names)

    return nodes.mapInArrow(run, schema)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors, row by row, accurate for small ones."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(axis=1)) / 2))


def with_angle(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """``keep`` and the angle and cosine of the vectors in the columns ``a`` and ``b``."""
    schema = ", ".join([*(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep), "angle double, cosine double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle, cosine = np.empty(batch.num_rows), np.empty(batch.num_rows)
            for _, rows in lengths(batch):
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    x, y = binary_rows(batch.column(a), float, part), binary_rows(batch.column(b), float, part)
                    angle[part], cosine[part] = angles(x, y), np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(angle), pa.array(cosine)], names=[*keep, "angle", "cosine"])

    return pairs.select(*keep, a, b, *([] if "dim" in keep else ["dim"])).mapInArrow(run, schema)


def means(samples: DataFrame) -> DataFrame:
    """(key, dim, centre) of (key, dim, units), the unit vectors of a few members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres = []
            for units in batch.column(2).to_pylist():
                mean = np.mean([np.frombuffer(u, float) for u in units], axis=0)
                size = math.sqrt(mean @ mean)
                centres.append((mean / size).tobytes() if size > 0 else units[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(centres, pa.binary())], names=["key", "dim", "centre"])

    return samples.mapInArrow(run, "key long, dim int, centre binary")


def balls_of(nodes: DataFrame, plan: Codes) -> DataFrame:
    """(node, ball, dim, centre, alpha): members of balls and their angle to the centre, at
    most half the threshold's; ``ball`` is the least node of it."""
    keys = nodes.select("node", "mult", F.explode(F.slice("keys", 1, min(BALL_BANDS, plan.bands))).alias("key"))
    crowded = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD), "crowded")
    meet = keys.join(crowded, "key")
    few = meet.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node")))).where(F.col("i") <= CENTRE)
    samples = few.select("key", "node").join(nodes.select("node", "dim", "unit"), "node").groupBy("key", "dim").agg(F.collect_list("unit").alias("units"))
    centres = stored(means(samples), "centres")
    near = meet.join(nodes.select("node", "unit"), "node").join(centres, "key")
    place = F.struct("n", "key", F.col("angle").alias("alpha"))
    half = math.acos(plan.threshold) / 2 - ROOM
    chosen = stored(with_angle(near, "unit", "centre", ["node", "mult", "key", "n", "dim"]).where(F.col("angle") <= half).groupBy("node").agg(F.max(place).alias("c")).select("node", "c.key", "c.alpha"), "chosen")
    balls = chosen.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("ball")).where("n > 1")
    return stored(chosen.join(balls.select("key", "ball"), "key").join(centres, "key").select("node", "ball", "dim", "centre", "alpha"), "balls")


PAIRS = "a long, b long, open boolean, n long"


def met(units: DataFrame, plan: Codes) -> DataFrame:
    """Pairs of items that meet in a bucket, from rows (key, lo, hi, block, item, radius, mult, dim, code,
    factors, unit) sorted by (key, lo, hi).

    Single nodes: (a, b, false, null) is a pair to be computed from light buckets; from
    others, which carry full vectors, (a, null, false, n) counts links and (a, b, false, 0) is an edge. Items
    with a radius: (a, b, true, null) is a pair that the estimate can't dismiss."""
    theta = math.acos(plan.threshold)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole units, many at a time."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 8192:
                table = pa.Table.from_batches(held).combine_chunks()
                marks = np.stack([table.column(i).to_numpy() for i in range(3)])
                cut = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))
                if len(cut):
                    yield table.slice(0, int(cut[-1]) + 1)
                    held = table.slice(int(cut[-1]) + 1).to_batches()
                    rows = sum(b.num_rows for b in held)
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            for part in table.to_batches():
                out = list(found(part))
                if out:
                    a, b, opened, n = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(opened), pa.array(n, mask=n < 0)], names=["a", "b", "open", "n"])

    def rows_of(a, b, opened, n):
        return np.asarray(a, np.int64), np.asarray(b, np.int64), np.full(len(a), opened), np.broadcast_to(np.asarray(n, np.int64), (len(a),))

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        key, lo, hi, block, item, radius, mult, dims = (batch.column(i).to_numpy() for i in range(8))
        for dim, rows in lengths(batch):
            codes = binary_rows(batch.column("code"), np.uint8, rows)
            first, second, spread = plan.decode(codes, binary_rows(batch.column("factors"), np.float32, rows), dim)
            keys = plan.keys(codes, dim)
            own = [c[rows] for c in (key, lo, hi, block, item, radius, mult)]
            starts = np.flatnonzero(np.r_[True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1])])
            full = batch.column("unit").is_valid().to_numpy(zero_copy_only=False)[rows]
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(rows)).tolist(), strict=True):
                if e - s > 1:
                    span = slice(s, e)
                    units = binary_rows(batch.column("unit"), float, rows[span]) if full[s] else None
                    yield from one([c[span] for c in own], first[span], second[span], spread[span], keys[span], units, dim)

    def one(own: list[np.ndarray], first: np.ndarray, second: np.ndarray, spread: np.ndarray, keys: np.ndarray, units: np.ndarray | None, dim: int) -> Iterator[tuple[np.ndarray, ...]]:
        key, lo, hi, block, item, radius, mult = own
        estimate = (first @ second.T + second @ first.T) / 2
        reach = np.cos(np.minimum(np.pi, theta + radius[:, None] + radius[None] + ROOM))
        error = ((spread[:, None] + spread[None]) * (1 - reach**2) + spread[:, None] * spread[None]) / max(1, dim - 1)
        near = np.triu(np.ones_like(estimate, bool), 1) if lo[0] == hi[0] else (block[:, None] == lo[0]) & (block[None] == hi[0])
        if dim >= 8:  # the spread is a normal one from some components on
            near &= estimate >= reach - SURE * np.sqrt(error)
        i, j = np.nonzero(near)
        ball = (radius[i] > 0) | (radius[j] > 0)
        if ball.any():
            a, b = item[i[ball]], item[j[ball]]
            yield rows_of(np.minimum(a, b), np.maximum(a, b), True, -1)
        i, j = i[~ball], j[~ball]
        first_met = np.concatenate([(keys[i[at : at + 4096]] == keys[j[at : at + 4096]]).argmax(axis=1) for at in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
        here = first_met == key[0] >> 56
        i, j = i[here], j[here]
        if units is None:
            if len(i):
                yield rows_of(np.minimum(item[i], item[j]), np.maximum(item[i], item[j]), False, -1)
            return
        cosine = np.concatenate([np.einsum("ij,ij->i", units[i[at : at + 4096]], units[j[at : at + 4096]]) for at in range(0, len(i), 4096)] or [np.zeros(0)])
        i, j = i[cosine >= plan.threshold], j[cosine >= plan.threshold]
        if len(i):
            n = np.bincount(i, mult[j], len(item)).astype(np.int64) + np.bincount(j, mult[i], len(item)).astype(np.int64)
            linked = np.flatnonzero(n)
            yield rows_of(item[linked], np.full(len(linked), -1), False, n[linked])
            label = np.arange(len(item))
            while True:
                before = label.copy()
                np.minimum.at(label, i, label[j])
                np.minimum.at(label, j, label[i])
                label = label[label]
                if (label == before).all():
                    break
            edge = np.flatnonzero(label != np.arange(len(item)))
            yield rows_of(item[edge], item[label[edge]], False, 0)

    return units.mapInArrow(run, PAIRS)


def bucket_units(nodes: DataFrame, balls: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of buckets with more than one item, large ones dealt to pairs of blocks."""
    keyed = nodes.select("node", F.explode("keys").alias("key")).join(balls.select("node", "ball"), "node", "left")
    postings = keyed.select("key", F.coalesce("ball", "node").alias("item")).distinct()
    counts = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    payload = items.select("item", "radius", "mult", "dim", "code", "factors", "unit")
    several = stored(postings.join(counts, "key"), "buckets")
    light = several.where(F.col("n") <= LIGHT).join(payload, "item").withColumn("unit", F.lit(None).cast("binary")).selectExpr("*", "0 lo", "0 hi", "0 block")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    heavy = (
        several.where(F.col("n") > LIGHT)
        .withColumn("block", F.pmod(F.xxhash64("item"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .join(payload, "item")
    )
    columns = ["key", "lo", "hi", "block", "item", "radius", "mult", "dim", "code", "factors", "unit"]
    every = light.select(columns).unionByName(heavy.select(columns))
    return every.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


@dataclass(frozen=True)
class Settled:
    """Links between items with a radius: (node, n) counts and (a, b) edges."""

    counts: DataFrame
    edges: DataFrame


def settle(opened: DataFrame, items: DataFrame, members: DataFrame, theta: float, threshold: float) -> Settled:
    """Decide pairs of items by centres and radii, then members against the other centre, then
    members against members. ``members``: item, node, mult, dim, unit."""
    side = lambda s: items.select(F.col("item").alias(s), F.col("unit").alias(f"unit_{s}"), F.col("radius").alias(f"radius_{s}"), F.col("weight").alias(f"weight_{s}"))
    pairs = opened.join(side("a"), "a").join(side("b").join(items.select(F.col("item").alias("b"), "dim"), "b"), "b")
    keep = ["a", "b", "radius_a", "radius_b", "weight_a", "weight_b"]
    judged = stored(with_angle(pairs, "unit_a", "unit_b", keep), "item-angles")
    reach = F.col("radius_a") + F.col("radius_b")
    whole = judged.where(F.col("angle") + reach <= theta - ROOM)
    undecided = judged.where((F.col("angle") + reach > theta - ROOM) & (F.col("angle") - reach <= theta + ROOM))
    x = members.select(F.col("item").alias("a"), F.col("node").alias("x"), F.col("mult").alias("mult_x"), "dim", F.col("unit").alias("unit_x"))
    ahead = undecided.select("a", "b", "radius_b", "weight_b").join(x, "a").join(side("b").select("b", "unit_b"), "b")
    one = stored(with_angle(ahead, "unit_x", "unit_b", ["x", "mult_x", "b", "radius_b", "weight_b"]), "member-angles")
    certain = one.where(F.col("angle") + F.col("radius_b") <= theta - ROOM)
    last = one.where((F.col("angle") + F.col("radius_b") > theta - ROOM) & (F.col("angle") - F.col("radius_b") <= theta + ROOM)).select("x", "mult_x", "b")
    y = members.select(F.col("item").alias("b"), F.col("node").alias("y"), F.col("mult").alias("mult_y"), "dim", F.col("unit").alias("unit_y"))
    full = last.join(y, "b").join(members.select(F.col("node").alias("x"), F.col("unit").alias("unit_x")), "x")
    exact = stored(with_angle(full, "unit_x", "unit_y", ["x", "y", "mult_x", "mult_y"]).where(F.col("cosine") >= threshold).select("x", "y", "mult_x", "mult_y"), "member-links")
    belongs = lambda s: members.select(F.col("item").alias(s), "node")
    gained = whole.groupBy("a").agg(F.sum("weight_b").alias("n")).withColumnRenamed("a", "item").unionByName(whole.groupBy("b").agg(F.sum("weight_a").alias("n")).withColumnRenamed("b", "item"))
    counts = gained.join(members.select("item", "node"), "item").select("node", "n")
    counts = counts.unionByName(certain.select(F.col("x").alias("node"), F.col("weight_b").alias("n")))
    counts = counts.unionByName(certain.groupBy("b").agg(F.sum("mult_x").alias("n")).join(belongs("b"), "b").select("node", "n"))
    counts = counts.unionByName(exact.select(F.col("x").alias("node"), F.col("mult_y").alias("n"))).unionByName(exact.select(F.col("y").alias("node"), F.col("mult_x").alias("n")))
    edges = whole.select("a", "b").unionByName(certain.select(F.col("x").alias("a"), "b")).unionByName(exact.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return Settled(counts, edges)


def vector_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding).

    A pair at the threshold itself is found with probability ``recall``, nearer ones more surely;
    none below the threshold is linked."""
    classes = directions(vectors, True).where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "directions")
    plan = Codes.plan(classes.count(), threshold, recall)
    nodes = stored(coded(classes.select("node", "mult", "dim", "unit"), plan), "codes")
    theta = math.acos(threshold)

    balls = balls_of(nodes, plan)
    shapes = balls.join(nodes.select("node", "mult"), "node").groupBy("ball").agg(F.max("alpha").alias("radius"), F.sum("mult").alias("weight"), F.first("dim").alias("dim"), F.first("centre").alias("unit"))
    shapes = coded(shapes.select(F.col("ball").alias("item"), F.greatest("radius", F.lit(ROOM)).alias("radius"), F.col("weight").alias("mult"), "dim", "unit"), plan, keyed=False)
    single = nodes.join(balls.select("node"), "node", "left_anti")
    items = single.select(F.col("node").alias("item"), F.lit(0.0).alias("radius"), "mult", "dim", "unit", "code", "factors").unionByName(shapes)
    items = stored(items.withColumn("weight", F.col("mult")), "items")
    members = nodes.select("node", "mult", "dim", "unit").join(balls.select("node", "ball"), "node", "left").withColumn("item", F.coalesce("ball", "node")).drop("ball")

    pairs = stored(met(bucket_units(nodes, balls, items), plan), "met")
    settled = settle(pairs.where("open").select("a", "b").distinct(), items, members, theta, threshold)
    a = nodes.select(F.col("node").alias("a"), F.col("mult").alias("mult_a"), "dim", F.col("unit").alias("unit_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("mult").alias("mult_b"), F.col("unit").alias("unit_b"))
    asked = pairs.where("NOT open AND n IS NULL").select("a", "b").join(a, "a").join(b, "b")
    links = stored(with_angle(asked, "unit_a", "unit_b", ["a", "b", "mult_a", "mult_b"]).where(F.col("cosine") >= threshold), "links")

    counts = settled.counts.unionByName(pairs.where("b IS NULL").select(F.col("a").alias("node"), "n"))
    counts = counts.unionByName(links.select(F.col("a").alias("node"), F.col("mult_b").alias("n"))).unionByName(links.select(F.col("b").alias("node"), F.col("mult_a").alias("n")))
    inside = balls.select("node", "ball").join(items.select(F.col("item").alias("ball"), "weight"), "ball").join(nodes.select("node", "mult"), "node")
    counts = counts.unionByName(inside.select("node", (F.col("weight") - F.col("mult")).alias("n")))
    edges = links.select("a", "b").unionByName(pairs.where("n = 0").select("a", "b")).unionByName(settled.edges).unionByName(balls.select(F.col("node").alias("a"), F.col("ball").alias("b")))
    components = connected_components(edges).withColumnRenamed("id", "node")

    total = counts.groupBy("node").agg(F.sum("n").alias("links"))
    placed = classes.select("node", "digest", "mult", "least").join(components, "node", "left").join(total, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed.withColumn("n_links", F.col("mult") - 1 + F.coalesce("links", F.lit(0))), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = placed.select("digest", "n_links", "component").join(least, "component").drop("component")
    discard(nodes, items, pairs)
    rows = directions(vectors, False).join(judged, "digest", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


LINKS_SQL = """
WITH RECURSIVE kept AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT row, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM kept WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.row AS a, b.row AS b FROM good a JOIN good b ON a.row <> b.row AND len(a.v) = len(b.v) AND a.size > 0 AND b.size > 0 AND list_inner_product(a.v, b.v) >= 0.95 * a.size * b.size),
reach AS (SELECT row AS a, row AS b FROM kept UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS row, min(k.vec_id) AS least FROM reach r JOIN kept k ON r.b = k.row GROUP BY r.a),
counts AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT k.vec_id, coalesce(n, 0)::BIGINT AS n_links, CASE WHEN k.vec_id IS NOT NULL THEN least END AS component_id, coalesce(k.vec_id = least, true) AS kept
FROM kept k JOIN least USING (row) LEFT JOIN counts USING (row)
"""
