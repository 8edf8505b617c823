"""Links of set similarity from posting lists, without all pairs of a group.

What the near-duplicate operators share. Posting lists (key, id) propose pairs:

* short lists (up to ``SHORT`` members) propose their pairs;
* long lists propose each member with the list's centre, the member whose own lists
  are the longest: for a group of edited copies that is a text close to the original;
* after the links found so far are closed to components, a long list whose members
  lie in several components proposes the members outside its largest component with
  all others outside their own. The pairs go through an exact bound inside the join:
  the parity sketches of two sets differ in at most as many bits as the sets differ
  in elements. So hardly a pair leaves the join that does not become a link.

Every proposed pair is verified on the full sets. No pair of a list in different
components goes unexamined, so the components are those of all links of all lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored
from corpusmill.llm.components import connected_components

SHORT = 12
SKETCH_WORDS = 16


def parity_sketch(items: np.ndarray) -> list[int]:
    """1024 bits: whether an odd number of the set's elements falls on each."""
    bits = (items >> np.uint64(20)) & np.uint64(64 * SKETCH_WORDS - 1)
    odd = (np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").tolist()


def may_link(a: str, b: str, percent: int) -> Column:
    """Exact bound: sets of sizes m and n with a Jaccard of t differ in at most
    (1 - t) / (1 + t) * (m + n) elements."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    sizes = 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return sizes & (differ * (100 + percent) <= (100 - percent) * n)


def shared_lists(postings: DataFrame) -> DataFrame:
    """(id, lists, weight): each id's lists with more than one member as (n, key),
    shortest first, and the sum of their lengths."""
    counts = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return (
        postings.join(counts, "key")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists"), F.sum("n").alias("weight"))
    )


def with_centres(postings: DataFrame) -> DataFrame:
    """(key, id, n, centre) for postings (key, id, weight) of lists with more than one member."""
    heads = (
        postings.groupBy("key")
        .agg(F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("id")).alias("low")))["low"].alias("low"))
        .where("n > 1")
    )
    return postings.join(heads, "key").select("key", "id", "n", (-F.col("low")).alias("centre"))


def first_pairs(lists: DataFrame) -> DataFrame:
    """(a, b, collisions) with a < b from short lists and from the centres of long ones."""
    members = F.array_sort(F.collect_list("id"))
    short = (
        lists.where(f"n <= {SHORT}")
        .groupBy("key")
        .agg(members.alias("m"))
        .select(F.posexplode("m").alias("i", "a"), "m")
        .select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    )
    stars = lists.where((F.col("n") > SHORT) & (F.col("id") != F.col("centre"))).select(
        F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")
    )
    return short.unionByName(stars).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("collisions"))


def across_components(lists: DataFrame, components: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """(a, b) of long lists that lie in different components and pass the exact bound."""
    long = (
        lists.where(f"n > {SHORT}")
        .select("key", "id")
        .join(components, "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("component"))
    )
    long = stored(long, "long-lists")
    parts = long.groupBy("key", "component").agg(F.count("*").alias("n"))
    heads = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("largest")).where("parts > 1")
    open_lists = stored(long.join(heads, "key").join(profile, "id").select("key", "id", "component", "largest", "n", "sketch"), "open-lists")
    few = open_lists.where("component <> largest").alias("x")
    every = open_lists.alias("y")
    return (
        few.join(
            every,
            (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", percent),
        )
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard of at least ``percent`` / 100."""
    left = sets.select(F.col("id").alias("a"), F.struct("n", "items").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.struct("n", "items").alias("t"))
    both = F.size(F.array_intersect("s.items", "t.items"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.col("s.n") + F.col("t.n") - both))
        .select("a", "b")
    )


def linked(
    lists: DataFrame, profile: DataFrame, sets: DataFrame, percent: int, min_collisions: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, components) of all pairs that share a list.

    ``lists``: key, id, n, centre. ``profile``: id, n, sketch and whatever
    ``min_collisions`` compares (columns of ``x`` and ``y``). ``sets``: id, n, items,
    for every id that stands in a list. All three are stored tables.
    """
    test = may_link("x", "y", percent)
    if min_collisions is not None:
        test = test & min_collisions
    pairs = (
        first_pairs(lists)
        .select("a", "b")
        .join(profile.alias("x"), F.col("a") == F.col("x.id"))
        .join(profile.alias("y"), F.col("b") == F.col("y.id"))
        .where(test)
        .select("a", "b")
    )
    links = stored(verified(stored(pairs, "pairs"), sets, percent), "links")
    components = stored(connected_components(links), "components")
    more = stored(across_components(lists, components, profile, percent), "pairs")
    more = stored(verified(more, sets, percent), "links")
    if more.isEmpty():
        return links, components
    links = links.unionByName(more)
    return links, stored(connected_components(links), "components")
