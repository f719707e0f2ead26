"""Problem 2: pairwise matches consolidated into groups by seed-tree pruning.

Every round, each vertex tells its neighbourhood the smallest vertex it sees. A vertex nobody chose as smallest is
pruned: it leaves the graph for the propagation forest, below the smallest vertex it was told of. The rest goes on
with links between the minima. When no links are left, seeds flow down the forest, from the last pruned to the first.

Vertices are ordered by a hash and not by their ids, so that a chain in id order is no worse than any other graph:
an expected constant share of the vertices is pruned a round. No group of neighbours is ever gathered: minima are
map-side combined aggregates, and the joins salt vertices with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.llm.keys import trimmed_id
from vouchline.operators.skew import hot_keys, salted_join
from vouchline.shared import Staging

#: A round's links number at most about half the last one's in expectation; this only stops a defect.
MOST_ROUNDS = 200


def numbered(links: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """links(left, right: string) -> (vertices(v: bigint, id), edges(u, v: bigint), both directions, distinct).

    A vertex's number is a 64-bit hash of its id. That no two ids share a number is checked, not assumed: with a
    collision another seed is tried.
    """
    pairs = links.filter(F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("left") != F.col("right"))).select("left", "right")
    for seed in range(20):
        number = lambda c, s=seed: F.xxhash64(F.lit(s), F.col(c))
        known = staging.put(pairs.select(number("left").alias("u"), number("right").alias("v"), "left", "right"))
        ends = known.select(F.col("u").alias("v"), F.col("left").alias("id")).unionByName(known.select("v", F.col("right").alias("id")))
        vertices = staging.put(ends.distinct())
        total = vertices.count()
        if total == vertices.agg(F.countDistinct("v")).first()[0]:
            edges = staging.put(known.select("u", "v").unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
            staging.drop(known)
            return vertices, edges
        staging.drop(known, vertices)
    raise RuntimeError("no collision-free numbering of the vertices was found")


def forest(edges: DataFrame, staging: Staging) -> list[DataFrame]:
    """edges(u, v), both directions -> the propagation forest: a table (child, parent) of each round."""
    levels = []
    for _ in range(MOST_ROUNDS):
        total = edges.count()
        if not total:
            return levels
        least = staging.put(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        told = salted_join(edges, least.select("u", "m"), "u", hot_keys(least, "u", total), F.xxhash64("v")).select(F.col("v").alias("x"), "m")
        told = staging.put(told.unionByName(least.select(F.col("u").alias("x"), "m")).distinct())
        staging.drop(edges)
        best = staging.put(told.groupBy("x").agg(F.min("m").alias("low"), F.max((F.col("m") == F.col("x")).cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")))
        levels.append(staging.put(best.filter("kept = 0").select(F.col("x").alias("child"), F.col("low").alias("parent"))))
        several = best.filter("n > 1")
        links = salted_join(told, several.select("x", "low"), "x", hot_keys(best, "x", total), F.xxhash64("m")).filter("m <> low")
        edges = staging.put(links.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(links.select(F.col("low").alias("u"), F.col("m").alias("v"))).distinct())
        staging.drop(told, least, best)
    raise RuntimeError("pruning did not end")


def seeds(levels: list[DataFrame], staging: Staging) -> DataFrame | None:
    """The forest -> (v, seed) of every vertex but the seeds themselves, level by level from the last pruned."""
    labelled = None
    for level in reversed(levels):
        if labelled is None:
            below = level.select(F.col("child").alias("v"), F.col("parent").alias("seed"))
        else:
            total = level.count()
            crowds = level.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
            known = labelled.select(F.col("v").alias("parent"), "seed")
            below = salted_join(level, known, "parent", hot_keys(crowds, "parent", total), F.xxhash64("child"), "left").select(F.col("child").alias("v"), F.coalesce("seed", "parent").alias("seed"))
        below = staging.put(below)
        labelled = below if labelled is None else labelled.unionByName(below)
    return labelled


def connected(links: DataFrame, staging: Staging) -> DataFrame:
    """links(left, right: string) -> (id, group_id): all ids with a link to another, group_id the smallest id reached.

    Null ends and links of an id with itself are no links; repeated ones count once; extra columns are ignored; no
    links give an empty table.
    """
    vertices, edges = numbered(links, staging)
    labelled = seeds(forest(edges, staging), staging)
    if labelled is None:
        return vertices.select("id", F.col("id").alias("group_id"))
    grouped = staging.put(vertices.join(labelled, "v", "left").select("id", F.coalesce("seed", "v").alias("seed")))
    names = staging.put(grouped.groupBy("seed").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")))
    return salted_join(grouped, names.select("seed", "group_id"), "seed", hot_keys(names, "seed", grouped.count()), F.xxhash64("id")).select("id", "group_id")


def matched(duplicates: DataFrame) -> DataFrame:
    """The duplicates table -> links(left, right) of the pairs some row of which has the result 'duplicate'."""
    said = F.regexp_replace(trimmed_id(F.col("result")), r" *\.$", "")
    return duplicates.filter(said == "duplicate").select(trimmed_id(F.col("left")).alias("left"), trimmed_id(F.col("right")).alias("right")).distinct()


def found(duplicates: DataFrame) -> DataFrame:
    """p2_found(record_id, group_id). Unlinked records and groups of one have no row."""
    staging = Staging(duplicates.sparkSession, "components")
    return connected(matched(duplicates), staging).select(F.col("id").alias("record_id"), "group_id")
