"""Problem 1: splits that keep related records together, by random-mate contraction.

Vertices are group keys, edges the pairs of keys that one record names. Each round, a coin (a hash of vertex and
round) makes every vertex a head or a tail; tails next to a head collapse into the smallest such head, by joins, and
edges within a collapsed vertex vanish. When no edge is left, labels are unwound from the last round to the first.
Components then go to the splits by cumulative weight, largest first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.llm.keys import label_key, named_number
from vouchline.operators.skew import hot_keys, running_total, salted_join
from vouchline.shared import Staging, bounded_broadcast

#: The proportions of the splits, in the order in which components are given out.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
MOST_ROUNDS = 400


def contracted(edges: DataFrame, staging: Staging) -> DataFrame:
    """edges(a, b: string) -> (v, root) of every vertex that was collapsed into another."""
    plain = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = staging.put(plain.distinct())
    steps = []
    for turn in range(MOST_ROUNDS):
        total = left.count()
        if not total:
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        head = lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c)) % 2 == 0
        step = staging.put(both.filter(~head("a") & head("b")).groupBy("a").agg(F.min("b").alias("into")))
        steps.append(step)
        for end in ("a", "b"):
            crowds = left.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
            other = "b" if end == "a" else "a"
            moved = salted_join(left, step.withColumnRenamed("a", end), end, hot_keys(crowds, end, total), F.xxhash64(other), "left")
            now = moved.select(F.coalesce("into", end).alias(end), other)
            if end == "b":
                now = now.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            after = staging.put(now)
            staging.drop(left)
            left = after
    else:
        raise RuntimeError("contraction did not end")
    roots = None
    for step in reversed(steps):
        below = step.select(F.col("a").alias("v"), F.col("into").alias("root"))
        if roots is not None:
            crowds = below.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
            known = roots.select(F.col("v").alias("root"), F.col("root").alias("top"))
            below = salted_join(below, known, "root", hot_keys(crowds, "root", below.count()), F.xxhash64("v"), "left").select("v", F.coalesce("top", "root").alias("root"))
        below = staging.put(below)
        roots = below if roots is None else roots.unionByName(below)
    return roots if roots is not None else staging.put(left.select(F.col("a").alias("v"), F.col("b").alias("root")))


def groups(records: DataFrame, staging: Staging) -> DataFrame:
    """records(id, key, other: string) -> (id, key, other, name): name is the smallest key of the record's component.

    A record with one key belongs to it; one with none keeps a null name. Rows may repeat.
    """
    own = F.coalesce("key", "other")
    edges = records.filter("key <> other").groupBy(F.col("key").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    roots = contracted(edges, staging)
    counts = staging.put(records.groupBy(own.alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null"))
    every = counts.select("v").unionByName(records.filter("key <> other").select(F.col("other").alias("v"))).distinct()
    rooted = staging.put(every.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root")))
    sizes = rooted.groupBy("root").agg(F.min("v").alias("name"), F.count(F.lit(1)).alias("n"))
    sizes = staging.put(sizes)
    named = staging.put(salted_join(rooted, sizes.select("root", "name"), "root", hot_keys(sizes, "root", rooted.count()), F.xxhash64("v")).select("v", "name"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(records.withColumn("v", own), named, "v", hot_keys(counts, "v", total), F.xxhash64("id"), "left").drop("v")


def split_of(middle: Column, shares: Mapping[str, float]) -> Column:
    """The split at a place between 0 and 1 of the cumulative weight."""
    total, upto, out = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name] / total
        out = F.when(middle < upto, name) if out is None else out.when(middle < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def assigned(grouped: DataFrame, staging: Staging, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """(id, name) -> (id, name, split). Components are lined up from the heaviest (ties by a hash of the name); each
    takes the split that its middle falls in. A record without a name is a component of its own."""
    one = F.coalesce(F.concat(F.lit("+"), "name"), F.concat(F.lit("-"), F.col("id")))
    records = grouped.select("id", "name", one.alias("component"))
    weights = staging.put(records.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("least", -F.col("n")).withColumn("tie", F.xxhash64("component")))
    placed = running_total(weights, ["least", "tie", "component"], "n", "start", staging)
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    splits = staging.put(placed.select("component", split_of((F.col("start") + F.col("n") / 2) / F.lit(max(total, 1)), shares).alias("split")))
    return salted_join(records, splits, "component", hot_keys(weights, "component", total), F.xxhash64("id")).select("id", "name", "split")


def standard_keys(decisions: DataFrame, former: DataFrame) -> DataFrame:
    """decisions -> distinct (id, written, key, other): the standards named by record.group_key and by standard."""
    labels = former.select(label_key(F.col("former_label")).alias("label"), F.col("as_number").alias("was")).filter("label <> ''").groupBy("label").agg(F.min("was").alias("was"))
    rows = decisions.filter("candidate_id is not null").select(F.col("candidate_id").alias("id"), F.col("record.group_key").alias("written"), F.col("standard").alias("said")).distinct()
    for name, column in (("key", "written"), ("other", "said")):
        label = bounded_broadcast(labels.withColumnRenamed("was", f"{name}_was"), 10_000)
        rows = rows.join(label, label_key(F.col(column)) == F.col("label"), "left").withColumn(name, F.coalesce(named_number(F.col(column)), f"{name}_was")).drop("label", f"{name}_was")
    return rows.select("id", "written", "key", "other")


def _grouped(decisions: DataFrame, former: DataFrame, staging: Staging) -> DataFrame:
    return groups(staging.put(standard_keys(decisions, former)), staging)


def found(decisions: DataFrame, former: DataFrame) -> DataFrame:
    """p1_found(candidate_id, group_standard): decisions whose record.group_key isn't the name of their group.

    A decision that names no standard has no group and no row; null and repeated rows are harmless.
    """
    rows = _grouped(decisions, former, Staging(decisions.sparkSession, "splits"))
    return rows.filter("name is not null and not (written <=> name)").select(F.col("id").alias("candidate_id"), F.col("name").alias("group_standard")).distinct()


def splits(decisions: DataFrame, former: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """(candidate_id, group_standard, split) of every decision; one that names no standard is a group of its own."""
    staging = Staging(decisions.sparkSession, "splits")
    rows = _grouped(decisions, former, staging)
    once = staging.put(rows.groupBy("id").agg(F.min("name").alias("name")))
    return assigned(once, staging, shares).select(F.col("id").alias("candidate_id"), F.col("name").alias("group_standard"), "split")


def report(decisions: DataFrame, former: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """(split, target_share, decisions, actual_share, groups, largest_group) of every split, also of one that got nothing:
    a group larger than a split's share moves the shares, and here it shows."""
    rows = splits(decisions, former, shares)
    per = rows.groupBy("split", F.coalesce("group_standard", "candidate_id").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    got = per.groupBy("split").agg(F.sum("n").alias("decisions"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest_group"))
    total = sum(shares.values()) or 1
    wanted = rows.sparkSession.createDataFrame([(name, share / total) for name, share in shares.items()], "split string, target_share double")
    filled = wanted.join(F.broadcast(got), "split", "left").na.fill(0, ["decisions", "groups", "largest_group"])
    share = F.coalesce(F.try_divide(F.col("decisions"), F.sum("decisions").over(W.partitionBy())), F.lit(0.0))
    return filled.select("split", "target_share", "decisions", share.alias("actual_share"), "groups", "largest_group")
