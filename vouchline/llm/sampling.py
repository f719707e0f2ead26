"""Problem 3: samples that match target proportions, by controlled rounding and random-key quotas.

A decision may be in several categories of a plan. Decisions are counted by kind, that is by plan, the categories they are
in and a second trait (the task type, or the standard's series where the targets fix the task type). The wanted amounts
are spread over the kinds, the scarcest category first and in proportion to what is left; what that leaves wanting is
found along augmenting paths, which hand decisions on from category to category, so that a category goes short only if no
division of the decisions could serve it. The amounts form a fractional two-way table of categories by trait; a maximum
flow rounds every cell, row and column sum and the total to a neighbouring integer and stays within each kind's supply.
The decisions of a kind, in the order of random keys, then fill the kind's quotas one after the other.

Only counts by kind come to the driver, and their number depends on the targets alone.
"""

from __future__ import annotations

from collections import defaultdict, deque
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.llm.keys import label_key, named_number, slug
from vouchline.shared import Staging, bounded_broadcast

# The task types of a record.
TASKS = ("direct_requirement", "definition", "condition", "exception", "relationship", "distinction", "multi_paragraph_synthesis", "application", "scenario", "citation_lookup")
MALFORMED = "malformed"
#: The targets are a hand-written table; a longer one is refused rather than collected.
MOST_TARGETS = 10_000
#: Ranges of the random key that are counted by cell; only the range that the quota ends in is ranked row by row.
RANGES = 4096
SEED = 42


class _Flow:
    """A maximum flow with lower bounds on a small graph, by shortest augmenting paths."""

    def __init__(self) -> None:
        self.room: dict[str | tuple, dict[str | tuple, int]] = defaultdict(lambda: defaultdict(int))
        self.owed: dict[str | tuple, int] = defaultdict(int)

    def edge(self, a: str | tuple, b: str | tuple, low: int, high: int) -> None:
        self.room[a][b] += high - low
        self.room[b][a] += 0
        self.owed[a] -= low
        self.owed[b] += low

    def solve(self) -> bool:
        """Fills the graph; true if every bound can be met. Circulation: the sink must be joined to the source."""
        need = 0
        for node, n in list(self.owed.items()):
            if n > 0:
                self.room["+"][node] += n
                self.room[node]["+"] += 0
                need += n
            elif n < 0:
                self.room[node]["-"] += -n
                self.room["-"][node] += 0
        while True:
            came, queue = {"+": None}, deque(["+"])
            while queue and "-" not in came:
                at = queue.popleft()
                for to, room in self.room[at].items():
                    if room > 0 and to not in came:
                        came[to] = at
                        queue.append(to)
            if "-" not in came:
                return need == 0
            path, at = [], "-"
            while came[at] is not None:
                path.append((came[at], at))
                at = came[at]
            n = min(self.room[a][b] for a, b in path)
            for a, b in path:
                self.room[a][b] -= n
                self.room[b][a] += n
            need -= n


def rounded(table: dict[tuple, float], supply: dict | None = None) -> dict[tuple, int]:
    """{(row, column) or (row, column, kind): quota} -> integers: each entry, cell, row sum, column sum and the total next to
    its own fraction, the total the nearest integer, and no kind of a column above its supply, {(column, kind): n}. Such
    a table always exists, since the fractions themselves are a flow."""
    near = lambda x: (floor(x + 1e-9), ceil(x - 1e-9))
    rows, columns, cells, flow = defaultdict(float), defaultdict(float), defaultdict(float), _Flow()
    supply = supply or {}
    entries = {key: (("cell", key[0], key[1]), ("kind", *key[1:])) for key in table}
    for (i, j, *kind), x in table.items():
        rows[i] += x
        columns[j] += x
        cells[i, j] += x
        flow.edge(*entries[i, j, *kind], *near(x))
    for (i, j), x in cells.items():
        flow.edge(("row", i), ("cell", i, j), *near(x))
    for kind in {k for _, k in entries.values()}:
        flow.edge(kind, ("column", kind[1]), 0, supply.get(kind[1:], 1 << 62))
    for i, x in rows.items():
        flow.edge("source", ("row", i), *near(x))
    for j, x in columns.items():
        flow.edge(("column", j), "sink", *near(x))
    total = sum(table.values())
    low, high = near(total)
    aim = min(max(floor(total + 0.5), low), high)
    flow.edge("sink", "source", aim, aim)
    if not flow.solve():
        raise ValueError("no controlled rounding")
    return {key: high - flow.room[a][b] for key, (a, b) in entries.items() for high in (near(table[key])[1],)}


def shared_out(supply: dict, asked: dict[int, float]) -> dict[tuple, float]:
    """supply {kind: n}, a kind ending in the tuple of the categories that may take from it, and asked {category: amount} ->
    {(category, kind): amount}. No kind gives more than it has, and all categories together get as much as any division
    could give them."""
    has = defaultdict(list)
    for kind in supply:
        for target in kind[-1]:
            has[target].append(kind)
    left, out, missing = {k: float(n) for k, n in supply.items()}, defaultdict(float), {}
    plenty = {t: sum(supply[k] for k in has[t]) / max(asked[t], 1e-9) for t in asked}
    for target in sorted(asked, key=lambda t: (plenty[t], t)):
        free = sum(left[k] for k in has[target])
        take = min(asked[target], free)
        for kind in has[target] if free > 0 else ():
            given = min(left[kind], take * left[kind] / free)
            out[target, kind] += given
            left[kind] -= given
        missing[target] = asked[target] - take
    for target in sorted(asked):
        while missing[target] > 1e-9:
            came, queue, end = {}, deque([target]), None
            seen = {target}
            while queue and end is None:
                taker = queue.popleft()
                for kind in has[taker]:
                    if kind in came:
                        continue
                    came[kind] = taker
                    if left[kind] > 1e-9:
                        end = kind
                        break
                    for giver in kind[-1]:
                        if giver not in seen and out[giver, kind] > 1e-9:
                            seen.add(giver)
                            came["from", giver] = kind
                            queue.append(giver)
            if end is None:
                break
            steps, kind, n = [], end, min(missing[target], left[end])
            while True:
                taker = came[kind]
                steps.append((taker, kind, 1))
                if taker == target:
                    break
                kind = came["from", taker]
                steps.append((taker, kind, -1))
                n = min(n, out[taker, kind])
            for taker, kind, sign in steps:
                out[taker, kind] += sign * n
            left[end] -= n
            missing[target] -= n
    return {key: n for key, n in out.items() if n > 1e-9}


class Sample:
    """The memberships of the decisions, the quotas and the report of every plan."""

    def __init__(self, decisions: DataFrame, targets: DataFrame, former: DataFrame, seed: int = SEED) -> None:
        self.spark, self.seed = decisions.sparkSession, seed
        self.staging = Staging(self.spark, "sampling")
        wanted = targets.filter("target_id is not null").select("target_id", "plan_id", F.coalesce(named_number(F.col("standard")), slug(F.col("standard"))).alias("standard"), slug(F.col("task_type")).alias("task"), slug(F.col("reason")).alias("reason"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_rows", F.lit(0)).alias("least"), F.coalesce("sample_fraction", F.lit(0.0)).alias("fraction"))
        self.targets = wanted.limit(MOST_TARGETS + 1).collect()
        if len(self.targets) > MOST_TARGETS:
            raise ValueError("too many targets")
        self.facts = self.staging.put(self._facts(decisions, former))
        self.total = self.facts.select("id").distinct().count()
        self.members = self.staging.put(self._members(wanted.schema))
        self._quotas()

    def _facts(self, decisions: DataFrame, former: DataFrame) -> DataFrame:
        """(id, standard, task, reasons, trait by task, series), distinct: copies of a decision collapse."""
        labels = former.select(label_key(F.col("former_label")).alias("label"), F.col("as_number").alias("was")).filter("label <> ''").groupBy("label").agg(F.min("was").alias("was"))
        rows = decisions.filter("candidate_id is not null").select(
            F.col("candidate_id").alias("id"),
            F.col("standard").alias("said"),
            F.when(F.col("record").isNull(), MALFORMED).otherwise(slug(F.col("record.task_type"))).alias("task"),
            F.array_sort(F.array_distinct(F.transform(F.coalesce("reasons", F.array().cast("array<string>")), slug))).alias("reasons"),
        ).distinct()
        rows = rows.join(bounded_broadcast(labels, 10_000), label_key(F.col("said")) == F.col("label"), "left")
        return rows.select("id", F.coalesce(named_number(F.col("said")), "was").alias("standard"), "task", "reasons")

    def _members(self, schema: object) -> DataFrame:
        """(id, plan_id, targets, trait), a row for each decision and plan with the categories that it is in."""
        shapes = defaultdict(list)
        for t in self.targets:
            shapes[tuple(c for c in ("standard", "task", "reason") if t[c] is not None)].append(t)
        out = None
        for shape, some in shapes.items():
            listed = F.broadcast(self.spark.createDataFrame(some, schema).select("target_id", "plan_id", *[F.col(c).alias(f"t_{c}") for c in shape]))
            rows = self.facts.withColumn("reason", F.explode("reasons")) if "reason" in shape else self.facts
            if shape:
                rows = rows.join(listed, [F.col(c) == F.col(f"t_{c}") for c in shape])
            else:
                rows = rows.withColumn("t", F.explode(F.array(*[F.struct(F.lit(t["target_id"]).alias("target_id"), F.lit(t["plan_id"]).alias("plan_id")) for t in some]))).select("*", "t.*")
            rows = rows.select("id", "target_id", "plan_id", "task", "standard")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "id string, plan_id int, targets array<int>, trait string")
        by_task = sorted({t["plan_id"] for t in self.targets if t["task"] is None and t["plan_id"] is not None})
        each = out.groupBy("id", "plan_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"), F.min("task").alias("task"), F.min("standard").alias("standard"))
        task = F.when(F.col("task").isin(*TASKS, MALFORMED), F.col("task")).otherwise("other")
        series = F.coalesce(F.substring("standard", 4, 1), F.lit("none"))
        return each.select("id", "plan_id", "targets", F.when(F.col("plan_id").isin(by_task), task).otherwise(series).alias("trait"))

    def needed(self, t: object) -> float:
        return t["share"] * t["fraction"] * self.total

    def is_short(self, t: object) -> bool:
        have = self.available[t["target_id"]]
        return have < t["least"] or have < self.needed(t)

    def _quotas(self) -> None:
        """The kinds with their counts, and how many decisions each category takes of each."""
        rows = self.members.groupBy("plan_id", "targets", "trait").agg(F.count(F.lit(1)).alias("n")).orderBy("plan_id", "targets", "trait").collect()
        kinds = {(r["plan_id"], r["trait"], tuple(r["targets"])): r["n"] for r in rows}
        self.available: dict[int, int] = defaultdict(int)
        for (_, _, listed), n in kinds.items():
            for target in listed:
                self.available[target] += n
        asked = defaultdict(dict)
        for t in self.targets:
            asked[t["plan_id"]][t["target_id"]] = max(float(t["least"]), self.needed(t))
        self.quota: dict[tuple, int] = {}
        for plan, wanted in asked.items():
            supply = {kind: n for kind, n in kinds.items() if kind[0] == plan}
            amounts = shared_out(supply, wanted)
            table = {(target, kind[1], kind[2]): n for (target, kind), n in amounts.items()}
            whole = rounded(table, {(kind[1], kind[2]): n for kind, n in supply.items()}) if table else {}
            self.quota |= {(target, (plan, trait, listed)): n for (target, trait, listed), n in whole.items() if n > 0}

    def report(self) -> DataFrame:
        """A row a target: what there is, what it asks for, its quota, its share of the plan's sample; ``short``, whether its
        own category has too few decisions, and ``unmet``, whether its quota stays below what it asks for, for that or any
        other reason; what the plan asks for and reaches."""
        given, sizes = defaultdict(int), defaultdict(int)
        for (target, kind), n in self.quota.items():
            given[target] += n
            sizes[kind[0]] += n
        rows = []
        for t in self.targets:
            target, size = t["target_id"], sizes[t["plan_id"]]
            unmet = given[target] < floor(max(t["least"], self.needed(t)) + 1e-9)
            rows.append((target, t["plan_id"], self.available[target], float(self.needed(t)), t["least"], given[target], t["share"], given[target] / size if size else 0.0, self.is_short(t), unmet, float(t["fraction"] * self.total), size))
        return self.spark.createDataFrame(rows, "target_id int, plan_id int, available bigint, needed double, min_rows int, quota bigint, target_share double, actual_share double, short boolean, unmet boolean, plan_wanted double, plan_reached bigint")

    def plans(self) -> DataFrame:
        """A row a plan: the size that it wants and reaches, its targets and how many are short or unmet, and how far a
        target's share of what is reached is off at most."""
        off = F.abs(F.col("actual_share") - F.col("target_share"))
        counts = [F.count_if(F.col(c)).alias(c) for c in ("short", "unmet")]
        return self.report().groupBy("plan_id").agg(F.max("plan_wanted").alias("wanted"), F.max("plan_reached").alias("reached"), F.count(F.lit(1)).alias("targets"), *counts, F.max(off).alias("share_off"))

    def rows(self) -> DataFrame:
        """(plan_id, target_id, candidate_id): of each kind, in the order of the random keys, the first for its first
        category, the next for its second, up to their quotas. Keys are counted by range; only the ranges in which a quota
        ends are ranked row by row."""
        parts = defaultdict(list)
        for (target, kind), n in sorted(self.quota.items()):
            low = parts[kind][-1][2] if parts[kind] else 0
            parts[kind].append((target, low, low + n))
        named = [(i, plan, trait, list(listed)) for i, (plan, trait, listed) in enumerate(parts)]
        # As many rows as there are kinds and quotas, which the targets bound.
        kinds = F.broadcast(self.spark.createDataFrame(named, "kind int, plan_id int, trait string, targets array<int>"))
        ends = self.spark.createDataFrame([(i, *part) for i, kind in enumerate(parts) for part in parts[kind]], "kind int, target int, low bigint, high bigint")
        key = F.xxhash64(F.lit(self.seed), "plan_id", "id")
        keyed = self.members.join(kinds, ["plan_id", "trait", "targets"]).select("id", "plan_id", "kind", key.alias("key"))
        keyed = self.staging.put(keyed.withColumn("range", (F.shiftright("key", ((1 << 64) // RANGES).bit_length() - 1) + RANGES // 2).cast("int")))
        counts = keyed.groupBy("kind", "range").agg(F.count(F.lit(1)).alias("n"))
        upto = F.coalesce(F.sum("n").over(W.partitionBy("kind").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cut = counts.withColumn("before", upto).join(F.broadcast(ends), "kind").filter("before < high and high <= before + n")
        one = F.struct("high", "low", "target", F.col("range").alias("cut"), "before")
        cuts = F.broadcast(cut.groupBy("kind").agg(F.array_sort(F.collect_list(one)).alias("parts")))
        placed = keyed.join(cuts, "kind").withColumn("open", F.filter("parts", lambda s: s["cut"] >= F.col("range"))).filter(F.size("open") > 0)
        placed = placed.withColumn("ended", F.exists("parts", lambda s: s["cut"] == F.col("range")))
        whole = placed.filter("not ended").select("plan_id", F.col("open")[0]["target"].alias("target_id"), F.col("id").alias("candidate_id"))
        place = F.col("open")[0]["before"] + F.row_number().over(W.partitionBy("kind", "range").orderBy("key", "id")) - 1
        ranked = placed.filter("ended").withColumn("place", place.cast("bigint"))
        taken = ranked.withColumn("part", F.filter("open", lambda s: (s["low"] <= F.col("place")) & (F.col("place") < s["high"]))).filter(F.size("part") > 0)
        return whole.unionByName(taken.select("plan_id", F.col("part")[0]["target"].alias("target_id"), F.col("id").alias("candidate_id")))


def found(decisions: DataFrame, targets: DataFrame, former: DataFrame) -> DataFrame:
    """p3_found(target_id): the report's targets that can't be met. A target that names nothing has all decisions; null
    columns of decisions match no named target; decisions delivered twice count once."""
    return Sample(decisions, targets, former).report().filter("short").select("target_id")
