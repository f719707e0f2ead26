"""Problem 7: sources mixed to target weights by Pfair scheduling.

Every source is a task whose weight is its share of the mix. Its tokens are cut into blocks; block k may not start
before floor((k-1)/w) and is due by ceil(k/w), in blocks of the mix. Earliest deadline first over the released blocks
then interleaves the sources so that no source is ever a whole block ahead of or behind its share. A document that is
longer than the rest of its block goes on in the source's next block, so that this holds for tokens, whatever the lengths.

The schedule has a fixed number of blocks whatever the data (their size grows instead), so it is made on the driver and
broadcast. The documents are placed by running totals of tokens within each source.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.llm import tokens
from vouchline.llm.keys import slug
from vouchline.operators.skew import running_total
from vouchline.shared import Staging

#: Blocks in a mix. The schedule, on the driver, has this many rows and one more for each source.
BLOCKS = 4096
#: The targets are a hand-written table; a longer one is refused rather than collected.
MOST_SOURCES = 100_000


def filled(targets: dict[str, tuple[float, int]], tokens_of: dict[str, int], total: int) -> dict[str, int]:
    """Tokens that each source gives: shares of ``total``, no source beyond its repeats; what the capped ones leave
    over goes to the others in proportion to their shares, as far as their own caps allow."""
    caps = {s: max(0, repeats) * tokens_of.get(s, 0) for s, (_, repeats) in targets.items()}
    shares = {s: Fraction(str(share)) for s, (share, _) in targets.items() if share > 0}
    given, open_, rest = dict.fromkeys(targets, 0), set(shares), total
    while open_ and rest > 0:
        weight = sum(shares[s] for s in open_)
        full = [s for s in open_ if rest * shares[s] / weight >= caps[s]]
        if not full:
            for s in open_:
                given[s] = floor(rest * shares[s] / weight)
            break
        for s in full:
            given[s] = caps[s]
            open_.discard(s)
        rest = total - sum(given.values())
    return given


def schedule(given: dict[str, int], block: int) -> list[tuple[str, int, int]]:
    """(source, block number from 0, slot): earliest deadline first over released blocks, ties by the later release of
    the next block and then by name. The weights sum to 1, so every slot has a released block or only the ends are short."""
    total = sum(given.values())
    weights = {s: Fraction(n, total) for s, n in given.items() if n > 0}
    counts = {s: -(-given[s] // block) for s in weights}
    window = lambda s, k: (floor((k - 1) / weights[s]), ceil(k / weights[s]))
    waiting = [(window(s, 1)[0], s, 1) for s in weights]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], -window(s, k + 1)[0], s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append((s, k - 1, slot))
        if k < counts[s]:
            heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))
        slot += 1
    return out


class Mix:
    """The plan of a mix: what each source has, gives and where its blocks go."""

    def __init__(self, documents: DataFrame, targets: DataFrame, directory: str = tokens.TOKENIZERS) -> None:
        self.spark = documents.sparkSession
        self.staging = Staging(self.spark, "mix")
        names = targets.filter(slug(F.col("source")).isNotNull()).groupBy(slug(F.col("source")).alias("key")).agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        rows = names.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError("too many sources in the targets")
        self.names = {r["key"]: r["source"] for r in rows}
        self.targets = {r["key"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in rows}
        sizes = tokens.sized(documents.select("doc_id", slug(F.col("source")).alias("key"), "text"), "key", directory=directory)
        self.sizes = self.staging.put(sizes)
        known = self.spark.createDataFrame([(k,) for k in self.targets], "key string") if self.targets else names.select("key")
        self.wanted = F.broadcast(known)
        per = self.sizes.groupBy("key").agg(F.sum("n_tokens").alias("n"))
        self.total = per.agg(F.sum("n")).first()[0] or 0
        self.tokens_of = {r["key"]: r["n"] for r in per.join(self.wanted, "key").collect()}
        self.given = filled(self.targets, self.tokens_of, self.total)
        self.block = max(1, ceil(sum(self.given.values()) / BLOCKS))

    def report(self) -> DataFrame:
        """A row a source: tokens it has, target, cap, tokens in the mix, shares and whether the target was beyond its cap.
        ``rows`` holds exactly these tokens."""
        mixed = sum(self.given.values()) or 1
        out = []
        for key, (share, repeats) in self.targets.items():
            has, given = self.tokens_of.get(key, 0), self.given[key]
            out.append((self.names[key], share, repeats, has, given, given / mixed, given / has if has else 0.0, share * self.total > repeats * has))
        return self.spark.createDataFrame(out, "source string, target_share double, max_repeats int, source_tokens bigint, mixed_tokens bigint, actual_share double, passes double, short boolean")

    def rows(self) -> DataFrame:
        """(slot, at, source, pass, doc_id, first_token, n_tokens): the mix in blocks, a row for each part of a document that
        lies in one block. ``at`` is where in its slot a part starts, in tokens, ``first_token`` where in its document. A
        source's last part ends where its quota does."""
        plan = [(s, k, slot) for s, k, slot in schedule(self.given, self.block)]
        quota = [(k, self.names[k], self.given[k], self.tokens_of.get(k, 0)) for k in self.targets if self.given[k] > 0]
        slots = F.broadcast(self.spark.createDataFrame(plan, "key string, block bigint, slot bigint"))
        quotas = F.broadcast(self.spark.createDataFrame(quota, "key string, source string, quota bigint, has bigint"))
        own = self.sizes.join(self.wanted, "key").filter("n_tokens > 0").withColumn("_at", F.xxhash64("doc_id"))
        own = own.withColumn("_same", F.monotonically_increasing_id())
        placed = running_total(own, ["_at", "doc_id", "_same"], "n_tokens", "_start", self.staging, within="key")
        passes = placed.join(quotas, "key").withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("cast((quota - 1) div has as int)")))))
        on = passes.withColumn("_from", F.col("pass") * F.col("has") + F.col("_start")).withColumn("_to", F.least(F.col("_from") + F.col("n_tokens"), F.col("quota"))).filter("_from < _to")
        parts = on.withColumn("block", F.explode(F.expr(f"sequence(_from div {self.block}, (_to - 1) div {self.block})")))
        low, high = F.greatest(F.col("_from"), F.col("block") * self.block), F.least(F.col("_to"), (F.col("block") + 1) * self.block)
        return parts.join(slots, ["key", "block"]).select("slot", (low - F.col("block") * self.block).alias("at"), "source", F.col("pass").cast("int").alias("pass"), "doc_id", (low - F.col("_from")).alias("first_token"), (high - low).alias("n_tokens"))


def found(documents: DataFrame, targets: DataFrame, directory: str = tokens.TOKENIZERS) -> DataFrame:
    """p7_found(source): sources whose target exceeds what their repeats can give, from the mix's own report.

    Documents without text have no tokens; those of a source without a target count for the total only.
    """
    return Mix(documents, targets, directory).report().filter("short").select("source")
