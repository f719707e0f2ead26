"""Exact duplicates, near pairs and their resolution."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.functions.text import SPACE, bigrams, trimmed, unigrams
from vouchline.operators.skew import hot_keys, salted_join
from vouchline.shared import Staging

# The results that a pair's critic may give.
RESULTS = ("duplicate", "distinct", "uncertain")
UNSURE = "near_duplicate_uncertain"
#: Open pairs that one task settles: some 100 MB at most.
FEW = 500_000
#: Guards the prefix lengths against the last bit of a product of doubles.
EPSILON = 1e-9
#: Buckets of member counts, a byte each: so many at least and at most, whatever the data; counts in steps of a power of two.
LEAST_BUCKETS, MOST_BUCKETS, STEPS = 1 << 20, 1 << 25, 4
#: Sets of a member that one tile holds: it bounds a worker's memory.
TILE = 1 << 17
#: Blocks up to SHORT rows are compared row after row; longer ones SLAB rows at a time with WIDE others.
SHORT, SLAB, WIDE = 256, 64, 4096
#: Rows that a worker gathers before it compares, and pairs handed on at once.
HELD, HANDED = 200_000, 100_000
#: What a row of a block holds.
ROW = ["block", "side", "n", "at", "sid", "k0", "k1"]


def first_valid(events: DataFrame) -> DataFrame:
    """events(id, question_key, valid, record_id) -> with duplicate_of: the record of the first valid event of the same
    question with a smaller id. An invalid earlier event blocks nothing.

    The first valid event is a map-side combined aggregate by question, joined back over salts, so no question gathers its
    events.
    """
    staging = Staging(events.sparkSession, "exact")
    events = staging.put(events)
    counts = events.groupBy("question_key").agg(F.min(F.when(F.col("valid"), F.struct("id", "record_id"))).alias("first"), F.count(F.lit(1)).alias("n"))
    counts = staging.put(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = salted_join(events, counts.filter("first is not null").select("question_key", "first"), "question_key", hot_keys(counts, "question_key", total), F.xxhash64("id"), "left")
    return joined.select("id", "question_key", "valid", F.when(F.col("id") > F.col("first.id"), F.col("first.record_id")).alias("duplicate_of"))


def occurrences(items: DataFrame) -> DataFrame:
    """items(request, content, pos) -> with occurrence: how many equal contents of the response stand before it."""
    before = F.row_number().over(W.partitionBy("request", "content").orderBy("pos")) - 1
    return items.withColumn("occurrence", before)


def token_sets(records: DataFrame, folded_question: Column) -> DataFrame:
    """records(id) -> (id, uni, bi, words): distinct words and distinct adjacent pairs of the folded question, and its words
    in their order as one text."""
    words = unigrams(folded_question)
    return records.select("id", words.alias("w")).select("id", F.array_distinct("w").alias("uni"), F.array_distinct(bigrams(F.col("w"))).alias("bi"), F.array_join("w", " ").alias("words"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's hashes as uint64 and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(*names: str) -> Column:
    return F.transform(F.concat(*names), lambda x: F.xxhash64(x))


def _classes(sets: DataFrame) -> np.ndarray:
    """A byte a bucket of member hashes: 0 for at most one member in all sets, else how many in quarters of powers of two.

    A bucket that several members share only makes all of them look more common, in every set alike.
    """
    total = sets.agg(F.coalesce(F.sum(F.size("uni") + F.size("bi")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (total // 4).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = np.unique(_flat(batch.column(0))[0] & np.uint64(buckets - 1), return_counts=True)
            for i in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int64)), pa.array(counts[i : i + 100_000])], ["bucket", "n"])

    counts = sets.select(_hashes("uni", "bi").alias("x")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1")
    cells = counts.groupBy(F.expr("bucket >> 3").alias("at")).agg(F.expr(f"bit_or(shiftleft(least(255L, 1 + floor({STEPS} * log2(n))), cast(8 * (bucket & 7) as int)))").alias("bits")).toArrow()
    out = np.zeros(buckets // 8, np.uint64)
    out[cells["at"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _prefixes(sets: DataFrame, name: str, least: float, classes: Broadcast) -> DataFrame:
    """(block, side, n, at, sid, k0, k1): of each set its rarest members, as many as a pair that reaches ``least`` must share
    one of, with their places, beside the set's size and the parities of its members; members of one set alone have no row.

    A block is a member. One that many sets hold is split: its sets are dealt over tiles, and there is a block for every
    two tiles (sides 0 and 1, which meet each other only) and for each tile (side 2, where all meet).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in batches:
            sids, (flat, sizes) = batch.column(0).to_numpy(), _flat(batch.column(1))
            sids, sizes = sids[sizes > 0], sizes[sizes > 0]
            if not len(sizes):
                continue
            row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            spread = _mixed(flat)
            k = [np.bitwise_xor.reduceat(np.where((spread >> np.uint64(6)) & np.uint64(1) == part, np.uint64(1) << (spread & np.uint64(63)), np.uint64(0)), starts).view(np.int64) for part in (0, 1)]
            kind = table[flat & np.uint64(len(table) - 1)]
            order = np.lexsort((flat, kind, row))
            at = np.arange(len(row)) - starts[row]
            kept = (at < (sizes - np.ceil(least * sizes - EPSILON) + 1)[row]) & (kind[order] > 0)
            row, at, flat, kind = row[kept], at[kept], flat[order][kept], kind[order][kept]
            tiles = np.ceil(2.0 ** (kind / STEPS) / TILE).astype(np.int64)
            again = np.repeat(np.arange(len(row)), tiles)
            other = (np.arange(len(again)) - np.repeat(np.cumsum(tiles) - tiles, tiles)).astype(np.uint64)
            row, at, flat = row[again], at[again], flat[again]
            own = _mixed(sids.view(np.uint64)[row]) % tiles[again].astype(np.uint64)
            block = _mixed(flat + (np.minimum(own, other) << np.uint64(32)) + np.maximum(own, other)).view(np.int64)
            side = np.where(own == other, 2, own > other).astype(np.int8)
            columns = block, side, sizes[row].astype(np.int32), at.astype(np.int32), sids[row], k[0][row], k[1][row]
            for i in range(0, len(row), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(column[i : i + 50_000]) for column in columns], ROW)

    return sets.select("sid", _hashes(name).alias("x")).mapInArrow(run, "block bigint, side tinyint, n int, at int, sid bigint, k0 bigint, k1 bigint")


class _Rows:
    """Rows of whole blocks, in the order of (block, side, n, at), and what of them meets."""

    def __init__(self, columns: list[np.ndarray], least: float) -> None:
        self.block, self.side, self.n, self.at, _, k0, k1 = columns
        self.k0, self.k1 = k0.view(np.uint64), k1.view(np.uint64)
        self.least = least

    def needed(self, total: np.ndarray) -> np.ndarray:
        """How many members two sets of together ``total`` have in common at least."""
        return np.ceil(self.least / (1 + self.least) * total - EPSILON).astype(np.int64)

    def near(self, l: np.ndarray, r: np.ndarray, most: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """What of the pairs of rows differs in at most ``most`` parities: two sets differ in as many members at least."""
        first = np.bitwise_count(self.k0[l] ^ self.k0[r])
        kept = np.flatnonzero(first <= most)
        l, r = l[kept], r[kept]
        close = first[kept] + np.bitwise_count(self.k1[l] ^ self.k1[r]) <= (most[kept] if isinstance(most, np.ndarray) else most)
        return l[close], r[close]

    def short(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row against the next of its block, then against the one after, as long as any block is that long."""
        at, lag = np.arange(len(rows)), 1
        while True:
            at = at[: np.searchsorted(at, len(rows) - lag)]
            at = at[self.block[rows[at]] == self.block[rows[at + lag]]]
            if not len(at):
                return
            l, r = rows[at], rows[at + lag]
            total = self.n[l].astype(np.int64) + self.n[r]
            needed = self.needed(total)
            # At a pair's first common member, only that and what comes after it in both sets can be common.
            meets = (np.minimum(self.n[l] - self.at[l], self.n[r] - self.at[r]) >= needed) & ((self.side[l] == 2) | (self.side[l] != self.side[r]))
            yield self.near(l[meets], r[meets], (total - 2 * needed)[meets])
            lag += 1

    def long(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of one block by size: of every two sizes only the places from which a pair can still reach ``least``."""
        side, n, at = self.side[begin:end], self.n[begin:end].astype(np.int64), self.at[begin:end]
        starts = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (n[1:] != n[:-1])])
        ends = np.r_[starts[1:], end - begin]
        sizes, sides = n[starts], side[starts]
        needed = self.needed(sizes[:, None] + sizes[None, :])
        far = np.minimum(sizes[:, None] - needed, sizes[None, :] - needed) >= 0
        ordered = np.arange(len(starts))[:, None] <= np.arange(len(starts))[None, :]
        for i, j in np.argwhere(far & ordered & ((sides[:, None] == 2) | (sides[:, None] != sides[None, :]))).tolist():
            x = starts[i] + np.searchsorted(at[starts[i] : ends[i]], sizes[i] - needed[i, j], "right")
            y = starts[j] + np.searchsorted(at[starts[j] : ends[j]], sizes[j] - needed[i, j], "right")
            most = int(sizes[i] + sizes[j] - 2 * needed[i, j])
            for a in range(starts[i], x, SLAB):
                a_end = min(a + SLAB, x)
                for b in range(a if i == j else starts[j], y, WIDE):
                    b_end = min(b + WIDE, y)
                    l, r = np.nonzero(np.bitwise_count(self.k0[begin + a : begin + a_end, None] ^ self.k0[None, begin + b : begin + b_end]) <= most)
                    l, r = l + begin + a, r + begin + b
                    if i == j:
                        l, r = l[l < r], r[l < r]
                    yield self.near(l, r, most)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]])
        lengths = np.diff(np.r_[starts, len(self.block)])
        yield from self.short(np.flatnonzero(np.repeat(lengths <= SHORT, lengths)))
        for start, length in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
            yield from self.long(start, start + length)


def _met(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) of the sets that meet at a member and can still reach ``least`` from there and by their sketches."""

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sids, kept, n = columns[4], [], 0
        for l, r in _Rows(columns, least).pairs():
            if len(l):
                a, b = sids[l], sids[r]
                kept.append((np.minimum(a, b), np.maximum(a, b)))
                n += len(l)
            if n >= HANDED:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*kept, strict=True)], ["a", "b"])
                kept, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*kept, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append([column.to_numpy() for column in batch.columns])
            n += batch.num_rows
            if n < HELD or held[0][0][0] == held[-1][0][-1]:
                continue
            columns = [np.concatenate(parts) for parts in zip(*held, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from found([column[:last] for column in columns])
            held, n = [[column[last:] for column in columns]], n - last
        if n:
            yield from found([np.concatenate(parts) for parts in zip(*held, strict=True)])

    return rows.repartition("block").sortWithinPartitions("block", "side", "n", "at").mapInArrow(run, "a bigint, b bigint")


def _scored(pairs: DataFrame, least_uni: float, least_bi: float) -> DataFrame:
    """pairs(id_a, id_b, words_a, words_b) -> (left, right, unigram, bigram) of those that reach either threshold."""

    def share(x: set, y: set) -> float:
        both = len(x & y)
        return both / (len(x) + len(y) - both) if x or y else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_a, id_b, words_a, words_b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                x, y = words_a.split(" "), words_b.split(" ")
                uni, bi = share(set(x), set(y)), share(set(zip(x, x[1:])), set(zip(y, y[1:])))  # noqa: B905
                if uni >= least_uni or bi >= least_bi:
                    out.append((min(id_a, id_b), max(id_a, id_b), uni, bi))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = pa.string(), pa.string(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], ["left", "right", "unigram", "bigram"])

    return pairs.mapInArrow(run, "left string, right string, unigram double, bigram double")


def near_pairs(sets: DataFrame, least_uni: float = 0.70, least_bi: float = 0.50) -> DataFrame:
    """sets(id, uni, bi, words) -> (left, right, unigram, bigram) of all pairs that reach either threshold, left < right.

    Exact by prefix filtering: with the members of a set in one order from the rarest, two sets of Jaccard t or more share
    one of the first n - ceil(t n) + 1 of each. Once for words and once for pairs of words. Only hashes and numbers are
    shuffled, to the blocks of their members, where only sizes and places that can reach the threshold meet. What meets is
    made distinct as pairs of numbers and scored from the sets.
    """
    staging = Staging(sets.sparkSession, "near")
    sets = staging.put(sets.withColumn("sid", F.monotonically_increasing_id()))
    classes = sets.sparkSession.sparkContext.broadcast(_classes(sets))
    met = [_met(_prefixes(sets, name, least, classes), least) for name, least in (("uni", least_uni), ("bi", least_bi))]
    pairs = staging.put(reduce(DataFrame.unionByName, met).distinct())
    classes.unpersist()
    # The words are a third of the sets' size, and what is scored is shuffled twice.
    a, b = (sets.select(F.col("sid").alias(side), F.col("id").alias(f"id_{side}"), F.col("words").alias(f"words_{side}")) for side in "ab")
    one = pairs.join(a, "a").join(b, "b")
    return _scored(one.select("id_a", "id_b", "words_a", "words_b"), least_uni, least_bi)


def recorded(duplicates: DataFrame) -> DataFrame:
    """duplicates(left, right, result), as written -> (left, right, result), a row a pair, left < right.

    Ids count without padding and in lower case and stand in either order; a result's padding, case and final full stop
    don't count. What is none of the results says nothing beside a row of the pair that has one; a pair without any is
    uncertain, as the output of a malformed critic is. Of conflicting results uncertain goes before duplicate, and that
    before distinct.
    """
    plain = lambda c: F.lower(trimmed(F.col(c)))
    rows = duplicates.select(plain("left").alias("a"), plain("right").alias("b"), F.regexp_replace(plain("result"), rf"[{SPACE}]*\.$", "").alias("said")).filter("a <> b")
    ordered = rows.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), F.when(F.col("said").isin(*RESULTS), F.col("said")).alias("said"))
    return ordered.groupBy("left", "right").agg(F.coalesce(F.max("said"), F.lit("uncertain")).alias("result"))


def _in_order(pairs: DataFrame) -> DataFrame:
    """``resolved`` for at most FEW open pairs: one task goes through them in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[str] = set()
        for batch in batches:
            fates: list[tuple[str, str, str | None]] = []
            for left, right, result in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if left in gone or right in gone:
                    continue
                fates += [(right, "near_duplicate", left)] if result == "duplicate" else [(right, UNSURE, None), (left, UNSURE, None)]
                gone.update(fate[0] for fate in fates[-2:])
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*fates, strict=True)] if fates else [pa.array([], pa.string())] * 3, ["record", "reason", "duplicate_of"])

    ordered = pairs.select("left", "right", "result").repartition(1).sortWithinPartitions("right", "left")
    return ordered.mapInArrow(run, "record string, reason string, duplicate_of string")


def resolved(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """pairs(left, right, result) -> (record, reason, duplicate_of) of every rejected record.

    Pairs count in the order of (right, left). A pair of which a record is already rejected is skipped; 'duplicate'
    rejects the right one, 'uncertain' both, anything else none. Rounds settle many pairs at once: a pair takes effect
    once no earlier open pair could still reject one of its records, and a pair with a record rejected before it is
    dropped. A record's pairs are never gathered; only the first that could reject it is kept, by an aggregate. Record ids
    are digests, so the pairs come in random order and a round leaves a fraction of them; as soon as at most ``few`` are
    left, one task settles them in order. Every round settles a pair, so it ends whatever the ids.
    """
    staging = Staging(pairs.sparkSession, "resolve")
    started = pairs.filter(F.col("left") < F.col("right")).filter(F.col("result").isin("duplicate", "uncertain"))
    open_ = staging.put(started.groupBy("left", "right").agg(F.max("result").alias("result")))
    fates = []
    while open_.limit(few + 1).count() > few:
        ordered = open_.withColumn("at", F.struct("right", "left"))
        ends = ordered.select("at", F.explode(F.when(F.col("result") == "duplicate", F.array("right")).otherwise(F.array("right", "left"))).alias("record"))
        first = staging.put(ends.groupBy("record").agg(F.min("at").alias("first")))
        side = lambda rows, table, name, at: rows.join(table.select(F.col("record").alias(name), F.col(at).alias(f"{at}_{name}")), name, "left")
        known = side(side(ordered, first, "left", "first"), first, "right", "first")
        fires = (F.col("first_left").isNull() | (F.col("first_left") >= F.col("at"))) & (F.col("first_right") >= F.col("at"))
        twice = F.when(F.col("result") == "duplicate", F.array(F.struct(F.col("right").alias("record"), F.lit("near_duplicate").alias("reason"), F.col("left").alias("duplicate_of")))).otherwise(
            F.transform(F.array("right", "left"), lambda x: F.struct(x.alias("record"), F.lit(UNSURE).alias("reason"), F.lit(None).cast("string").alias("duplicate_of")))
        )
        fate = staging.put(known.filter(fires).select("at", F.explode(twice).alias("x")).select("x.*", "at"))
        fates.append(fate.select("record", "reason", "duplicate_of"))
        gone = side(side(ordered, fate, "left", "at"), fate, "right", "at")
        stands = lambda c: F.col(c).isNull() | (F.col(c) > F.col("at"))
        after = staging.put(gone.filter(stands("at_left") & stands("at_right")).select("left", "right", "result"))
        staging.drop(open_, first)
        open_ = after
    return reduce(DataFrame.unionByName, fates, _in_order(open_))
