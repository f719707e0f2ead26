"""Problem 4: near-duplicate questions by pigeonhole blocks of set fingerprints, exact for every pair.

A question's fingerprint is its set of words as a sparse bit vector, a bit for each 64-bit word hash. Two questions of
a and b words with at least the share t of their words in common differ in at most k = a + b - 2 ceil(t(a+b)/(1+t))
bits. The fingerprint is split into blocks so that any two that close agree in one:

* every rare word (at most a set share of the questions have its hash bucket) is a block of its own;
* if two questions agree in no rare word, all their r and r' rare words differ, so the rest of the fingerprint, split
  into q + 1 blocks by word hash with q = k - r - r', has a block that is the same in both.

A block's key holds what both sides know of the split (r and r', q), so only questions that the argument needs meet.
Pairs that meet are checked by the Hamming distance of 64-bit parity sketches of the fingerprints, which never exceeds
that of the fingerprints, and then by the fingerprints themselves. Copies of a word set are one class throughout.

Word counts are kept in buckets, whose number follows the data up to a bound, and reach the workers as two bitmaps of at
most 8 MB; two more hold the keys of uncommon splits. A bucket shared by several words only makes them look more common, for all questions alike, so no pair is lost
by it. Blocks, classes and members that hold a large part of all rows are split: the joins of classes are salted, those of
blocks are left to the skew handling of adaptive execution, which splits a partition also where it is one key.

The limit of rare words follows the data, so that a question keeps as many of them, and as few blocks, at any size. What
grows with the square of the data are the comparisons of sketches within a word, a few nanoseconds each.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.llm import components
from vouchline.llm.candidates import as_object, words
from vouchline.operators.skew import hot_keys, salted_join
from vouchline.shared import Staging

#: The least share of the words of either question that a pair has in common.
SHARE = Fraction(7, 10)
#: A word is rare when at most so many word sets have its bucket: one part in RARE_PARTS of all sets, within these bounds.
#: A worker holds a block of one word, so MOST_RARE bounds its memory.
RARE, RARE_PARTS, MOST_RARE = 512, 1024, 1 << 17
#: Blocks of one word up to SHORT rows are compared row after row; longer ones SLAB rows at a time with WIDE others.
SHORT, SLAB, WIDE = 64, 64, 2048
#: Pairs handed on at once.
HANDED = 100_000
#: Buckets of word counts, and bits of the filter of uncommon splits: a power of two, so many times the words of all sets
#: and within these bounds. A bitmap has 8 MB at most, whatever the data.
BUCKETS_A_WORD, LEAST_BUCKETS, MOST_BUCKETS = 1, 1 << 22, 1 << 26
#: Bitmaps of the filter of uncommon splits, each with a hash of its own: a key that no poor set has passes all by chance only.
PROBES = 2
#: Numbers of rare words and of blocks are exact up to here and in steps of a tenth beyond; only long sets come so far.
EXACT = 40
#: Word hashes that a worker keeps.
CACHE = 500_000


def most_differing(total: int, share: Fraction = SHARE) -> int:
    """The largest Hamming distance of two sets of together ``total`` members that have ``share`` in common; below 0: none."""
    top, bottom = share.numerator, share.numerator + share.denominator
    return total + 2 * (-top * total // bottom)


def _steps() -> np.ndarray:
    """0, 1, ... EXACT and then numbers a tenth apart."""
    out = list(range(EXACT + 1))
    while out[-1] < 1 << 40:
        out.append(out[-1] + out[-1] // 10)
    return np.array(out, np.int64)


STEPS = _steps()


def step_down(n: int) -> int:
    """n itself when small, else the start of the step that it lies in: long sets share their splits."""
    return int(STEPS[np.searchsorted(STEPS, n, "right") - 1])


@lru_cache(maxsize=200_000)
def splits_of(size: int, rare: int, share: Fraction = SHARE) -> tuple[tuple[int, int, bool], ...]:
    """For a set of ``size`` words, of which ``rare`` are rare: (r' of a partner, blocks, whether every such partner is
    poor) for the partners that may agree with it in no rare word. A set is poor when it has far fewer rare words than
    half of k, so that many splits concern it. r and r' are taken down to a step, which allows more differences and so
    loses no pair; the number of blocks is taken up to a step, which leaves more of them equal."""
    top, bottom = share.numerator, share.numerator + share.denominator
    rest, least = size - rare, step_down(rare)
    out: dict[tuple[int, int], bool] = {}
    for other, after in zip(STEPS[:-1].tolist(), STEPS[1:].tolist(), strict=True):
        reach = most_differing(size + floor(size / share), share) + 1 - least - other
        if reach < 0:
            break
        f = np.arange(max(0, rest - reach), rest + reach + 1)[:, None]
        partner = f + np.arange(other, after)[None, :]
        q = size + partner + 2 * (-top * (size + partner) // bottom) - least - other
        fits = (partner > 0) & (partner * share.denominator >= share.numerator * size) & (size * share.denominator >= share.numerator * partner) & (q >= abs(f - rest))
        if not fits.any():
            continue
        is_poor = 2 * (partner - f) < 2 * partner + 2 * (-top * 2 * partner // bottom) - 2
        blocks = STEPS[np.searchsorted(STEPS, q[fits] + 1)]
        for n in np.unique(blocks).tolist():
            out[other, n] = bool(is_poor[fits][blocks == n].all())
    return tuple((other, n, flag) for (other, n), flag in sorted(out.items()))


def poor(size: int, rare: int, share: Fraction = SHARE) -> bool:
    return 2 * rare < most_differing(2 * size, share) - 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salt(*numbers: int) -> np.uint64:
    out = 0x9E3779B97F4A7C15
    for number in numbers:
        out = (out * 0x100000001B3 + number + 1) % (1 << 64)
    return np.uint64(out)


def parsed(candidates: DataFrame, text: str = "question") -> DataFrame:
    """candidates(id, raw) -> (id, key: 128 bits of the word set, words: its 64-bit hashes). Raw texts that aren't
    objects with a text of at least one word there have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, int] = {}
        for batch in batches:
            ids, keys, flat, ends = [], [], [], [0]
            for one, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = as_object(raw)
                said = value.get(text) if value and one is not None else None
                bag = set(words(said)) if isinstance(said, str) else None
                if not bag:
                    continue
                if len(known) > CACHE:
                    known.clear()
                for word in bag:
                    number = known.get(word)
                    if number is None:
                        number = known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
                    flat.append(number)
                ids.append(one)
                keys.append(xxhash.xxh3_128_digest(" ".join(sorted(bag)).encode("utf-8", "surrogatepass")))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary()), lists], ["id", "key", "words"])

    return candidates.select("id", "raw").mapInArrow(run, "id string, key binary, words array<bigint>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values as uint64 and the row of each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(column)), sizes)


def sized_for(sets: DataFrame) -> tuple[int, int]:
    """How many buckets the words of sets(words) need, and in how many sets a rare word may be."""
    count, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (BUCKETS_A_WORD * total).bit_length()))
    return buckets, max(RARE, min(MOST_RARE, count // RARE_PARTS))


def _bitmaps(hits: DataFrame, buckets: int, *least: int) -> list[np.ndarray]:
    """hits(bucket, n) -> for each of ``least`` the bitmap of the buckets with at least so many: at most ``buckets``/64
    longs of each come to the driver."""
    bit = "shiftleft(1L, cast(bucket & 63 as int))"
    cells = hits.groupBy(F.shiftright("bucket", 6).alias("at")).agg(*[F.expr(f"bit_or(if(n >= {x}, {bit}, 0L))").alias(f"bits{i}") for i, x in enumerate(least)]).toArrow()
    at = cells["at"].to_numpy()
    out = []
    for i in range(len(least)):
        bitmap = np.zeros(buckets // 64, np.uint64)
        bitmap[at] = cells[f"bits{i}"].to_numpy().view(np.uint64)
        out.append(bitmap)
    return out


def _has(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the buckets of hashes are set in a bitmap."""
    buckets = _bucket(numbers, 64 * len(bitmap))
    return (bitmap[buckets >> np.uint64(6)] >> (buckets & np.uint64(63))) & np.uint64(1) != 0


def _bucket(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (numbers ^ (numbers >> np.uint64(32))) % np.uint64(buckets)


def _probe(keys: np.ndarray, i: int) -> np.ndarray:
    """What stands for keys in the i-th bitmap of a filter."""
    return _mixed(keys + _salt(5, i)) if i else keys


def _sparse_counts(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Buckets, batch after batch -> rows (bucket, n), counted within each batch."""
    for buckets in batches:
        at, counts = np.unique(buckets, return_counts=True)
        for i in range(0, len(at), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(at[part].astype(np.int64)), pa.array(counts[part].astype(np.int64))], ["bucket", "n"])


def counted(sets: DataFrame, buckets: int) -> DataFrame:
    """sets(words) -> (bucket, n): how many sets have a word in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sparse_counts(_bucket(_flat(batch.column(0))[0], buckets) for batch in batches)

    return sets.select("words").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


class Blocks:
    """The blocks of a batch of sets; made in the workers from the two word bitmaps."""

    def __init__(self, common: np.ndarray, repeated: np.ndarray, share: Fraction) -> None:
        self.common, self.repeated, self.share = common, repeated, share

    def of(self, column: pa.Array) -> None:
        self.words, self.row = _flat(column)
        self.size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.is_common = _has(self.common, self.words)
        self.is_shared = _has(self.repeated, self.words) & ~self.is_common
        self.rare = np.bincount(self.row[~self.is_common], minlength=len(self.size))

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and keys of the blocks of one rare word; words of one set alone need none."""
        return self.row[self.is_shared], _mixed(self.words[self.is_shared] + _salt(1))

    def several(self, filtered: np.ndarray | None, only_poor: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, keys and sides of the blocks of the other words. ``filtered``: the bitmaps of keys of poor sets (one, or a
        row a probe), outside which a set that isn't poor needs no block for a split that only poor ones share."""
        rows, keys, sides = [], [], []
        plans: dict[int, dict[tuple[int, int, bool], list[np.ndarray]]] = {}
        profile = self.size * (1 << 31) + self.rare
        for code in np.unique(profile).tolist():
            size, rare = divmod(code, 1 << 31)
            mine = poor(size, rare, self.share)
            if only_poor and not mine:
                continue
            members = np.flatnonzero(profile == code)
            for other, n, flag in splits_of(size, rare, self.share):
                plans.setdefault(n, {}).setdefault((step_down(rare), other, flag and not mine), []).append(members)
        where = self.row[self.is_common]
        content = _mixed(self.words[self.is_common] + _salt(2))
        for n, groups in plans.items():
            concerned = np.unique(np.concatenate([m for group in groups.values() for m in group]))
            place = np.full(len(self.size), -1)
            place[concerned] = np.arange(len(concerned))
            held = place[where] >= 0
            sums = np.zeros(len(concerned) * n, np.uint64)
            part = ((content[held] >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            np.add.at(sums, place[where[held]] * n + part, content[held])
            sums = sums.reshape(len(concerned), n)
            for (rare, other, needs_poor), group in groups.items():
                members = np.concatenate(group)
                low, high = min(rare, other), max(rare, other)
                salts = np.array([_salt(3, low, high, n, j) for j in range(n)], np.uint64)
                key = _mixed(sums[place[members]] + salts).reshape(-1)
                row = np.repeat(members, n)
                if needs_poor and filtered is not None:
                    for i, bitmap in enumerate(np.atleast_2d(filtered)):
                        keep = _has(bitmap, _probe(key, i))
                        row, key = row[keep], key[keep]
                rows.append(row)
                keys.append(key)
                sides.append(np.full(len(row), 2 if rare == other else int(rare > other), np.int8))
        none = np.array([], np.int64)
        return np.concatenate(rows or [none]), np.concatenate(keys or [none.astype(np.uint64)]), np.concatenate(sides or [none.astype(np.int8)])

    def sketches(self) -> np.ndarray:
        """64 parities of the words, as a long a set."""
        out = np.zeros(len(self.size), np.uint64)
        np.bitwise_xor.at(out, self.row, np.uint64(1) << (_mixed(self.words + _salt(4)) & np.uint64(63)))
        return out


def blocks(sets: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """sets(cid: bigint, words) -> (block, cid, n, sketch): a row for each block that a set must be looked up in. n is four
    times the size of the set plus its side: 0 and 1 meet each other, 2 meets 2, and 3 is a block of one rare word."""
    spark = sets.sparkSession
    buckets, rare = sized_for(sets)
    sent = spark.sparkContext.broadcast(_bitmaps(counted(sets, buckets), buckets, rare + 1, 2))

    def keys_of_poor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Blocks(*sent.value, share)

        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                split.of(batch.column(0))
                _, keys, _ = split.several(None, only_poor=True)
                if len(keys):
                    yield np.concatenate([_bucket(_probe(keys, i), buckets) + np.uint64(i * buckets) for i in range(PROBES)])

        return _sparse_counts(each())

    hits = sets.select("words").mapInArrow(keys_of_poor, "bucket bigint, n bigint")
    filtered = spark.sparkContext.broadcast(_bitmaps(hits, PROBES * buckets, 1)[0].reshape(PROBES, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Blocks(*sent.value, share)
        for batch in batches:
            split.of(batch.column(1))
            sketch = split.sketches().view(np.int64)
            row1, key1 = split.singles()
            row2, key2, side2 = split.several(filtered.value)
            row, key = np.concatenate([row1, row2]), np.concatenate([key1, key2])
            side = np.concatenate([np.full(len(row1), 3, np.int8), side2])
            cid = batch.column(0).to_numpy()
            sized = split.size[row] * 4 + side
            for i in range(0, len(row), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(cid[row[part]]), pa.array(sized[part].astype(np.int32)), pa.array(sketch[row[part]])], ["block", "cid", "n", "sketch"])

    return sets.select("cid", "words").mapInArrow(run, "block bigint, cid bigint, n int, sketch bigint")


def _lagged(block: np.ndarray, cid: np.ndarray, size: np.ndarray, sketch: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within equal, adjacent blocks whose sketches are near enough: each row against the next of its block, then
    against the one after, and so on while any block is that long."""
    top, bottom = share.numerator, share.numerator + share.denominator
    left, right = [], []
    at, lag = np.arange(len(block)), 1
    while True:
        at = at[at + lag < len(block)]
        at = at[block[at] == block[at + lag]]
        if not len(at):
            none = np.array([], np.int64)
            return np.concatenate(left or [none]), np.concatenate(right or [none])
        total = size[at] + size[at + lag]
        near_enough = np.bitwise_count(sketch[at] ^ sketch[at + lag]) <= total + 2 * (-top * total // bottom)
        hit = at[near_enough]
        left.append(np.minimum(cid[hit], cid[hit + lag]))
        right.append(np.maximum(cid[hit], cid[hit + lag]))
        lag += 1


def _crossed(cid: np.ndarray, size: np.ndarray, sketch: np.ndarray, share: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one long block whose sketches are near enough. In order of size, a slab of rows meets those from its
    own on, as far as sizes go that can have ``share`` in common. What a slab allows is rounded up for its largest set and
    counted exactly for the pairs that it lets through."""
    top, bottom = share.numerator, share.numerator + share.denominator
    order = np.argsort(size, kind="stable")
    cid, size, sketch = cid[order], size[order], sketch[order]
    for start in range(0, len(cid), SLAB):
        rows = sketch[start : start + SLAB, None]
        largest = int(size[min(start + SLAB, len(cid)) - 1])
        stop = int(np.searchsorted(size, floor(largest / share), "right"))
        allowed = np.minimum((largest + size[start:stop]) * (bottom - 2 * top) // bottom, 64).astype(np.uint8)
        for low in range(start, stop, WIDE):
            high = min(low + WIDE, stop)
            apart = np.bitwise_count(rows ^ sketch[None, low:high])
            at = np.flatnonzero(apart <= allowed[None, low - start : high - start])
            if not len(at):
                continue
            i, j = at // (high - low) + start, at % (high - low) + low
            total = size[i] + size[j]
            hit = (i < j) & (apart.reshape(-1)[at] <= total + 2 * (-top * total // bottom))
            i, j = cid[i[hit]], cid[j[hit]]
            if len(i):
                yield np.minimum(i, j), np.maximum(i, j)


def _within(block: np.ndarray, cid: np.ndarray, size: np.ndarray, sketch: np.ndarray, share: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within equal, adjacent blocks whose sketches are near enough."""
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    lengths = np.diff(np.append(starts, len(block)))
    short = np.repeat(lengths <= SHORT, lengths)
    yield _lagged(block[short], cid[short], size[short], sketch[short], share)
    for start, length in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
        part = slice(start, start + length)
        yield from _crossed(cid[part], size[part], sketch[part], share)


def meet_by_word(rows: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """Blocks of one rare word -> (a, b) of the pairs that meet there. Such a block has at most MOST_RARE rows, so the rows
    of one block are all that is held between batches of a sorted partition."""

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = [np.array([], np.int64)] * 4

        def pairs(part: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            block, cid, n, sketch = part
            return _within(block, cid, n >> 2, sketch.view(np.uint64), share)

        for batch in batches:
            held = [np.concatenate([a, batch.column(i).to_numpy().astype(np.int64)]) for i, a in enumerate(held)]
            if len(held[0]):
                end = np.searchsorted(held[0], held[0][-1])
                yield from pairs([x[:end] for x in held])
                held = [x[end:] for x in held]
        yield from pairs(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*ready, strict=True)], ["a", "b"])

        for pair in blockwise(batches):
            if not len(pair[0]):
                continue
            ready.append(pair)
            waiting += len(pair[0])
            if waiting >= HANDED:
                yield handed()
                ready, waiting = [], 0
        if waiting:
            yield handed()

    sorted_rows = rows.select("block", "cid", "n", "sketch").repartition("block").sortWithinPartitions("block")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint")


def near(sets: DataFrame, staging: Staging, share: Fraction = SHARE) -> DataFrame:
    """sets(cid, words), one row a set -> (a, b, common): all pairs of sets with at least ``share`` in common, a < b."""
    rows = staging.put(blocks(sets, share))
    top, bottom = share.numerator, share.numerator + share.denominator
    # A block of sides 0 and 1 may be long on one of them; only the sides that meet are brought together, or the join would
    # go through the square of the long one.
    kind = F.col("n").bitwiseAND(3)
    left, right = rows.filter(kind.isin(0, 2)).alias("l"), rows.filter(kind.isin(1, 2)).alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    total = F.shiftright(l("n"), 2) + F.shiftright(r("n"), 2)
    needed = F.floor((total * top + (bottom - 1)) / F.lit(bottom)).cast("int")
    apart = F.bit_count(l("sketch").bitwiseXOR(r("sketch")))
    side = l("n").bitwiseAND(3) * 4 + r("n").bitwiseAND(3)
    sides = (side == 1) | ((side == 10) & (l("cid") < r("cid")))
    met = left.join(right, l("block") == r("block")).filter(sides & (apart <= total - 2 * needed))
    met = met.select(F.least(l("cid"), r("cid")).alias("a"), F.greatest(l("cid"), r("cid")).alias("b"))
    by_word = meet_by_word(rows.filter(F.col("n").bitwiseAND(3) == 3), share)
    pairs = staging.put(met.unionByName(by_word).distinct())
    staging.drop(rows)
    ends = pairs.join(sets.alias("x"), F.col("a") == F.col("x.cid")).join(sets.alias("y"), F.col("b") == F.col("y.cid"))
    both = F.size(F.array_intersect("x.words", "y.words"))
    scored = ends.select("a", "b", both.alias("common"), (F.size("x.words") + F.size("y.words")).alias("total"))
    return scored.filter(F.col("common") * bottom >= F.col("total") * top).select("a", "b", "common")


class Matches:
    """Classes of equal word sets, their members and the pairs of near classes."""

    def __init__(self, candidates: DataFrame, share: Fraction = SHARE) -> None:
        self.staging = Staging(candidates.sparkSession, "neardup")
        read = self.staging.put(parsed(candidates))
        classes = read.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
        self.sets = self.staging.put(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "words", "n"))
        total = self.sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        named = salted_join(read.select("key", "id"), self.sets.select("key", "cid"), "key", hot_keys(self.sets, "key", total), F.xxhash64("id"))
        self.members = self.staging.put(named.select("cid", "id").distinct())
        self.hot = hot_keys(self.sets, "cid", total)
        self.staging.drop(read)
        self.pairs = self.staging.put(near(self.sets.select("cid", "words"), self.staging, share).select("a", "b"))

    def _meet(self, cid: str, name: str, others: DataFrame) -> DataFrame:
        """others(cid, ...) beside each member of the class, as ``name``."""
        members = self.members.select(F.col("cid").alias(cid), F.col("id").alias(name))
        return salted_join(members, others, cid, self.hot.withColumnRenamed("cid", cid), F.xxhash64(name))

    def expanded(self) -> DataFrame:
        """Every pair of different ids, also of equal questions."""
        across = self._meet("b", "y", self._meet("a", "x", self.pairs)).filter("x <> y")
        inside = self._meet("cid", "x", self.members.withColumnRenamed("id", "y")).filter("x < y")
        both = across.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).unionByName(inside.select(F.col("x").alias("left_id"), F.col("y").alias("right_id")))
        return both.distinct()

    def grouped(self) -> DataFrame:
        """(id, group_id, copies, links): every question with a near or equal one; group_id is the smallest id of all that
        are linked to it directly or through others, copies the ids of the same word set, links its near word sets."""
        sizes = self.members.groupBy("cid").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        sizes = self.staging.put(sizes)
        links = self.pairs.select(F.col("a").alias("cid")).unionByName(self.pairs.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
        edges = self.pairs.join(sizes.select(F.col("cid").alias("a"), F.col("first").alias("left")), "a").join(sizes.select(F.col("cid").alias("b"), F.col("first").alias("right")), "b")
        joined = components.connected(edges.select("left", "right"), self.staging)
        known = sizes.join(links, "cid", "left").join(joined.withColumnRenamed("id", "first"), "first", "left").filter("copies > 1 or links > 0")
        known = self.staging.put(known.select("cid", F.coalesce("group_id", "first").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")))
        return self._meet("cid", "id", known).select("id", "group_id", "copies", "links").distinct()


def found(candidates: DataFrame) -> DataFrame:
    """p4_found(left_id, right_id). Ids delivered twice count once; questions without words have no pair."""
    return Matches(candidates).expanded()


def groups(candidates: DataFrame) -> DataFrame:
    """A row for each candidate in a group of near-duplicates: (id, group_id, copies, links)."""
    return Matches(candidates).grouped()
