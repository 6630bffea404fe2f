"""N-gram Jaccard join: all links between documents whose shingle sets have a similarity of 0.8 or more, exactly.

Universe partition. Sets are dealt into size bands so narrow that linked sets lie in one band or in neighbours. For
each band the space of shingle hashes is cut into m ranges, the segments. Two linked sets of the band differ in at
most H shingles, so by the pigeonhole principle

* of m = H + 1 + k segments at least k + 1 are equal in both. A set leaves out its k costliest segments, in an order
  that depends on the content of a segment alone: the cheapest of the equal ones is left out by neither. Empty
  segments cost most and are not indexed at all (unless a set has more than k); then cost is the number of sets that
  share the segment, which is counted for all of them. Or
* of m = H // 2 + 1 segments at least one differs in one shingle at most: a set indexes each segment and each of its
  one-deletion neighbours.

``allocate`` picks the cheaper of the two for a band by its rows and the chance matches that it expects, from how many
shingles sets have in common: one in SAMPLE is counted over all sets. Sets that are equal are one class from the start
and sent on once a task. Where all signatures are more than ROUND_ROWS and PER_SHINGLE times the shingles, they move in
rounds by ranges of their hash, each of which computes the sets again: the disk that they take stays in proportion.

Linking. Signatures are dealt by hash range to groups of bounded size, and each bucket of classes that share one is
kept once, by its members, with the number of its segments. Only stars are verified at first: the least class of a
bucket against the others; then what is still apart against HUBS members of the bucket's largest part. Most pairs share
a signature by a passage only: sketches of a 32nd to a 64th of a set show that they differ in too much, and only the
other pairs take whole sets along. Both move in rounds of bounded bytes. Classes that
are linked count as one from there on, and only pairs across unlinked parts of a bucket are left; they are verified
all, so no link between parts is lost and the pairs within a large group of copies never arise. Verification
intersects whole shingle sets.

Defined results: null text and text without words have an empty set and link with nothing; texts of one to four words
are one shingle, their whole sequence; equal sets link, so repeated rows and rows of one doc_id with equal text are
in one component; component_id is the smallest doc_id of the component (null only if all are null); an empty table
gives an empty result; extra columns are ignored, and kept by ``one_each``.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialise, scratch, small_batches, table, unused

WIDTH = 5
#: Signatures of a group, on average; the number of groups follows the signatures.
GROUP_ROWS = 625_000
#: Signatures that move at once: as many for each shingle, or as many in all if that is more.
PER_SHINGLE, ROUND_ROWS = 0.9, 10_000_000
#: Bytes of sets that pairs take along at once: a part of the bytes of all sets in question, or so many if that is more.
VERIFY_PART, VERIFY_BYTES = 0.5, 256 << 20
#: One in so many shingles, those of least hash, is counted for the cost model.
SAMPLE = 1024
#: Members of a bucket's largest part that what is apart from it is held against, before all pairs across parts are.
HUBS = 6
#: Levels of f, for a width of one set size, under which differences from a centre are indexed.
LEVELS = 8
#: Up to so many rows of two numbers are broadcast (32 MB); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Table entries for 64 places of a byte in its word and each of its values; and one number for each length of a sequence.
_TABLE = np.random.default_rng(20).integers(0, 2**64, 64 * 256, np.uint64)
_LENGTH = np.random.default_rng(21).integers(0, 2**64, WIDTH + 1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text (UTF-8) its distinct shingles as sorted 64-bit hashes. All texts of the list are hashed in one go.

    A word's hash sums a table entry for each byte and its place in the word; a shingle's sums its words' by place.
    """
    flat = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edge = np.diff(np.r_[False, inside, False].view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return [np.empty(0, np.uint64)] * len(texts)
    size = end - start
    letters = flat[inside].astype(np.int32)
    at = np.cumsum(size) - size
    place = (np.arange(len(letters)) - np.repeat(at, size)).astype(np.int32)
    value = _TABLE[((place & 63) << 8) | letters]
    if size.max() > 64:
        value *= (2 * (place >> 6) + 1).astype(np.uint64)
    h = mix(np.add.reduceat(value, at) + size.astype(np.uint64))
    first = np.searchsorted(start, np.cumsum(lengths) - lengths)
    count = np.diff(np.r_[first, len(h)])
    whole = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64) + _LENGTH[WIDTH]
    for k in range(WIDTH):
        whole += h[k : k + len(whole)] * _FACTORS[k]
    whole = mix(whole)
    out = []
    for f, n in zip(first.tolist(), count.tolist()):
        if n >= WIDTH:
            x = np.sort(whole[f : f + n - WIDTH + 1])
            new = x[1:] != x[:-1]
            out.append(x if new.all() else x[np.r_[True, new]])
        elif n:
            out.append(mix(np.array([_LENGTH[n]]) + (h[f : f + n] * _FACTORS[:n]).sum(dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(s: np.ndarray, seed: int) -> tuple[int, bytes]:
    """The class number of a set, and the 128-bit digest that tells whether a number stands for two sets."""
    raw = s.tobytes()
    return xxhash.xxh3_64_intdigest(raw, seed) - 2**63, hashlib.blake2b(raw, digest_size=16).digest()


@lru_cache(maxsize=1)
def bands(most: int = 2**31) -> list[tuple[int, int]]:
    """(least, greatest size) of the bands. A set links with sets of its band and its neighbours alone."""
    out, low = [], 1
    while low <= most:
        out.append((low, low * 5 // 4))
        low = low * 5 // 4 + 1
    return out


_LEAST = np.array([x for x, _ in bands()])


@lru_cache(maxsize=None)
def allocate(band: int, n_sets: int, common: float) -> tuple[int, int, bool]:
    """(m, k, deletions) for pairs whose larger set is in the band. m = 0: only equal sets link. common: chance that a
    shingle of one set is a given one of another."""
    high = bands()[band][1]
    h = 2 * high // 9
    if not h:
        return 0, 0, False
    k = h // 2 + 2
    plain, near = h + 1 + k, h // 2 + 1
    cost = lambda rows, m: rows * (1 + n_sets * min(1, high * common) ** (high / m))
    if h < 3 or cost(high + near, near) < cost(h + 1, plain):
        return near, 0, True
    return plain, k, False


def bands_of(n: int) -> list[int]:
    """The bands in which sets of size n are indexed: their own and, if they can link with a set there, the next."""
    b = int(np.searchsorted(_LEAST, n, "right")) - 1
    return [b, b + 1] if n and n * 5 // 4 >= bands()[b + 1][0] else [b] if n else []


def count_signatures(sizes: dict[int, int], common: float) -> int:
    """How many signatures all sets have at most. sizes: number of sets of each size."""
    n_sets, total = sum(sizes.values()), 0
    for n, many in sizes.items():
        for m, _, deletions in (allocate(g, n_sets, common) for g in bands_of(n)):
            total += many * (m + n if deletions else m)
    return total


def signatures(s: np.ndarray, n_sets: int, common: float) -> list[tuple[int, int, np.ndarray]]:
    """(band, room, signatures of 64 bits) of a sorted set, in its own band and, if it can link with a set there, the
    next. room: how many of them, the costliest, the set may leave out."""
    out = []
    for g in bands_of(len(s)):
        m, k, deletions = allocate(g, n_sets, common)
        if not m:
            continue
        segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ranges of the hash, so in order
        start = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        value = mix(s + np.uint64((g + 1) * int(_M2) & (2**64 - 1)))
        total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        sums = total[start[1:]] - total[start[:-1]]
        tag = mix(np.arange(m, dtype=np.uint64) * _FACTORS[0] + np.uint64(g * int(_FACTORS[1]) & (2**64 - 1)))
        sig = mix(sums + tag)
        if deletions:
            owner = segment.astype(np.int64)
            out.append((g, 0, np.unique(np.r_[sig, mix(sums[owner] - value + tag[owner])])))
            continue
        empty = np.flatnonzero(start[1:] == start[:-1])[:k]
        out.append((g, k - len(empty), np.delete(sig, empty)))
    return out


def sketch(s: np.ndarray) -> bytes:
    """The parities of how many shingles of a set have each value of their low bits: as many bits as the next power of two holds.

    A shingle that only one of two sets has changes one parity, so parities that differ are at most as many as such
    shingles. With the upper half xored onto the lower it is the sketch of half the bits.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def too_far(x: bytes, y: bytes, size: int) -> bool:
    """Whether sketches show that two sets of so many shingles in all differ in more than a ninth of that, so cannot link."""
    short, long = sorted((x, y), key=len)
    low, high = int.from_bytes(short, "little"), int.from_bytes(long, "little")
    bits = 8 * len(long)
    while bits > 8 * len(short):
        bits //= 2
        high = (high >> bits) ^ (high & ((1 << bits) - 1))
    return 9 * (low ^ high).bit_count() > size


def _sets(batch_column) -> list[np.ndarray]:
    return shingle_sets(batch_column.to_pylist())


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def classify(docs: DataFrame, seeds: int = 8) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, class and sample (one in SAMPLE of the shingles) of every row, and the seed under which each class is one set."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    below = np.uint64((2**64 - 1) // SAMPLE)
    for seed in range(seeds):
        def run(batches, seed=seed):
            for b in batches:
                rows = [(len(s), *class_of(s, seed), s[: np.searchsorted(s, below)].view(np.int64)) for s in _sets(b.column(1))]
                n, number, digest, some = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.binary()), pa.array(some, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class", "digest", "sample"])

        rows = materialise(_text(docs).mapInArrow(run, f"doc_id {kind}, n_shingles long, class long, digest binary, sample array<long>"), "sets")
        if not rows.groupBy("class", "digest").agg(F.lit(1)).groupBy("class").count().where("count > 1").limit(1).count():
            return rows.drop("digest"), seed
    raise RuntimeError("no seed gives one class for each set")


def in_common(rows: DataFrame) -> float:
    """Chance that a shingle of one set is a given one of another, from the samples of the classes."""
    each = rows.select("class", F.explode("sample").alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n"))
    found, others = each.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    return others / found / (found * SAMPLE) if found else 0.0


def buckets(docs: DataFrame, seed: int, sizes: dict[int, int], common: float) -> DataFrame:
    """bucket and class for all sets of two and more classes that share a signature which is not left out."""
    n_sets, total = sum(sizes.values()), count_signatures(sizes, common)
    rounds = max(1, math.ceil(total / max(ROUND_ROWS, PER_SHINGLE * sum(n * many for n, many in sizes.items()))))
    groups = max(rounds, total // GROUP_ROWS)

    def flush(held, first):
        held = sorted(held, key=lambda x: x[1:3])  # equal kinds in a row take next to no bytes
        each = [len(x) for _, _, _, x in held]
        number = np.repeat(np.array([c for c, _, _, _ in held], np.int64), each)
        kind = np.repeat(np.array([(g << 8) | min(r, 255) for _, g, r, _ in held], "<u2"), each)
        sig = np.concatenate([x for _, _, _, x in held])
        group = (((sig >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int32) - np.int32(first)
        order = np.argsort(group, kind="stable")
        group, low, number, kind = group[order], (sig[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), number[order], kind[order]
        cut = np.r_[np.flatnonzero(np.r_[True, np.diff(group) > 0]), len(group)]
        slices = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(group[cut[:-1]]), slices(low), slices(number), slices(kind)], names=["part", "low", "number", "kind"])

    def emit(batches, first, end):
        # Least and greatest upper halves of the signatures of the groups first to end.
        low, high = (np.uint64(-(-(g << 32) // groups) << 32) if g < groups else None for g in (first, end))
        seen: set[int] = set()
        held, many = [], 0
        for b in batches:
            for s in _sets(b.column(1)):
                c, _ = class_of(s, seed)
                if len(s) and c not in seen:
                    seen.add(c)
                    for g, room, x in signatures(s, n_sets, common):
                        if rounds > 1:
                            x = x[(x >= low) & (x < high)] if high is not None else x[x >= low]
                        held.append((c, g, room, x))
                        many += len(x)
                if many > 1_000_000:
                    yield flush(held, first)
                    held, many = [], 0
        if many:
            yield flush(held, first)

    def meet(t: pa.Table) -> pa.Table:
        low, number, kind = (np.concatenate([np.frombuffer(x, d) for x in t.column(c).to_pylist()]) for c, d in (("low", "<u4"), ("number", np.int64), ("kind", "<u2")))
        band = kind >> 8
        order = np.lexsort((number, band, low))
        low, number, kind, band = low[order], number[order], kind[order], band[order]
        key = (low[1:] != low[:-1]) | (band[1:] != band[:-1])
        new = np.r_[True, key | (number[1:] != number[:-1])]  # tasks may each send a class
        low, number, kind, band = low[new], number[new], kind[new], band[new]
        start = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (band[1:] != band[:-1])])
        size = np.diff(np.r_[start, len(low)])
        total = np.r_[np.uint64(0), np.cumsum(mix(number.view(np.uint64)), dtype=np.uint64)]
        start, size = start[size > 1], size[size > 1]
        name = mix(total[start + size] - total[start] + size.astype(np.uint64) * _FACTORS[2] + band[start] * _FACTORS[3])  # of band and members, so that equal buckets are one
        name, first, many = np.unique(name, return_index=True, return_counts=True)
        start, size = start[first], size[first]
        pick = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)
        wide = lambda x: np.repeat(x, size).astype(np.int64)
        return pa.table({"bucket": np.repeat(name.view(np.int64), size), "class": number[pick], "band": band[pick].astype(np.int64), "room": (kind[pick] & 255).astype(np.int64), "size": wide(size), "many": wide(many)})

    def of(first, end):
        parts = _text(docs).mapInArrow(lambda batches: emit(batches, first, end), "part int, low binary, number binary, kind binary")
        # One group a task, whatever their number: hashing would deal several to some.
        found = parts.repartitionById(end - first, "part").groupBy("part").applyInArrow(meet, "bucket long, class long, band long, room long, size long, many long")
        return found.groupBy("bucket", "class", "band", "room", "size").agg(F.sum("many").alias("many"))

    with scratch(docs.sparkSession):
        # Written before the next shuffle, so that the files of the signatures are gone by then.
        found = reduce(DataFrame.union, [materialise(of(groups * r // rounds, groups * (r + 1) // rounds), "round") for r in range(rounds)])
        if rounds > 1:
            found = found.groupBy("bucket", "class", "band", "room", "size").agg(F.sum("many").alias("many"))
        costliest = Window.partitionBy("class", "band").orderBy(F.desc("size"), "bucket")
        kept = found.withColumn("so_far", F.sum("many").over(costliest.rowsBetween(Window.unboundedPreceding, 0))).where("so_far > room")
        return materialise(kept.select("bucket", "class"), "buckets", keep=True)


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """class, set (sorted hashes), its sketch and its size n of the wanted classes, from one document of each."""
    first = rows.groupBy("class").agg(F.min("doc_id").alias("d2"))
    first = materialise(first.join(wanted.select("class").distinct(), "class").withColumnRenamed("class", "c2"), "wanted")
    few = first.count() <= BROADCAST_ROWS
    found = _text(docs).join(F.broadcast(first) if few else first, F.col("doc_id").eqNullSafe(F.col("d2"))).select("text", "c2")

    def run(batches):
        for b in batches:
            out = [(c, s.tobytes(), sketch(s), len(s)) for s, c in zip(_sets(b.column(0)), b.column(1).to_pylist()) if class_of(s, seed)[0] == c]
            number, held, short, n = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(held, pa.binary()), pa.array(short, pa.binary()), pa.array(n, pa.int64())], names=["class", "set", "sketch", "n"])

    sets = found.mapInArrow(run, "class long, set binary, sketch binary, n long")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["class"])  # rows that share a doc_id can show a class twice
    return materialise(sets, "class-sets")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 80 * union.

    A pair may take a whole set along, so pairs move in rounds by hashes of b. Each round moves some VERIFY_BYTES of sets
    or, if that is more, a VERIFY_PART of what `sets` takes, even if no sketch drops a pair.
    """
    pairs = materialise(pairs, "pairs")
    mean, held = sets.agg(F.avg(8 * F.col("n")), F.sum(8 * F.col("n"))).first()
    moved = 2 * pairs.count() * (mean or 0)
    rounds = max(1, math.ceil(moved / max(VERIFY_BYTES, VERIFY_PART * (held or 0))))
    if rounds == 1:
        return _sketched(pairs, sets)
    turn = lambda r: F.pmod(F.xxhash64("b"), F.lit(rounds)) == r
    return reduce(DataFrame.union, [materialise(_sketched(pairs.where(turn(r)), sets), "verified") for r in range(rounds)])


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link; those that sketches show to be too far apart take no sets along."""
    near = materialise(_near(pairs, sets.select("class", "sketch", "n")), "near")
    sets_a, sets_b = (_of(sets.select("class", "set"), near.select(F.col(c).alias("class"))) for c in ("a", "b"))
    return _verify(near, sets_a, sets_b)


def _of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of some classes: the others are left out before they move."""
    return sets.join(_light(classes.select("class").distinct()), "class", "left_semi")


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    left, right = (sketches.select(F.col("class").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))

    def run(batches):
        for b in batches:
            keep = [not too_far(x, y, n) for x, y, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b", F.col("n_a") + F.col("n_b")).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame) -> DataFrame:
    left, right = sets_a.select(F.col("class").alias("a"), F.col("set").alias("set_a")), sets_b.select(F.col("class").alias("b"), F.col("set").alias("set_b"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) < len(q) else (q, p)
                if 100 * len(small) < 80 * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * same >= 80 * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A hub's set joins the short pair rows first, so that what moves by hub is small and what is large moves by b.
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _light(labels: DataFrame) -> DataFrame:
    """labels, marked for a broadcast if its rows are few enough; else joins with it shuffle."""
    return F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels


def components(links: DataFrame) -> DataFrame:
    """class and root, the least class that links reach. Least labels go to neighbours and are then followed one step on, until nothing changes."""
    links = links.where("a <> b")
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))
    # Each class is its own neighbour too, so that one grouping has both its old label and the least one around it.
    both = materialise(links.select(F.inline(ends)), "links")
    labels = materialise(both.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("root")), "labels")
    while True:
        known = _light(labels)
        near = both.join(known.select(F.col("class").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("class"))
        step = near.agg(F.min("r").alias("next"), F.min(F.when(F.col("a") == F.col("b"), F.col("r"))).alias("old"))
        ahead = known.select(F.col("class").alias("next"), F.col("root").alias("r2"))
        new = step.join(ahead, "next").select("class", F.least("next", "r2").alias("root"), (F.least("next", "r2") != F.col("old")).alias("moved"))
        new = materialise(new, "labels")
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        labels = new.drop("moved")


def _apart(found: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, class and root of the buckets whose members have more than one root."""
    named = found.join(_light(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    return materialise(named.join(several, "bucket"), "apart")


def against_hubs(named: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between what is apart from the largest part of its bucket and HUBS members of that part."""
    main = _main(named)
    tries = named.join(main, "bucket").where("root <> main.root").select(F.col("class").alias("b"), F.explode("main.hubs").alias("a"))
    return materialise(verify(tries.select("a", "b").distinct(), sets), "hubs")


def _main(named: DataFrame) -> DataFrame:
    """bucket, main (root, rows n and HUBS members of its largest part), members and crossings (pairs across its parts)."""
    some = F.array(*(F.min_by("class", F.xxhash64("class", F.lit(i))) for i in range(HUBS)))
    parts = named.groupBy("bucket", "root").agg(F.count("*").alias("n"), some.alias("hubs"))
    main = F.max_by(F.struct("root", "n", "hubs"), F.struct("n", "root")).alias("main")
    total = F.sum("n")
    return parts.groupBy("bucket").agg(main, total.alias("members"), ((total * total - F.sum(F.col("n") * F.col("n"))) / 2).alias("crossings"))


def by_centre(named: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and new buckets (bucket, class, low, high) for all that is still apart: one that is low with one that is high.

    Buckets with one main part are taken together. Their centre is what most hubs of the part hold; d is a
    member's difference from it. |x ^ y| = |dx| + |dy| - 2 |dx & dy| for any centre, and x and y link when
    9 |x ^ y| <= |x| + |y|. With f = 9 |d| - |x|, that is |dx & dy| >= (f(x) + f(y)) / 18. Those with
    f(x) + f(y) <= 0 link whatever they share, and all of them link with the member of least f; so what is left has a
    far member x, with f(x) > -least.

    Differences are indexed by prefixes: with c elements in common, x and y share one of the first |d| - c + 1
    elements of each, in one order of the centre's elements. Elements that stand in one part alone come first and are
    not indexed at all, as they link no parts; then the rarer go before the more frequent, so those of the centre that
    many members lack come last. As c depends on both, f is cut into levels, and a member indexes, for each level in
    which partners can be, as much as the least f of that level asks for; a pair meets under its two levels alone, its lower member as low, its higher as high.
    """
    main = materialise(_main(named), "parts")
    members = named.join(main.select("bucket", F.col("main.root").alias("centre_of")), "bucket").select("centre_of", "class", "root").distinct()
    hubs = main.groupBy(F.col("main.root").alias("centre_of")).agg(F.max_by("main.hubs", F.struct("members", "bucket")).alias("hubs"))
    hubs = hubs.select("centre_of", F.explode(F.array_distinct("hubs")).alias("class"))
    sets = sets.select("class", "set")
    hubs = hubs.join(_of(sets, hubs), "class")

    def centre(batches):
        for b in batches:
            out, width = [], []
            for held in b.column(1):
                each = [np.frombuffer(x.as_buffer(), np.uint64) for x in held.values]
                value, n = np.unique(np.concatenate(each), return_counts=True)
                out.append(value[2 * n > len(held)].tobytes())
                width.append(max(18, max(map(len, each)) // LEVELS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(width, pa.int64())], names=["centre_of", "centre", "width"])

    def differ(batches):
        for b in batches:
            d, f, level = [np.empty(0, np.int64)], [], []
            for x, y, width in zip(b.column(3), b.column(4), b.column(5).to_pylist()):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                d.append(np.setxor1d(own, np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True).view(np.int64))
                f.append(9 * len(d[-1]) - len(own))
                level.append(f[-1] // width)
            lists = pa.ListArray.from_arrays(np.cumsum([len(x) for x in d], dtype=np.int32), np.concatenate(d))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(f, pa.int64()), pa.array(level, pa.int64()), lists], names=["centre_of", "class", "root", "f", "level", "d"])

    def index(batches):
        for b in batches:
            name, number, low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty(0, bool)]
            for centre_of, c, f, level, size, least, levels, held in zip(*(b.column(i).to_pylist() for i in range(7)), b.column(7)):
                token = mix(held.values.to_numpy().view(np.uint64))
                for other in levels:
                    if max(f, other["high"]) <= -least:
                        continue  # both are near
                    common = max(1, -(-(f + other["low"]) // 18))
                    if common > min(size, other["longest"]):
                        continue
                    x = token[: max(0, len(token) + 1 - common)]
                    pair = min(level, other["level"]) * int(_FACTORS[3]) + max(level, other["level"]) * int(_FACTORS[4]) + centre_of
                    name.append(mix(x + np.uint64(pair % 2**64)).view(np.int64))
                    number.append(np.full(len(x), c))
                    low.append(np.full(len(x), level <= other["level"]))
                    high.append(np.full(len(x), level >= other["level"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (name, number, low, high)], names=["bucket", "class", "low", "high"])

    centres = materialise(hubs.groupBy("centre_of").agg(F.collect_list("set")).mapInArrow(centre, "centre_of long, centre binary, width long"), "centres")
    small = centres.agg(F.coalesce(F.sum(F.length("centre") + 24), F.lit(0))).first()[0] <= 16 * BROADCAST_ROWS
    known = members.join(_of(sets, named), "class").join(F.broadcast(centres) if small else centres, "centre_of")
    deltas = materialise(known.select("centre_of", "class", "root", "set", "centre", "width").mapInArrow(differ, "centre_of long, class long, root long, f long, level long, d array<long>"), "deltas")
    levels = deltas.groupBy("centre_of", "level").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.max(F.size("d")).alias("longest"), F.min_by("class", F.struct("f", "class")).alias("a"))
    levels = levels.groupBy("centre_of").agg(F.min("low").alias("least"), F.min_by("a", F.struct("low", "a")).alias("a"), F.collect_list(F.struct("level", "low", "high", "longest")).alias("levels"))
    levels = materialise(levels, "levels")
    small = levels.agg(F.coalesce(F.sum(24 + 24 * F.size("levels")), F.lit(0))).first()[0] <= 16 * BROADCAST_ROWS
    levels = F.broadcast(levels) if small else levels
    links = materialise(deltas.drop("d").join(levels.drop("levels"), "centre_of").where("f + least <= 0 and a <> class").select("a", F.col("class").alias("b")), "sums")
    elements = deltas.select("centre_of", "class", "root", F.explode("d").alias("e"))
    shared = elements.groupBy("centre_of", "e").agg(F.count("*").alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("centre_of", "e", "n")
    tokens = elements.drop("root").join(shared, ["centre_of", "e"]).groupBy("centre_of", "class").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("tokens"))
    rows = deltas.select("centre_of", "class", "f", "level", F.size("d").alias("size")).join(tokens, ["centre_of", "class"]).join(levels.drop("a"), "centre_of")
    rows = rows.select("centre_of", "class", "f", "level", "size", "least", "levels", F.col("tokens.e").alias("tokens"))
    return links, materialise(rows.mapInArrow(index, "bucket long, class long, low boolean, high boolean"), "buckets")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    with scratch(docs.sparkSession):
        return materialise(_link(docs), "linked", keep=True)


def _link(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    rows, seed = classify(docs)
    common, rows = in_common(rows), rows.drop("sample")
    sizes = {n: many for n, many in rows.select("class", "n_shingles").distinct().groupBy("n_shingles").count().collect()}
    found = buckets(docs, seed, sizes, common)
    sets = sets_of(docs, rows, found, seed)
    hubs = found.groupBy("bucket").agg(F.min("class").alias("a"))
    stars = found.withColumnRenamed("class", "b").join(hubs, "bucket").where("a <> b").select("a", "b").distinct()
    links = materialise(verify(stars, sets), "stars")
    named = _apart(found, components(links))
    links = links.union(against_hubs(named, sets))
    sums, found = by_centre(_apart(named.select("bucket", "class"), components(links)), sets)
    links = links.union(sums)
    roots = components(links)
    # What is left: all pairs in a bucket whose roots differ.
    named = _apart(found, roots)
    one, two = (named.where(side).select("bucket", F.col("class").alias(c), F.col("root").alias(f"root_{c}")) for side, c in (("low", "a"), ("high", "b")))
    rest = one.join(two, "bucket").where("root_a <> root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = materialise(verify(rest, sets), "crossings")
    if more.limit(1).count():
        roots = components(links.union(more))
    labelled = rows.join(_light(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = labelled.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id."""
    key, = unused(docs.columns, "q_key")
    stay = link(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col(key)), "left_semi")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_each(docs)
