"""All pairs of rows in bounded blocks: rows are dealt into blocks in order of a size, and two blocks meet in a task."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block at most (rows of one size apart), and blocks that a small input is cut into.
BLOCK_BYTES, LEAST_BLOCKS = 24 << 20, 6
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df from a copy in the folder that driver and executors share; the shuffle files that it took go with the write."""
    spark = df.sparkSession
    path, before = f"{_shared(spark)}/{tag}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or _own(spark.sparkContext.master, spark.sparkContext.applicationId)).rstrip("/")


@lru_cache(maxsize=None)
def _own(master: str, application: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="quillmark-")


def dealt(rows: DataFrame, size: Column, weight: Column, ratio: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with `own`, their block, once for each tile (i, j), i <= j, that the block is in.

    Blocks follow each other in order of size (sixteenths of powers of two) and hold some block_bytes by weight; tiles in which all sizes
    differ by more than the ratio are left out. rows is read twice."""
    step = F.when(size > 0, F.floor(F.log2(size.cast("double")) * 16) + 1).otherwise(0).cast("int")
    rows = rows.withColumn("_step", step)
    steps = rows.groupBy("_step").agg(F.sum(weight.cast("long")).alias("bytes"), F.min(size).alias("lo"), F.max(size).alias("hi")).orderBy("_step").collect()  # a few hundred
    most = max(1, min(block_bytes, sum(s["bytes"] for s in steps) // LEAST_BLOCKS))
    blocks, where, held = [], [], most
    for s in steps:
        if s["bytes"] > most:  # several blocks, dealt by chance
            n = -(-s["bytes"] // most)
            where.append((s["_step"], len(blocks), n))
            blocks += [[s["lo"], s["hi"]]] * n
            held = most
            continue
        if held + s["bytes"] > most:
            blocks.append([s["lo"], s["hi"]])
            held = 0
        held += s["bytes"]
        blocks[-1] = [blocks[-1][0], s["hi"]]
        where.append((s["_step"], len(blocks) - 1, 1))
    tiles = [(own, i, j) for j, y in enumerate(blocks) for i, x in enumerate(blocks[: j + 1]) if x[1] >= ratio * y[0] for own in sorted({i, j})]
    spark = rows.sparkSession
    by_step = F.broadcast(spark.createDataFrame(where, "_step int, _first int, _parts int"))
    by_block = F.broadcast(spark.createDataFrame(tiles, "own int, i int, j int"))
    own = (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int")
    return rows.join(by_step, "_step").withColumn("own", own).drop("_step", "_first", "_parts").join(by_block, "own")


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, end to end, and the length of each list."""
    n = pc.list_value_length(column).to_numpy().astype(np.int64)
    return pc.list_flatten(column).to_numpy(), n


class Vectors:
    """Vectors of a tile and exact cosines of pairs of them, as functions.vector.cosine has them."""

    def __init__(self, column: pa.ChunkedArray):
        values, self.n = lists(column)
        self.v = np.zeros((len(self.n), self.n.max(initial=0)))
        self.v[np.arange(self.v.shape[1]) < self.n[:, None]] = values
        self.size = np.sqrt(np.einsum("ij,ij->i", self.v, self.v))

    def cosine(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        size = self.size[r] * self.size[c]
        dot = np.empty(len(r))
        for at in range(0, len(r), 1 << 14):
            s = slice(at, at + (1 << 14))
            dot[s] = np.einsum("ij,ij->i", self.v[r[s]], self.v[c[s]])
        return np.where((self.n[r] != self.n[c]) | (size < 1.19e-7), 0.0, dot / np.maximum(size, 1e-300))

    def pairs(self, left: range, right: range, least: float, step: int = 1024):
        """(r, c, cosine) of the pairs of at least `least`, in parts. Single precision finds them with some room, double decides."""
        unit = (self.v / np.maximum(self.size, 1e-300)[:, None]).astype(np.float32)
        room = least - 1e-5 - 2.4e-7 * unit.shape[1]
        for p in range(left.start, left.stop, step):
            for q in range(p if left == right else right.start, right.stop, step):
                found = np.flatnonzero(unit[p : min(p + step, left.stop)] @ unit[q : (end := min(q + step, right.stop))].T >= room)
                r, c = p + found // (end - q), q + found % (end - q)
                if p == q:
                    r, c = r[r < c], c[r < c]
                s = self.cosine(r, c)
                keep = s >= least
                yield r[keep], c[keep], s[keep]


class Sets:
    """Sets of 64-bit numbers in a tile, each in order, rows in order of (group, size), and the pairs of some Jaccard."""

    def __init__(self, column: pa.ChunkedArray):
        self.values, self.n = lists(column)
        self.end = np.concatenate(([0], np.cumsum(self.n)))
        self.sum, some = np.zeros(len(self.n), np.int64), self.n > 0
        if some.any():
            self.sum[some] = np.add.reduceat(self.values, self.end[:-1][some])  # modulo 2**64

    def parts(self, rows: range, least: int = 64, cells: int = 1 << 20) -> list[tuple[int, int, int]]:
        """(first, end, buckets) of runs of rows: at least four buckets for each member of the largest set."""
        out, at = [], rows.start
        while at < rows.stop:
            d, end = least, at
            while end < rows.stop and end - at < 1024:
                wider = max(d, 1 << int(min(4 * self.n[end], 1 << 16)).bit_length())
                if (end - at + 1) * wider > cells and end > at:
                    break
                d, end = wider, end + 1
            out.append((at, end, d))
            at = end
        return out

    def counts(self, p: int, q: int, d: int, own: list[int], j: float) -> np.ndarray:
        """Members of rows p to q by bucket, and two columns by which a product of two rows also takes off what Jaccard j needs (in sixteenths, so sums are exact)."""
        s = slice(self.end[p], self.end[q])
        x = np.empty((q - p, d + 2), np.float64 if self.n[p:q].max() >> 18 else np.float32)
        x[:, :d] = np.bincount(np.repeat(np.arange(q - p), self.n[p:q]) * d + (self.values[s] & (d - 1)), minlength=(q - p) * d).reshape(q - p, d)
        x[:, d + own[0]], x[:, d + own[1]] = -np.floor(self.n[p:q] * (j / (1 + j) * 16) - 1e-6) / 16, 1
        return x

    def pairs(self, left: range, right: range, j: float, wanted):
        """(r, c) of all pairs with a Jaccard of at least j, in parts. Equal buckets hold at least what two sets share, so no
        pair is lost; sets of one size and sum are equal, and what else is left is counted exactly."""
        table = np.zeros(1 << 22, bool)
        ps, qs = self.parts(left), self.parts(right)
        for k, (p, pe, dp) in enumerate(ps):
            made = {}
            for q, qe, dq in qs[k:] if left == right else qs:
                a, b = self.n[p:pe], self.n[q:qe]
                if a.max() < j * b.min() or b.max() < j * a.min() or not wanted(slice(p, pe), slice(q, qe)):
                    continue
                d = max(dp, dq)
                if d not in made:
                    made[d] = self.counts(p, pe, d, [0, 1], j)
                hit = np.flatnonzero(made[d] @ self.counts(q, qe, d, [1, 0], j).T >= 0)
                r, c = p + hit // (qe - q), q + hit % (qe - q)
                if p == q:
                    r, c = r[r < c], c[r < c]
                equal = (self.n[r] == self.n[c]) & (self.sum[r] == self.sum[c])
                yield r[equal], c[equal]
                yield self.exact(r[~equal], c[~equal], j, table)

    def exact(self, r: np.ndarray, c: np.ndarray, j: float, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (r in order) that have a Jaccard of at least j: first by 22 bits of each member, which can only find more, then by all."""
        keep = np.zeros(len(r), bool)
        edges = np.flatnonzero(np.diff(r, prepend=-1, append=-1)) if len(r) else np.zeros(1, np.int64)
        for x, y in zip(edges[:-1], edges[1:]):
            own = self.values[self.end[r[x]] : self.end[r[x] + 1]]
            mark = own >> 30 & (len(table) - 1)
            table[mark] = True
            for at in range(x, y, 1024):
                at = np.arange(at, min(at + 1024, y))
                at = at[self.passes(r[at], c[at], table[self.members(c[at]) >> 30 & (len(table) - 1)], j)]
                members = self.members(c[at])
                place = np.minimum(np.searchsorted(own, members), max(len(own) - 1, 0))
                same = own[place] == members if len(own) else np.zeros(len(members), bool)
                keep[at[self.passes(r[at], c[at], same, j)]] = True
            table[mark] = False
        return r[keep], c[keep]

    def members(self, c: np.ndarray) -> np.ndarray:
        n = self.n[c]
        return self.values[np.repeat(self.end[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def passes(self, r: np.ndarray, c: np.ndarray, same: np.ndarray, j: float) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(same)))
        ends = np.cumsum(self.n[c])
        both = np.minimum(total[ends] - total[ends - self.n[c]], self.n[r])
        union = self.n[r] + self.n[c] - both
        return np.where(union == 0, 1.0, both / np.maximum(union, 1)) >= j
