"""Best-fit packing with swap-based local search.

``tokenise`` turns each document into ids and one end id and cuts only those longer than a sequence: the first piece
takes the remainder, so every later one fills a sequence. Pieces that fill a sequence have one of their own. ``pack``
deals all others into groups of about `group_size` pieces by a digest of (doc_id, piece), and packs each group by
itself: best-fit decreasing, then a local search that empties the bins with least fill by moves, exchanges of one or
two of their documents for one of a fuller underfull bin (all pairs), and of one for two neighbours in size of a bin.
Each step raises the sum of squared fills, so the search ends; bins that could not be emptied are tried again after
another was. Packing by groups costs a few sequences a group against packing all pieces at once.

Defined results: null text is an empty one (one piece, the end id alone); repeated rows are packed each, and ties in
size are taken in order of doc_id and piece; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import bpe
from quillmark.llm.common import materialise, small_batches, table

CAPACITY = 2048
END = 0
GROUP_SIZE = 32768


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def tokenise(docs: DataFrame, tokenizer: tuple = (), capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every document."""
    small_batches(docs.sparkSession)
    how = tokenizer or bpe.public()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = bpe.load(*how)
        for b in batches:
            doc, rows, ids_out = [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(END))
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    doc.append(i)
                    rows.append((k, start, length, zlib.crc32(part.astype("<u4").tobytes())))
                    if keep_ids:
                        ids_out.append(part.astype(np.int32))
            t = np.array(rows, np.int64).reshape(len(rows), 4)
            columns = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(t[:, 0].astype(np.int32)), *(pa.array(t[:, j]) for j in (1, 2, 3))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each size, by best-fit decreasing. Bins stand by free room, and a bit set finds the least room that is enough."""
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        enough = free >> s
        if enough:
            r = s + (enough & -enough).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        room[r - s].append(b)
        free |= 1 << (r - s)
    return out


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bins after moves and exchanges out of the bins with least fill. The fill given away goes to fuller bins only."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    stuck: set[int] = set()
    members: dict[int, list[int]] = {}
    for i, b in enumerate(bins.tolist()):
        members.setdefault(b, []).append(i)

    def put(i: int, b: int) -> None:
        members[int(bins[i])].remove(i)
        fill[bins[i]] -= sizes[i]
        bins[i] = b
        fill[b] += sizes[i]
        members[b].append(i)

    while len(members) > least:
        under = [b for b in members if b not in stuck and fill[b] < capacity]
        if not under:
            break
        v = min(under, key=lambda b: (fill[b], b))
        open_bins = (fill < capacity) & (fill >= fill[v])  # only fuller bins take, or squares would not grow
        open_bins[v] = False
        if int((capacity - fill[open_bins]).sum()) < fill[v]:
            break  # nor can any bin with more fill be emptied
        near = np.flatnonzero(open_bins[bins])
        near = near[np.lexsort((sizes[near], bins[near]))]
        moved = True
        while moved and members[v]:
            moved = False
            mine = sorted(members[v], key=lambda i: -sizes[i])
            places = np.flatnonzero(open_bins)
            slack = capacity - fill
            for x in mine:
                fits = places[slack[places] >= sizes[x]]
                if len(fits):
                    put(x, int(fits[np.argmin(slack[fits])]))
                    moved = True
                    break
            if moved:
                continue
            near = near[open_bins[bins[near]]]
            there = bins[near]
            # One or two of v for one of a fuller bin: ways[s] has the documents of v that sum to s, reach[r] the largest such s up to r.
            ways = {int(sizes[x] + sizes[y]): [x, y] for k, x in enumerate(mine) for y in mine[k + 1 :]} | {int(sizes[x]): [x] for x in mine}
            has = np.zeros(2 * capacity + 1, np.int64)
            has[list(ways)] = list(ways)
            reach = np.maximum.accumulate(has)
            gain = reach[np.minimum(sizes[near] + slack[there], 2 * capacity)] - sizes[near] if len(near) else np.empty(0)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > 0:
                for x in ways[int(gain[k] + sizes[near[k]])]:
                    put(x, int(there[k]))
                put(int(near[k]), v)
                moved = True
            elif len(near) > 1:
                for x in mine:  # one for two neighbours in size of one bin
                    gain = sizes[x] - sizes[near[:-1]] - sizes[near[1:]]
                    gain = np.where((there[:-1] == there[1:]) & (gain > 0) & (gain <= slack[there[:-1]]), gain, 0)
                    k = int(np.argmax(gain))
                    if gain[k]:
                        put(x, int(there[k]))
                        put(int(near[k]), v)
                        put(int(near[k + 1]), v)
                        moved = True
                        break
            if moved:
                near = np.flatnonzero(open_bins[bins])
                near = near[np.lexsort((sizes[near], bins[near]))]
        if members[v]:
            stuck.add(v)
        else:
            del members[v]
            stuck.clear()  # other bins have changed
    return np.unique(bins, return_inverse=True)[1]


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each size; full sizes have a bin of their own and take no part in the search."""
    out = np.empty(len(sizes), np.int64)
    full = sizes >= capacity
    out[full] = np.arange(full.sum())
    rest = sizes[~full]
    if len(rest):
        out[~full] = full.sum() + local_search(rest, best_fit(rest, capacity), capacity)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """pieces with sequence_id and offset. Pieces that fill a sequence have one of their own (a negative id) and join no group."""
    pieces = materialise(pieces, "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // group_size))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].to_numpy(np.int64)
        bins = pack_sizes(sizes, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        before = np.cumsum(sizes[order]) - sizes[order]
        starts = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(bins)]))
        frame["sequence_id"] = int(key[0]) * 2**32 + bins
        frame["offset"] = offset
        return frame[[f.name for f in schema.fields]]

    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    return full.union(rest.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("pack_group")).applyInPandas(run, schema))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(tokenise(docs, keep_ids=False))
