"""Notes: recall, duplicates at saving, contradictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as K
from quillmark.functions import text as T
from quillmark.functions import vector as V
from quillmark.operators import tiles

#: Bytes of the texts and vectors that two blocks of contradictions() have each.
TEXT_BLOCK_BYTES = 40 << 20


def access_recency(last: Column, now: Column) -> Column:
    """1 / (1 + days / 30) from epoch seconds; 0 if never, and no time before now is negative."""
    days = F.greatest(F.lit(0.0), (now - last) / 86400.0)
    return F.when(last.isNull(), 0.0).otherwise(1 / (1 + days / 30))


def recency_rank(memories: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, with 1 - place / count. With a limit (as recall has) one task sorts `limit` rows."""
    newest = memories.orderBy(F.desc("created_at"), F.desc("id"))
    rows = newest.limit(limit) if limit else newest
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))) - 1
    return rows.withColumn("recency", 1 - place / F.count("*").over(Window.partitionBy()))


def recall(memories: DataFrame, query: str, vector: list[float], k: int = 5, category: str | None = None, now: int | None = None) -> DataFrame:
    """The k best of the newest notes: meaning, keywords, and recency, half of it for age and half for the last access
    (epoch seconds in last_accessed_at, if that column is there); cut to k first, then by the least score."""
    pool = memories.where(F.col("category") == category) if category else memories
    pool = recency_rank(pool, K.RECALL_CANDIDATES)
    q = F.array(*map(F.lit, map(float, vector)))
    score = K.RECALL_SEMANTIC * V.cosine(F.col("embedding"), q) + T.keyword_score(F.col("content"), query, K.RECALL_KEYWORD) + K.RECALL_RECENCY / 2 * F.col("recency")
    if "last_accessed_at" in memories.columns:
        score = score + K.RECALL_RECENCY / 2 * access_recency(F.col("last_accessed_at"), F.lit(now) if now is not None else F.unix_timestamp())
    best = pool.withColumn("score", score).orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(k)
    return best.where(F.col("score") > K.RECALL_MIN)


def mark_accessed(memories: DataFrame, returned: DataFrame, now: int) -> DataFrame:
    """memories with last_accessed_at set for the returned ids."""
    hit = returned.select("id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(hit, "id", "left").withColumn("last_accessed_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_accessed_at"))).drop("_hit")


def pairs_by_cosine(rows: DataFrame, least: float, id_col: str = "id", vec_col: str = "embedding", block_rows: int = 2000) -> DataFrame:
    """(a, b, cosine) with a < b for all pairs of at least `least`. Blocks of rows meet two by two in matrix products."""
    n = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    with_others = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    dealt = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), block.alias("own")).select("*", with_others).select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        i, j = (int(k) for k in key)
        left, right = x[x.own == i], x[x.own == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64"})
        p, q = (np.stack(y.v.to_numpy()).astype(float) for y in (left, right))
        size = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        cos = np.where(size < 1.19e-7, 0.0, p @ q.T / np.maximum(size, 1e-300))
        r, c = np.nonzero(cos >= least)
        a, b = left.id.to_numpy()[r], right.id.to_numpy()[c]
        keep = a < b if i == j else a != b
        a, b, s = a[keep], b[keep], cos[r, c][keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": s})

    return dealt.groupBy("i", "j").applyInPandas(meet, "a long, b long, cosine double")


class _Texts:
    """Texts as arrays of characters without ASCII case, each as narrow as it can be."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        column = column.cast("binary")
        self.chars = [self.of(column[k].as_py()) for k in order.tolist()]

    @staticmethod
    def of(raw: bytes) -> np.ndarray:
        low = raw.lower()
        if low.isascii():
            return np.frombuffer(low, np.uint8)
        text = low.decode(errors="replace")
        top = max(text)
        return np.frombuffer(*((text.encode("latin-1"), np.uint8) if top < "\u0100" else (text.encode("utf-16-le"), np.uint16) if top < "\U00010000" else (text.encode("utf-32-le"), np.uint32)))

    def divergence(self, r: np.ndarray, c: np.ndarray):
        """functions.text.divergence of each pair."""
        for x, y in zip(r.tolist(), c.tolist()):
            x, y = self.chars[x], self.chars[y]
            n, longest = min(len(x), len(y)), max(len(x), len(y))
            yield (np.count_nonzero(x[:n] != y[:n]) + longest - n) / longest if longest else 0.0


def contradictions(memories: DataFrame, least: float = K.CONTRADICTION_COSINE, days: int = K.CONTRADICTION_DAYS, divergence: float = K.CONTRADICTION_DIVERGENCE, limit: int | None = None) -> DataFrame:
    """Pairs of like notes, some days apart, whose texts differ; with a limit at least the `limit` most alike of them (by
    cosine to 6 places, then ids). Texts meet in the blocks that vectors meet in, so none is moved for a pair."""
    side = memories.select(F.col("id").cast("long").alias("id"), "content", "embedding", T.pseudo_days(F.col("created_at")).cast("int").alias("day"))
    notes = tiles.written(side.where("id is not null and content is not null and embedding is not null and day is not null"), "notes")
    dealt = tiles.dealt(notes, F.lit(0), F.octet_length("content") + F.size("embedding") * 4 + 64, 0.0, TEXT_BLOCK_BYTES)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64()), ("divergence", pa.float64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        order = np.argsort(t["own"].to_numpy() != i, kind="stable")
        texts, t = _Texts(t["content"], order), t.drop_columns("content").take(order)
        n, ids, day = int((t["own"].to_numpy() == i).sum()), t["id"].to_numpy(), t["day"].to_numpy()
        vectors, best = tiles.Vectors(t["embedding"]), []
        for r, c, s in vectors.pairs(range(n), range(n) if i == j else range(n, len(ids)), least):
            keep = (np.abs(day[r] - day[c]) >= days) & (ids[r] != ids[c])
            r, c, s = r[keep], c[keep], s[keep]
            if limit is None:
                d = np.fromiter(texts.divergence(r, c), float, len(r))
                r, c, s, d = (x[d >= divergence] for x in (r, c, s, d))
                yield pa.record_batch([np.minimum(ids[r], ids[c]), np.maximum(ids[r], ids[c]), s, d], schema=schema)
                continue
            a, b, places = np.minimum(ids[r], ids[c]), np.maximum(ids[r], ids[c]), -np.round(s, 6)
            order = np.lexsort((b, a, places))
            for at, d in zip(order, texts.divergence(r[order], c[order])):
                row = (places[at], a[at], b[at], s[at], d)
                if len(best) >= limit and row >= best[-1]:
                    break
                if d >= divergence:
                    best = sorted([*best, row])[:limit]
        if best:
            yield pa.record_batch([np.array([x[k] for x in best]) for k in (1, 2, 3, 4)], schema=schema)

    return dealt.groupBy("i", "j").applyInArrow(meet, "a long, b long, cosine double, divergence double")


def contradiction_review(memories: DataFrame, limit: int, least: float = K.CONTRADICTION_COSINE, **options) -> DataFrame:
    """The `limit` most alike contradictions (by cosine to 6 places, then ids) as older_id and newer_id (by created_at, then id), similarity, divergence."""
    age = lambda s: memories.select(F.col("id").alias(s), F.col("created_at").alias(f"{s}_at"))
    best = contradictions(memories, least, limit=limit, **options).orderBy(F.round("cosine", 6).desc(), "a", "b").limit(limit)
    first = F.struct("a_at", "a") <= F.struct(F.col("b_at"), F.col("b"))
    dated = best.join(age("a"), "a").join(age("b"), "b")
    return dated.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("older_id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("newer_id"), F.col("cosine").alias("similarity"), "divergence").orderBy(F.desc("similarity"), "older_id", "newer_id")


def save_outcomes(new: DataFrame, memories: DataFrame, cosine: float = K.DUPLICATE_COSINE, jaccard: float = K.DUPLICATE_JACCARD) -> DataFrame:
    """Outcome for each new note: merged into, or linked to, its most alike note that passes both gates, else inserted.

    new and memories: id, content, category, embedding. Word sets (as 64-bit hashes of the words) meet in blocks of like
    size, and each block yields the best note for each new one, so no list of pairs is moved. new is memories if each
    note is held against the others."""
    if jaccard <= 0:
        raise ValueError("jaccard is above 0")
    words = lambda d, is_new, is_old: d.select("id", "category", "embedding", F.array_sort(F.array_distinct(F.transform(T.token_set(F.col("content")), lambda x: F.xxhash64(x)))).alias("w"), F.lit(is_new).alias("is_new"), F.lit(is_old).alias("is_old"))
    notes = tiles.written(words(new, True, True) if new is memories else words(new, True, False).unionByName(words(memories, False, True)), "notes")
    weight = F.size("w") * 8 + F.size("embedding") * 8 + 64
    dealt = tiles.dealt(notes.where("w is not null and embedding is not null"), F.size("w"), weight, jaccard)

    def meet(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        order = np.lexsort((pc.list_value_length(t["w"]).to_numpy(), t["is_old"].to_numpy(), t["own"].to_numpy() != i))
        t = t.take(order)
        n, ids, is_new, is_old = int((t["own"].to_numpy() == i).sum()), t["id"].to_numpy(), t["is_new"].to_numpy(), t["is_old"].to_numpy()
        left, right = range(n), range(n) if i == j else range(n, len(ids))
        wanted = lambda x, y: is_new[x].any() and is_old[y].any() or is_old[x].any() and is_new[y].any()
        vectors, sets, category, top, of = tiles.Vectors(t["embedding"]), tiles.Sets(t["w"]), t["category"], np.full(len(ids), -np.inf), np.full(len(ids), -1)
        del t
        for r, c in sets.pairs(left, right, jaccard, wanted):
            s = vectors.cosine(r, c)
            a, b, s = np.concatenate((r, c)), np.concatenate((c, r)), np.concatenate((s, s))
            keep = (s >= cosine) & (s >= top[a]) & is_new[a] & is_old[b] & (ids[a] != ids[b])
            a, b, s = a[keep], b[keep], s[keep]
            first = np.lexsort((ids[b], -s, a))
            first = first[np.diff(a[first], prepend=-1) != 0]
            a, b, s = a[first], b[first], s[first]
            better = (s > top[a]) | (of[a] < 0) | (ids[b] < ids[of[a]])
            top[a[better]], of[a[better]] = s[better], b[better]
        a = np.flatnonzero(of >= 0)
        return pa.table({"new_id": ids[a], "old_id": ids[of[a]], "old_category": category.take(of[a]), "cosine": top[a]})

    found = dealt.groupBy("i", "j").applyInArrow(meet, "new_id long, old_id long, old_category string, cosine double")
    best = found.groupBy("new_id").agg(F.max_by(F.struct("old_id", "old_category", "cosine"), F.struct("cosine", (-F.col("old_id")).alias("first"))).alias("best"))
    out = notes.where("is_new").select(F.col("id").alias("new_id"), F.col("category").alias("new_category")).join(best, "new_id", "left")
    return out.select("new_id", F.when(F.col("best").isNull(), "inserted").when(F.col("best.old_category") == F.col("new_category"), "merged").otherwise("linked").alias("outcome"), F.col("best.old_id").alias("old_id"))


def checked(content: str, category: str, tags: str, held: int) -> None:
    """Raises where a note is empty, too large or one too many (lengths in bytes)."""
    if not content:
        raise ValueError("a note needs content")
    for name, text, most in (("content", content, K.NOTE_BYTES), ("category", category, 100), ("tags", tags, 500)):
        if len(text.encode()) > most:
            raise ValueError(f"{name} has more than {most} bytes")
    if held >= K.MOST_NOTES:
        raise ValueError(f"there are {held} notes of at most {K.MOST_NOTES}")


def saved(memories: DataFrame, new: DataFrame, now: int, cosine: float = K.DUPLICATE_COSINE, jaccard: float = K.DUPLICATE_JACCARD) -> DataFrame:
    """memories after saving the new notes: merged ones are appended to (unless their text is there already) and dated, linked ones point to their peer.

    Both: id, content, category, embedding; memories also linked_id and updated_at. New notes that merge into one note
    are appended in order of id; the notes to merge into are those that were there before."""
    outcome = save_outcomes(new, memories, cosine, jaccard)
    merged = new.join(outcome.where("outcome = 'merged'"), new["id"] == F.col("new_id")).select(F.col("old_id").alias("id"), F.struct(F.col("id").alias("at"), F.col("content").alias("more")).alias("part"))
    parts = merged.groupBy("id").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # few notes are alike enough to merge into one
    grown = F.aggregate("parts", F.col("content"), lambda s, p: F.when(F.contains(s, p["more"]), s).otherwise(F.concat(s, F.lit("\n— "), p["more"])))
    old = memories.join(parts, "id", "left").select("id", F.when(F.col("parts").isNull(), F.col("content")).otherwise(grown).alias("content"), "category", "embedding", "linked_id", F.when(F.col("parts").isNull(), F.col("updated_at")).otherwise(F.lit(now)).cast("long").alias("updated_at"))
    fresh = new.join(outcome.where("outcome <> 'merged'"), new["id"] == F.col("new_id")).select("id", "content", "category", "embedding", F.when(F.col("outcome") == "linked", F.col("old_id")).alias("linked_id"), F.lit(None).cast("long").alias("updated_at"))
    return old.unionByName(fresh)
