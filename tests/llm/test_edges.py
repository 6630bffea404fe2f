"""Lines, archives of other writers, packing of one long document, and stages over rows that are odd, run and not only planned."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import best_fit_packing, curriculum_mix, exact_dedup, line_dedup, ngram_join, quality_rules, warc
from quillmark.llm.common import new_path
from tests.llm.test_operators import DOCS, EDGE, SF
from tests.oracle import same


def test_lines_end_at_line_feeds_alone(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["alpha\rbeta", "alpha\rbeta", "a\u2028b", "a\u2028b", "c\x85d", "c\x85d", "x\n \ny", "x\n \ny", "x\n\n", "x\n\n", "\n \n", "\n \n"] * 2)]
    rnd = random.Random(8)
    rows += [(len(rows) + i, "".join(rnd.choices(["a", "b", "\n", "\r", "\u2028", " ", "\n\n"], k=12))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/d")
    part = next((tmp_path / "d").glob("part-*"))
    part.rename(tmp_path / "documents.parquet")
    for query, sql in ((line_dedup.op9_line_dedup, line_dedup.OP9_SQL), (line_dedup.op9_line_runs, line_dedup.OP9_RUNS_SQL)):
        assert same(query(spark, str(tmp_path)), sql, str(tmp_path))


def _member(head: list[str], block: bytes) -> bytes:
    return gzip.compress("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\xc3\xa9</html>"
    right, wrong = (base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (body, b"other"))
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    uuid = "WARC-Record-ID: <urn:uuid:0f3c8a52-1111-2222-3333-444455556666>"
    kind = "Content-Type: application/http; msgtype=response"
    made = [
        _member(["WARC-Type: warcinfo", uuid, "Content-Type: application/warc-fields"], b"software: x\r\n"),
        _member(["WARC-Type: request", uuid, "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        _member(["WARC-Type: response", uuid, "WARC-Target-URI: http://a", kind], http),
        _member(["WARC-Type: response", uuid, f"warc-payload-digest: SHA1:{right}", kind], http),
        _member(["WARC-Type: response", uuid, f"WARC-Payload-Digest: sha1:{wrong}", kind], http),
        _member(["WARC-Type: metadata", uuid], b"fetch: 3"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", sum(map(len, made)), len(made))], "path string, bytes long, records long")
    for split in (50, 1 << 20):
        records = warc.read_archives(manifest, split)
        got = sorted((r["record_type"], r["page_id"], bytes(r["payload"])) for r in records.collect())
        assert got == [("metadata", None, b"fetch: 3"), ("request", None, b""), ("response", None, body), ("response", None, body), ("warcinfo", None, b"software: x\r\n")]
        with pytest.raises(RuntimeError, match="5 records were read of 6"):
            warc.whole(records, manifest)


def test_packing_of_long_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "a b"), (3, long[:9000])], "doc_id long, text string")
    got = best_fit_packing.pack(best_fit_packing.tokenise(docs, keep_ids=False)).toPandas()
    assert len(got) > 300 and not got.duplicated(["sequence_id", "offset"]).any() and not got.duplicated(["doc_id", "piece"]).any()
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 2048 and len(total) == -(-got.length.sum() // 2048)


def test_exchanges_of_two_for_one():
    square = lambda b: int((np.bincount(b, weights=sizes) ** 2).sum())
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = np.concatenate([rng.integers(1, 120, 150), rng.integers(500, 1500, 60)])
        first = best_fit_packing.best_fit(sizes)
        bins = best_fit_packing.local_search(sizes, first)
        assert np.bincount(bins, weights=sizes).max() <= 2048 and bins.max() <= first.max() and square(bins) >= square(first)


def test_stages_over_odd_rows(spark):
    """Nulls, repeated rows, ties, clashing names and empty tables go through every filtering and ordering stage."""
    edge = spark.createDataFrame(EDGE, DOCS)
    clash = edge.withColumns({"Q_KEY": F.col("doc_id"), "ROW": F.lit("r"), "kept": F.lit(1), "q_num": F.col("n_chars"), "N_WORDS": F.lit(2), "Q_GONE": F.lit(0)})
    for docs in (edge, clash, edge.limit(0)):
        n = docs.count()
        for run, least, most in ((exact_dedup.keep_one, 5, 7), (ngram_join.one_each, 6, 8), (line_dedup.dedup_lines, 10, 10), (line_dedup.dedup_runs, 10, 10), (curriculum_mix.mix, 0, 20), (lambda d: quality_rules.filter_quality(d, []), 2, 3)):
            got = run(docs)
            assert got.columns[: len(docs.columns)] == docs.columns
            rows = got.collect()
            assert len(rows) == 0 if not n else least <= len(rows) <= most, (run, len(rows))
    one = edge.where("doc_id <> 6 and doc_id is not null").unionByName(edge.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long")))
    assert {r["doc_id"] for r in exact_dedup.keep_one(one).collect()} == {4, 5, 7, 8}
    assert {r["doc_id"] for r in ngram_join.one_each(one).collect()} == {1, 2, 3, 5, 7, 8}


def test_mix_of_ids_and_of_rows_agree(spark):
    """Unique ids go by ids and sizes, repeated ones with their texts; both give the same copies in the same order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    plain = [r["doc_id"] for r in curriculum_mix.mix(docs).collect()]
    flat = curriculum_mix.ordered(curriculum_mix.places(docs.select("doc_id", "source", curriculum_mix.size(F.col("text")).alias("size"))))
    assert plain == [r["doc_id"] for r in flat.orderBy("position", "doc_id").collect()]
