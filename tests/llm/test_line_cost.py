"""How often op9 cuts texts, and what it leaves behind."""

from quillmark.llm import common, line_dedup


def test_texts_are_cut_once_to_find_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    written, plain = [], line_dedup.materialise

    def recorded(df, tag, **more):
        written.append((tag, "md5" in df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(df, tag, **more)

    def verified(pieces, column, check=line_dedup.verified_seed):
        written.append(("verified", "md5" in pieces._jdf.queryExecution().optimizedPlan().toString()))
        return check(pieces, column)

    monkeypatch.setattr(line_dedup, "materialise", recorded)
    monkeypatch.setattr(line_dedup, "verified_seed", verified)
    block = "\n".join(f"a shared line of words number {i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"own start {i}\n{block}\nown end {i}") for i in range(5)], "doc_id long, text string")
    gone = {r["doc_id"]: r["gone"] for r in line_dedup.repeated(docs).collect()}
    assert sorted(gone) == [1, 2, 3, 4]
    assert [tag for tag, cuts in written if cuts] == ["line-pieces"]
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["line-chunks"]  # no chunk text stays
