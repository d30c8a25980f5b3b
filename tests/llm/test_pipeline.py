"""The registered queries on the smallest tables, and the pipeline on edge rows."""

import pytest

SF = "/root/testdata/sf0.001"


def test_every_query_runs(spark):
    from framescope.llm import queries

    rows = {name: spark.read.parquet(f"{SF}/{name}.parquet").count() for name in ("documents", "embeddings")}
    languages = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("coalesce(lang, '')").distinct().count()
    asking = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    for name, query in queries.QUERIES.items():
        out = query(spark, SF)
        assert len(set(out.columns)) == len(out.columns)
        n = out.count()
        # an audit has 120 orders of five steps for each language, a search five rows for each query; the others a row for each document or vector
        wanted = {"op9_embeddings": rows["embeddings"], "op11_filter_audit": 600 * languages, "op13_neighbours": 5 * asking}.get(name, rows["documents"])
        assert n >= wanted if name == "op4_packing" else n == wanted, name


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edge_rows(spark, tmp_path, empty):
    import corpus_pipeline

    text = "The quick brown fox jumps over the lazy dog and runs into the wide green field. "
    rows = [(1, None, None), (2, "", "en"), (3, text * 3, "en"), (3, text * 3, "en"), (4, text * 3, "en"), (5, "words " * 30_000, "en"), (None, "a text without a number", "en"), (6, "12 34", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _part int"
    docs = spark.createDataFrame([] if empty else [(k, t, x, "s", len(t or ""), "own", 1) for k, t, x in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
    kept = sorted(r.doc_id or 0 for r in docs.collect())
    assert kept == ([] if empty else [0, 3, 5])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == (set() if empty else {None, 3, 5})


def test_bounds_come_from_every_text(spark):
    """Texts that a sample of 400 a language would mostly leave out still move the bound, and copies do not."""
    import numpy as np
    from pyspark.sql import functions as F

    from framescope.llm import language

    words = {"aa": "abcdefg", "bb": "tuvwxyz"}
    rows = [(" ".join("".join(letters[(i * j + j + n) % 7] for j in range(5)) for n in range(4)) + f" {lang} {i}", lang) for lang, letters in words.items() for i in range(900)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    net = language.train(*language.training_windows(docs), steps=40)
    cuts = {k: [] for k in range(13)}
    for text, _ in set(rows):
        for k, x in zip(*language._beginnings(text)):
            cuts[k].append(x)
    import pyarrow as pa

    at, wanted = 0.5, []
    for k in range(13):
        if cuts[k]:
            at = max(at, np.quantile(np.floor(language.text_sureness(net, pa.array(cuts[k], pa.string())) * 10_000), 0.005) / 10_000)
        wanted.append(0.5 + 0.9 * (at - 0.5) * min(1.0, (1 << k) / 256))
    assert np.allclose(language.length_bounds(net, docs), wanted, atol=1e-4)
    assert np.allclose(language.length_bounds(net, docs.union(docs.where(F.col("text").endswith("7")))), wanted, atol=1e-4)
    assert not language.length_bounds(net, docs.limit(0)).any()
