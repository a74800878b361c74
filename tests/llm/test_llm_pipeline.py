import public_tokenizers
import tiktoken

import __spark_entry__ as driver
import corpus_pipeline
from molweave.llm.bpe import load_ranks
from molweave.llm.queries import QUERIES
from molweave.session import materialise

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


def stages(spark, docs, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_decisions(spark, sf):
    prose = "the cat sat on the mat while {} watched the rain fall on every roof of the old town and nobody said a word about it"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first()["text"]
    rows = [(i, prose.format(f"n{i} " * (40 * i)), "en", "s", 1) for i in range(1, 4)]
    rows += [(10, rows[0][1], "en", "s", 1), (10, rows[0][1], "en", "s", 1), (None, rows[0][1], None, None, None)]
    rows += [(20, None, None, "s", None), (21, "", "en", "s", 0), (22, "12345 !!", None, "s", None)]
    rows += [(30, "before it all " + item + " after it all", None, "s", 1), (40, "write to someone@mail.example.org about the weather in the old town", None, "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first, second, third, fourth, last = stages(spark, docs, sf)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())
    assert all(df.columns == NAMES for df in (first, second, third, fourth))
    assert [i for n, i in ids(first) if not n] == [1, 2, 3, 10, 10, 30, 40]
    assert ids(second) == [(False, i) for i in (1, 2, 3, 30, 40)]
    assert ids(third) == [(False, i) for i in (1, 2, 3, 40)]
    texts = {r["doc_id"]: r for r in fourth.collect()}
    assert "someone@" not in texts[40]["text"] and texts[1]["text"] == rows[0][1] and texts[40]["n_chars"] == len(texts[40]["text"])
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    for r in last.collect():
        assert r["exact"] and bytes(r["ids"]) == np.array(plain.encode_ordinary(texts[r["doc_id"]]["text"]), "<u4").tobytes()


def test_language_stage_without_labels(spark, sf):
    rows = [(1, "some words", None), (2, "12 \u00bd", None), (3, None, None), (4, "", None), (5, "\u0436", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, sf).collect()) == [1, 5]


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert 0 < got.count() <= spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("not exact").count() == 0


def test_empty_table_and_edge_rows(spark, edge, sf):
    for docs in (edge, edge.limit(0)):
        *others, last = stages(spark, docs, sf)
        assert last.count() <= docs.count()
        for df in others:
            assert df.columns == docs.columns
            # clashing columns keep their own values
            assert df.where("score != 'x' or kinds != 'x' or simhash != 'x' or ids != 'x'").count() == 0
