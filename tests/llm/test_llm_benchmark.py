import re

import duckdb
import pytest
from pyspark.sql import functions as F

from molweave.llm.decontaminate import OP9_SQL, Queries, build_index, covered, decontaminate, op9_decontaminate, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                if items_here := wanted.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= items_here
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


BENCH = [(1, "The quick brown fox jumps over the lazy dog, again"), (2, "two spaces"), (3, None), (4, ""), (5, "..."), (6, "again again again"), (7, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (7, "THE quick brown fox jumps over the lazy dog")]


@pytest.mark.parametrize("query_bytes,segment_words", [(8_000_000, 1_000_000), (60, 50)])
def test_against_brute_force(spark, edge, query_bytes, segment_words):
    bench = spark.createDataFrame([(i, t, "x") for i, t in BENCH], "item_id long, text string, items string")
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    found = search(build_index(edge, segment_words=segment_words), bench, query_bytes=query_bytes)
    got = found.select("doc_id", "n_words", covered(F.col("starts"), F.col("stops")).alias("n"), "items").collect()
    assert sorted(((d, n, h, tuple(sorted(set(i)))) for d, n, h, i in got), key=str) == brute(docs, BENCH)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha q q q q beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    index = build_index(docs)
    near = {r["doc_id"] for r in search(index, bench, slop=1).collect() if r["items"]}
    exact = {r["doc_id"] for r in search(index, bench).collect() if r["items"]}
    assert exact == {3} and near == {1, 3}


def test_empty_tables(spark, edge):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(edge, bench).where("n_hit > 0").count() == 0
    assert decontaminate(edge, bench).count() == edge.count()
    assert decontaminate(edge.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_items_without_id_and_repeated_items(spark, tmp_path, monkeypatch):
    docs = [(1, "say alpha beta gamma now"), (2, "one two three"), (3, "nothing"), (4, "alpha beta gamma one two three four five")]
    bench = [(None, "alpha beta gamma"), (None, "four five"), (7, "one two three")] + [(8, "delta epsilon zeta eta theta")] * 50
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(OP9_SQL)
    names = [c[0] for c in want.description]
    got = sorted(map(tuple, op9_decontaminate(spark, str(tmp_path)).select(*names).collect()))
    assert got == sorted(want.fetchall()) and [r[-1] for r in got] == [True, True, False, True]
    sizes, plain = [], Queries.__init__
    monkeypatch.setattr(Queries, "__init__", lambda self, items, window: sizes.append(sum(len(t) for _, t in items)) or plain(self, items, window))
    found = search(build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(bench, "item_id long, text string"), query_bytes=60)
    assert sum(sizes) == sum(len(t) for _, t in set(bench)) and {r["doc_id"]: set(r["items"]) for r in found.collect()} == {1: {None}, 2: {7}, 3: set(), 4: {None, 7}}


def test_op9_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(OP9_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, op9_decontaminate(spark, sf).select(*names).collect())) == sorted(want.fetchall())
