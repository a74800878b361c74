import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from molweave.llm import merkle
from molweave.llm.merkle import OP12_SQL, coded, digest, manifest, op12_merkle
from molweave.session import session_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, doc string, tree string, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def expected(rows):
    """Sorted result rows for (doc_id, source, lang, n_chars, text), by lists."""
    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        head = "".join(map(code, (doc, source, lang, n)))
        cut = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        groups[source].append((doc is not None, doc or 0, sha(head + code(text)), sha(head + code(cut)), doc))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:4])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, folded, doc) in enumerate(sorted(groups[s], key=lambda x: x[:4])):
            proof = ""
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    begin = at // 3 * 3
                    run = level[begin : begin + 3]
                    proof += "".join(h for j, h in enumerate(run) if begin + j != at)
                    folded = sha("".join(folded if begin + j == at else h for j, h in enumerate(run)))
                    at //= 3
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(spark, rows, path):
    full = [(d, t, lang, s, n, *["x"] * 5) for d, s, lang, n, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, op12_merkle(spark, str(path)).collect()), key=str)


def test_edge_rows(spark, tmp_path):
    rows = [(1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (2, None, None, None, None), (3, "a", None, 0, ""), (None, "a", "en", 1, "no\nid"), (None, None, None, None, None)]
    rows += [(4, "ü", "de", 2, "ä\n"), (5, "", "en", 1, "\n" * 9), (6, "a" * 500, "en", 1, "long " * 60_000 + "\n")]
    assert made(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [81], [82], [243, 1], [250, 81, 9, 4], [7000, 2, 1], [1] * 100])
def test_shapes(spark, tmp_path, sizes):
    rows = [(1000 * k + i, f"s{k}", "en", i, f"{i}\n{k}") for k, size in enumerate(sizes) for i in range(size)]
    assert made(spark, rows, tmp_path) == expected(rows)


def test_nothing_tampered(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"))
    out = manifest(docs, digest(coded(F.col("doc_id"))))
    assert out.where("verified").count() == out.count() == 300


def test_scratch_per_leaf(spark):
    size = lambda: sum(f.stat().st_size for f in Path(session_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    before, leaf = size(), digest(coded(F.col("doc_id")))
    out = manifest(spark.range(12_000).selectExpr("id doc_id", "'a' source"), leaf, F.when(F.col("doc_id") % 2 == 0, digest(F.lit("x"))).otherwise(leaf))
    # a leaf is dealt, grouped and climbs as a few digests; its siblings are not written for each leaf
    assert (size() - before) / 12_000 < 300
    assert out.where("verified").count() == 6000


def test_nodes_that_are_not_sent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "SENT_NODES", 0)
    rows = [(1000 * k + i, f"s{k}", "en", i, f"{i}\n{k}") for k, size in enumerate([2300, 5, 1]) for i in range(size)]
    assert made(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert made(spark, [], tmp_path) == []


def test_limit_is_put_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    made(spark, [(1, "a", "en", 1, "x")], tmp_path)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op12_merkle(spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
