"""Benchmark decontamination over a distributed positional inverted index (operator 9).

``build_index`` stores the postings of all training words: documents are dealt into segments by the tasks that read
them, and a segment has one row per word with its ascending positions, and one row that maps positions to documents.
The index is partitioned by documents, so neither building nor searching shuffles the corpus; a search reads only
the posting rows of benchmark words.

``search`` takes benchmark windows in blocks of bounded size. In a segment it starts every window at the postings of
its rarest word and narrows the start positions by the offset-adjusted postings of its other words, from rare to
frequent. With ``slop`` > 0 words may stand that far from their place (proximity match).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.session import materialise

from .common import LOWER_BYTES, give_back, table

WINDOW = 10
#: words of one segment; a longer document is a segment of its own
SEGMENT_WORDS = 500_000
#: bytes of benchmark text that one search takes
QUERY_BYTES = 8_000_000
#: fixed pattern of a word, over lower-cased bytes
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX = "segment long, term string, positions array<int>, docs array<long>, whole array<boolean>"


def words_of(text: str | None) -> list[bytes]:
    return re.findall(WORD, (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES))


def _segment(number: int, docs: list, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Posting rows of one segment. Positions of documents are one apart from the next, so no phrase spans two."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for x in texts for w in x), np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    positions = (np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes)).astype(np.int32)
    order = np.argsort(ids, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(index)))]).astype(np.int32)
    postings = pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions[order]))
    terms = pa.array([w.decode("utf-8", "surrogatepass") for w in index], pa.string())
    n = len(index)

    def batch(k: int, terms, postings, docs, sizes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), terms, postings, docs, sizes], names=["segment", "term", "positions", "docs", "whole"])

    nothing = lambda kind, k: pa.nulls(k, pa.list_(kind))
    ends = np.concatenate([starts, starts[-1:] + sizes[-1:] + 1]).astype(np.int32)
    real = [d is not None for d in docs]
    yield batch(1, pa.nulls(1, pa.string()), pa.array([ends], pa.list_(pa.int32())), pa.array([docs], pa.list_(pa.int64())), pa.array([real], pa.list_(pa.bool_())))
    for k in range(0, n, 50_000):
        m = min(50_000, n - k)
        yield batch(m, terms.slice(k, m), postings.slice(k, m), nothing(pa.int64(), m), nothing(pa.bool_(), m))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of whole texts. A null text has no words; extra columns are not read."""

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        number, names, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(one.as_py())
                if names and size + len(words) + 1 > segment_words:
                    yield from _segment(number, names, texts)
                    number, names, texts, size = number + 1, [], [], 0
                names.append(name)
                texts.append(words)
                size += len(words) + 1
        if names:
            yield from _segment(number, names, texts)
        del names, texts
        give_back()

    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return materialise(source.mapInArrow(run, INDEX), "postings")


class Queries:
    """Windows of some benchmark items over a vocabulary of their own."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.terms: dict[str, int] = {}
        #: item ids, None among them, by their place
        places: dict[int | None, int] = {}
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows: dict[int, list] = {}
        for item, text in items:
            words = [self.terms.setdefault(w.decode("utf-8", "surrogatepass"), len(self.terms)) for w in words_of(text)]
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                rows.setdefault(size, []).append((places.setdefault(item, len(places)), *words[k : k + size]))
        for size, found in rows.items():
            unique = np.unique(np.array(found, np.int64), axis=0)
            self.by_size[size] = unique[:, 0], unique[:, 1:]
        self.items = list(places)

    def matches(self, ids: np.ndarray, offsets: np.ndarray, positions: np.ndarray, last: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(place of the item, start, size): where windows occur. ``ids`` are the terms of this segment, ``positions`` their postings."""
        count = np.zeros(len(self.terms), np.int64)
        count[ids] = np.diff(offsets)
        begin = np.zeros(len(self.terms), np.int64)
        begin[ids] = offsets[:-1]
        span = last + 2
        # postings as one ascending list of (term, position)
        order = np.argsort(ids, kind="stable")
        joined = np.concatenate([positions[offsets[k] : offsets[k + 1]] + ids[k] * span for k in order]) if len(ids) else np.zeros(0, np.int64)
        for size, (items, terms) in self.by_size.items():
            often = count[terms]
            some = np.flatnonzero((often > 0).all(1))
            if not len(some):
                continue
            rare = np.argsort(often[some], axis=1, kind="stable")  # offsets in the window, rarest word first
            first = terms[some, rare[:, 0]]
            n = count[first]
            who = np.repeat(np.arange(len(some)), n)
            inside = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            start = positions[np.repeat(begin[first], n) + inside] - rare[who, 0]
            keep = (start >= 0) & (start + size <= last + 1)
            who, start = who[keep], start[keep]
            for k in range(1, size):
                offset = rare[who, k]
                term = terms[some[who], offset]
                want = term * span + start + offset
                low = np.maximum(want - slop, term * span)
                at = np.searchsorted(joined, low)
                at_most = np.minimum(want + slop, term * span + span - 1)
                found = (at < len(joined)) & (joined[np.minimum(at, len(joined) - 1)] <= at_most)
                who, start = who[found], start[found]
            yield items[some[who]], start, size


FOUND = "doc_id long, seat long, n_words long, starts array<int>, stops array<int>, items array<long>"


def _search_segment(rows: pa.Table, queries: Queries, slop: int) -> pa.Table:
    head = rows.filter(pa.compute.is_null(rows["term"]))
    docs, real = head["docs"][0].as_py(), head["whole"][0].as_py()
    bounds = np.array(head["positions"][0].as_py(), np.int64)
    body = rows.filter(pa.compute.is_valid(rows["term"]))
    body = body.select(["term", "positions"]).combine_chunks()
    ids = np.array([queries.terms[t] for t in body["term"].to_pylist()], np.int64)
    hits: dict[int, dict[int, np.ndarray]] = {}
    if len(ids):
        lists = body["positions"].combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        positions = lists.values.to_numpy()[: offsets[-1]].astype(np.int64)
        found = list(queries.matches(ids, offsets, positions, int(bounds[-1]), slop))
        item, start, stop = (np.concatenate([x[k] if k < 2 else x[1] + x[2] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
        doc = np.searchsorted(bounds, start, side="right") - 1
        inside = stop < bounds[np.minimum(doc + 1, len(bounds) - 1)]  # the gap after a document is no word
        item, start, stop, doc = item[inside], start[inside], stop[inside], doc[inside]
        order = np.lexsort((start, doc))
        item, start, stop, doc = item[order], start[order], stop[order], doc[order]
        cut = np.flatnonzero(np.diff(doc)) + 1
        for d, i, s, e in zip(doc[np.concatenate([[0], cut])] if len(doc) else [], np.split(item, cut), np.split(start, cut), np.split(stop, cut), strict=False):
            reach = np.maximum.accumulate(e)
            new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
            hits[int(d)] = {"starts": s[new] - bounds[d], "stops": np.append(reach[new[1:] - 1], reach[-1]) - bounds[d], "items": [queries.items[k] for k in np.unique(i)]}
    sizes = np.diff(bounds) - 1
    segment = rows["segment"][0].as_py()
    column = lambda name, kind: pa.array([hits[k][name] if k in hits else [] for k in range(len(docs))], pa.list_(kind))
    return pa.table(
        {
            "doc_id": pa.array([d if r else None for d, r in zip(docs, real, strict=True)], pa.int64()),
            "seat": pa.array(np.arange(len(docs)) + (segment >> 32 << 40) + ((segment & 0xFFFFFFFF) << 20)),
            "n_words": pa.array(sizes, pa.int64()),
            "starts": column("starts", pa.int32()),
            "stops": column("stops", pa.int32()),
            "items": column("items", pa.int64()),
        }
    )


def _searcher(sent, slop: int):
    def run(rows):
        found = _search_segment(rows, sent.value, slop)
        give_back()
        return found

    return run


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(doc_id, n_words, starts, stops, items) for every indexed document: merged word intervals and items found.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; an item without words has
    none. Items without an id count like one more item, with a null id. Equal rows are searched once. Benchmarks of any size are searched block after block, ``query_bytes`` of text at a time.
    """
    spark = index.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    items = materialise(items.withColumn("size", F.octet_length("text")), "benchmark")
    blocks = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // query_bytes))
    parts = []
    for k in range(blocks):
        # a block has a bounded size, whatever the size of the benchmark
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).select("item", "text").collect()
        queries = Queries([tuple(r) for r in rows], window)
        terms = spark.createDataFrame(pa.table({"term": pa.array(list(queries.terms), pa.string())}))
        wanted = index.join(F.broadcast(terms), "term", "left_semi").select(*index.columns)
        wanted = wanted.unionByName(index.where("term is null"))
        sent = spark.sparkContext.broadcast(queries)

        parts.append(wanted.groupBy("segment").applyInArrow(_searcher(sent, slop), FOUND))
    if len(parts) == 1:
        return parts[0].drop("seat")
    both = reduce(DataFrame.unionByName, parts).groupBy("seat")
    merged = both.agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items")))
    return merged.drop("seat")


def covered(starts: Column, stops: Column) -> Column:
    """Words inside any of the intervals, which may overlap."""
    pairs = F.array_sort(F.arrays_zip(starts.alias("s"), stops.alias("e")))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    step = lambda acc, x: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["reach"]))).alias("sum"),
        F.greatest(acc["reach"], x["e"]).alias("reach"),
    )
    return F.aggregate(pairs, zero, step)["sum"].cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of ``docs``; null ids and repeated rows stay rows of their own."""
    found = search(build_index(docs, doc_id, text), benchmark, window=window)
    return found.select(F.col("doc_id").alias(doc_id), "n_words", covered(F.col("starts"), F.col("stops")).alias("n_hit"), F.array_distinct("items").alias("items"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[k:k + least(10, len(words)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, k, size, array_to_string(words[k:k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM dw, sizes WHERE len(words) >= size)),
hits AS (SELECT doc_id, k, size, item_id FROM grams JOIN windows USING (size, phrase)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
