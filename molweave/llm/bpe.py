"""Byte-level BPE encoding and decoding as recursive DuckDB queries inside each partition (operator 4).

The words of a batch become token-position rows. A recursive query joins neighbouring tokens with the merge
table and contracts, in every word, its pairs of smallest rank from the left, until no pair is left. Ids are put
together per text and decoded by an ordered aggregation over token rows. Spark partitions the texts; nothing is
shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table
from .words import TABLE_PIECES, PieceTable, per_process

#: contractions in one recursive query; longer words go on in the next one, so its rows stay bounded
DEPTH = 48
#: bytes of words in one recursive query
QUERY_BYTES = 250_000
#: characters that are encoded at once
LOT_CHARS = 2_000_000
#: pieces (about 150 bytes each) that a Python worker keeps in the query, which has its executors for itself
PIECES = 1_200_000
#: token rows in one decoding query
DECODE_TOKENS = 1_000_000

#: Rows link to the next position and hold its id and the rank of the pair. A step contracts one pair of a word; only the
#: contracted row and the one before it look a new pair up.
CONTRACT = f"""
WITH RECURSIVE steps AS (
  SELECT t.word, t.pos, t.id, t.next, n.id AS id2, m.rank, 0 AS step
  FROM tokens t LEFT JOIN tokens n ON n.pos = t.next LEFT JOIN merges m ON m.pair = (t.id::BIGINT << 32) | n.id
  UNION ALL
  (WITH best AS (
     SELECT word, min((rank::BIGINT << 32) | pos) AS key, arg_min(next, (rank::BIGINT << 32) | pos) AS gone
     FROM steps WHERE rank IS NOT NULL AND step < {DEPTH} GROUP BY word),
   pair AS (
     SELECT b.word, (b.key & 4294967295)::INT AS first, (b.key >> 32)::INT AS made, b.gone, g.next, g.id2
     FROM steps g JOIN best b ON g.pos = b.gone),
   moved AS (
     SELECT s.word, s.pos, CASE WHEN s.pos = p.first THEN p.made ELSE s.id END AS id,
       CASE WHEN s.pos = p.first THEN p.next ELSE s.next END AS next,
       CASE WHEN s.pos = p.first THEN p.id2 WHEN s.next = p.first THEN p.made ELSE s.id2 END AS id2,
       s.rank, s.step + 1 AS step, s.pos = p.first OR s.next IS NOT DISTINCT FROM p.first AS changed
     FROM steps s JOIN pair p ON s.word = p.word WHERE s.pos <> p.gone)
   SELECT word, pos, s.id, next, id2, CASE WHEN changed THEN m.rank ELSE s.rank END, step
   FROM moved s LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN (s.id::BIGINT << 32) | s.id2 ELSE -1 END)
)
SELECT word, pos, id, step FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step)
ORDER BY pos
"""

#: The same for long words: a step contracts every pair of the smallest rank, leftmost first and without overlap.
#: That is one contraction after the other as long as none of them makes a pair of smaller rank adjacent before its equals
#: are done. Such a pair would be a token that was given its rank before one of its halves had one; the vocabulary was
#: learned by contractions, so a token's rank is above those of the two halves it is put together from here.
CONTRACT_LONG = f"""
WITH RECURSIVE steps AS (
  SELECT word, pos, id, 0 AS step FROM tokens
  UNION ALL
  (WITH here AS MATERIALIZED (
     SELECT word, pos, id, step, lead(id) OVER (PARTITION BY word ORDER BY pos) AS id2 FROM steps),
   pairs AS MATERIALIZED (
     SELECT h.word, h.pos, h.id, h.step, m.rank, min(m.rank) OVER (PARTITION BY h.word) AS best
     FROM here h LEFT JOIN merges m ON m.pair = (h.id::BIGINT << 32) | h.id2),
   busy AS MATERIALIZED (
     SELECT *, rank IS NOT NULL AND rank = best AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS n
     FROM pairs WHERE best IS NOT NULL AND step < {DEPTH}),
   runs AS MATERIALIZED (
     SELECT *, max(CASE WHEN hit THEN 0 ELSE n END) OVER (PARTITION BY word ORDER BY pos) AS before FROM busy),
   marked AS MATERIALIZED (SELECT *, hit AND (n - before) % 2 = 1 AS merge FROM runs),
   told AS MATERIALIZED (SELECT *, lag(merge) OVER (PARTITION BY word ORDER BY pos) AS gone FROM marked)
   SELECT word, pos, CASE WHEN merge THEN rank ELSE id END, step + 1 FROM told WHERE gone IS NOT TRUE)
)
SELECT word, pos, id, step FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step)
ORDER BY word, pos
"""

#: bytes from which a word counts as long
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class DuckBpe:
    """One in-memory DuckDB connection with the vocabulary and the merge table."""

    def __init__(self, path: str):
        import duckdb

        ranks = load_ranks(path)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        vocabulary = pa.table({"token": pa.array(list(ranks), pa.binary()), "id": pa.array(list(ranks.values()), pa.int32())})
        self.con.register("v", vocabulary)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        cuts = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.con.register("m", pa.table({"pair": pa.array([a << 32 | b for a, b, _ in cuts], pa.int64()), "rank": pa.array([r for *_, r in cuts], pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.single = np.zeros(256, np.int32)
        for byte in range(256):
            self.single[byte] = ranks[bytes([byte])]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every word, and all ids in a row."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        if not coded:
            return sizes, np.zeros(0, np.int32)
        cuts, size = [0], 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > QUERY_BYTES:
                cuts.append(i)
                size = 0
            size += n
        parts = [self._encode(coded[a:b], sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(coded)], strict=True)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, coded: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.con.register("w", pa.table({"word": pa.array(np.arange(len(coded), dtype=np.int32)), "token": pa.array(coded, pa.binary())}))
        known = self.con.execute("SELECT word, id FROM w JOIN vocabulary USING (token)").fetchnumpy()
        whole = np.zeros(len(coded), bool)
        whole[known["word"]] = True
        found = [(known["word"], known["id"])]
        for rest, query in ((~whole & (sizes < LONG), CONTRACT), (~whole & (sizes >= LONG), CONTRACT_LONG)):
            found += self._contract(coded, sizes, np.flatnonzero(rest), query)
        word, ids = (np.concatenate([np.asarray(f[k]) for f in found]) for k in (0, 1))
        return np.bincount(word, minlength=len(coded)), ids[np.argsort(word, kind="stable")].astype(np.int32)

    def _contract(self, coded: list[bytes], sizes: np.ndarray, rest: np.ndarray, query: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, id) arrays of finished words, tokens of a word in their order."""
        if not len(rest):
            return
        n = sizes[rest]
        ids = self.single[np.frombuffer(b"".join([coded[i] for i in rest.tolist()]), np.uint8)]
        word, pos = np.repeat(rest.astype(np.int32), n), np.arange(len(ids), dtype=np.int32)
        while len(word):
            following = pa.array(np.append(pos[1:], 0), mask=np.append(word[1:] != word[:-1], True))
            self.con.register("tokens", pa.table({"word": word, "pos": pos, "id": ids, "next": following}))
            got = self.con.execute(query).fetchnumpy()
            word, pos, ids, step = (np.asarray(got[c]) for c in ("word", "pos", "id", "step"))
            done = step < DEPTH
            yield word[done], ids[done]
            word, pos, ids = word[~done], pos[~done], ids[~done]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of every id array, by an aggregation over token rows in their order."""
        out: list[list[bytes]] = [[] for _ in ids]
        piece, size = [], 0
        for i, x in enumerate(ids):
            for k in range(0, len(x), DECODE_TOKENS):
                part = x[k : k + DECODE_TOKENS]
                if size + len(part) > DECODE_TOKENS:
                    self._decode(piece, out)
                    piece, size = [], 0
                piece.append((i, part))
                size += len(part)
        self._decode(piece, out)
        return [b"".join(x) for x in out]

    def _decode(self, piece: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
        if not piece:
            return
        sizes = np.array([len(x) for _, x in piece])
        text = np.repeat(np.arange(len(piece), dtype=np.int32), sizes)
        flat = np.concatenate([x for _, x in piece])
        self.con.register("ids", pa.table({"text": text, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        rows = self.con.sql("SELECT text, list(token ORDER BY pos) AS tokens FROM ids JOIN vocabulary USING (id) GROUP BY text").to_arrow_table()
        for batch in rows.to_batches():
            tokens = batch.column(1)
            # the tokens of one text stand side by side in the value buffer
            values = tokens.values
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset :]
            data = memoryview(values.buffers()[2]) if values.buffers()[2] else memoryview(b"")
            for k, (i, j) in zip(batch.column(0).to_pylist(), zip(tokens.offsets[:-1].to_pylist(), tokens.offsets[1:].to_pylist(), strict=True), strict=True):
                out[piece[k][0]].append(bytes(data[ends[i] : ends[j]]))


class WordCutter:
    """Cuts strings into words, encodes every distinct word once and puts the strings together."""

    def __init__(self, pattern, engine: DuckBpe):
        self.find, self.engine = pattern.findall, engine

    def encode(self, strings: list[str], spaced: int = 0) -> tuple[np.ndarray, np.ndarray]:
        # a space and letters are one word
        cut = [[s] if k < spaced and s.isascii() and s[1:].isalpha() else self.find(s) for k, s in enumerate(strings)]
        words = [w for x in cut for w in x]
        index = {w: k for k, w in enumerate(dict.fromkeys(words))}
        sizes, flat = self.engine.encode(list(index))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        of = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        size = sizes[of]
        after = np.cumsum(size)
        ids = flat[np.arange(int(after[-1]) if len(after) else 0) - np.repeat(after - size - starts[of], size)]
        counts = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return np.diff(np.concatenate([[0], after])[counts], prepend=0), ids


def bpe_roundtrip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep: list[str] | None = None, lot_chars: int = LOT_CHARS, pieces: int = TABLE_PIECES, kept: bool = True) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (bytes of the decoded ids).

    ``path`` is a file of base64 tokens and ranks, ``pattern`` cuts texts into words; the defaults are the public
    50k vocabulary and its pattern. A Python worker keeps the pieces it met for its later tasks, unless ``kept`` is False:
    where executors run other Python stages too, more workers than cores may be alive. With another pattern every text
    is cut as a whole. Null and empty texts have no tokens and decode to no bytes. Texts of any length
    are encoded whole; a task encodes about ``lot_chars`` characters of text at once. Repeated rows give repeated results, an empty table an empty one; input columns named like an
    output are replaced.
    """

    def make():
        import public_tokenizers
        import regex

        file, cut = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

        def load() -> tuple[DuckBpe, WordCutter, PieceTable]:
            engine = DuckBpe(file)
            cutter = WordCutter(regex.compile(cut), engine)
            return engine, cutter, PieceTable(cutter.encode, pieces, keep=True)

        engine, cutter, known = per_process(("bpe", file, cut, pieces), load) if kept else load()

        def run(texts: list[str | None]) -> list[pa.Array]:
            whole = [t or "" for t in texts]
            if cut == public_tokenizers.PATTERN:
                ids = known.texts(whole)
            else:  # only of the default pattern it is known where a text may be cut
                sizes, flat = cutter.encode(whole)
                ids = np.split(flat, np.cumsum(sizes)[:-1])
            decoded = engine.decode(ids)
            return [
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array(decoded, pa.binary()),
            ]

        return run

    return map_text(df, text, OUTPUT, make, keep, lot_chars)


OUTPUT = T.StructType(
    [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_roundtrip(table(spark, sf_dir, "documents"), keep=["doc_id"], pieces=PIECES)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
