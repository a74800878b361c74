"""Token ids as directly addressable codes in files of their own (operator 2).

Layout of a file, little-endian: magic ``MWDAC1``, one byte of chunk width, one byte of level count, three int64
(documents, tokens, position of the directory); then for every level its chunks (``width`` bits each, stored in a
byte), its continuation bitmap (bit set: the id goes on in the next level) and its rank directory (set bits before
each block of 512, uint32, absolute per level); at the end the directory: doc ids int64, token starts int64 (one
more than documents), level offsets. Token ``i`` is read from level 0 at ``i``, from level 1 at ``rank(i)``, and
so on: one chunk, one directory entry and at most 64 bitmap bytes per level, without decoding a block.

Files are written by tasks into the shared folder under names no other attempt uses; only files named in the
manifest, which Spark commits as a table, count. A lost executor's attempt leaves an unnamed file and is repeated.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.session import materialise, scratch_path

from .common import local_path, table
from .words import PieceTable, per_process, rows_of, slices

MAGIC = b"MWDAC1"
WIDTH = 8
BLOCK = 512
HEAD = "<6sBBqqq"
HEAD_BYTES = struct.calcsize(HEAD)


def _popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits)


def encode_levels(ids: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) for each level; the last level's bitmap is all zero."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & np.uint32((1 << width) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(width)
        on = rest > 0
        bitmap = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(bitmap) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(bitmap)] = bitmap
        per_block = _popcount(padded).reshape(-1, BLOCK // 8).sum(1)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)
        out.append((chunks, bitmap, ranks))
        rest = rest[on]
        if not len(rest):
            return out


def file_bytes(doc_ids: np.ndarray, ids: list[np.ndarray], width: int = WIDTH) -> list[bytes]:
    """The pieces of a file for documents in their order."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8")
    levels = encode_levels(np.concatenate(ids) if ids else np.zeros(0, np.uint32), width)
    pieces, offsets, at = [b""], [], HEAD_BYTES
    for chunks, bitmap, ranks in levels:
        for part in (chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()):
            offsets += [at, len(part)]
            pieces.append(part)
            at += len(part)
    pieces += [doc_ids.astype("<i8").tobytes(), starts.tobytes(), np.array(offsets, "<i8").tobytes()]
    pieces[0] = struct.pack(HEAD, MAGIC, width, len(levels), len(doc_ids), int(starts[-1]), at)
    return pieces


class TokenFile:
    """Reads a file of this format; ``source`` offers ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        magic, self.width, levels, docs, self.n_tokens, at = struct.unpack(HEAD, self._read(0, HEAD_BYTES))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(self._read(at, 8 * docs), "<i8")
        self.starts = np.frombuffer(self._read(at + 8 * docs, 8 * (docs + 1)), "<i8")
        table = np.frombuffer(self._read(at + 8 * (2 * docs + 1), 48 * levels), "<i8").reshape(levels, 3, 2)
        self.levels = table.tolist()

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def token(self, i: int) -> int:
        """The token at position ``i`` of the file, by direct addressing."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, ((chunks, _), (bits, n_bits), (ranks, _)) in enumerate(self.levels):
            value |= self._read(chunks + i, 1)[0] << (k * self.width)
            block = i // BLOCK
            first = block * BLOCK // 8
            part = np.frombuffer(self._read(bits + first, min(BLOCK // 8, n_bits - first)), np.uint8)
            inside = i - block * BLOCK
            if not part[inside // 8] >> (inside % 8) & 1:
                return value
            before = int(np.unpackbits(part, bitorder="little")[:inside].sum())
            i = struct.unpack("<I", self._read(ranks + 4 * block, 4))[0] + before
        return value

    def all_tokens(self) -> np.ndarray:
        """All tokens, level by level."""
        ids, at = np.zeros(self.n_tokens, np.uint32), None
        for k, ((chunks, size), (bits, n_bits), _) in enumerate(self.levels):
            part = np.frombuffer(self._read(chunks, size), np.uint8).astype(np.uint32) << np.uint32(k * self.width)
            if at is None:
                ids, at = part, np.arange(size)
            else:
                ids[at] |= part
            on = np.unpackbits(np.frombuffer(self._read(bits, n_bits), np.uint8), count=size, bitorder="little")
            at = at[on.view(bool)]
        return ids

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        ids = self.all_tokens()
        for k, doc in enumerate(self.doc_ids.tolist()):
            yield doc, ids[self.starts[k] : self.starts[k + 1]]


#: letters below this one (Latin, Greek, Cyrillic) are letters in every version of Unicode in use
LETTERS_TO = "\u0530"
#: how a byte-level vocabulary writes bytes: visible ones as themselves, the others as characters from 256 on, in order
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


def signs(piece: str) -> str:
    """A string as a byte-level vocabulary writes it."""
    return piece.encode().decode("latin-1").translate(BYTE_SIGNS)


def is_word(piece: str) -> bool:
    """A space and letters, which a byte-level pattern leaves whole."""
    word = piece[1:]
    return word.isalpha() and (word.isascii() or max(word) < LETTERS_TO)


def word_model(tokenizer):
    """The library's model for words that a byte-level pattern leaves whole, or None if the tokenizer treats them otherwise."""
    model = tokenizer.model
    for word in (" the", " Zq", " internationalisation", " aB", " x", " naïve", " Übermaß", " слово", " λόγος"):
        if tokenizer.encode(word, add_special_tokens=False).ids != [t.id for t in model.tokenize(signs(word))]:
            return None
    return model


def encode_pieces(tokenizer, words, strings: list[str], spaced: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of strings: a space and letters are one word and go to ``words`` (:func:`word_model`) directly, all
    others the whole way."""
    plain = [k for k in range(spaced if words else 0) if is_word(strings[k])]
    if not plain:
        return encode_strings(tokenizer, strings, spaced)
    alone = np.ones(len(strings), bool)
    alone[plain] = False
    rest = np.flatnonzero(alone)
    found = [rows_of([[t.id for t in words.tokenize(signs(strings[k]))] for k in plain])]
    found.append(encode_strings(tokenizer, [strings[k] for k in rest.tolist()], int((rest < spaced).sum())))
    sizes = np.empty(len(strings), np.int64)
    sizes[plain], sizes[rest] = found[0][0], found[1][0]
    owner = np.concatenate([np.repeat(plain, found[0][0]), np.repeat(rest, found[1][0])])
    return sizes, np.concatenate([found[0][1], found[1][1]])[np.argsort(owner, kind="stable")]


def encode_strings(model, strings: list[str], spaced: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of strings by the tokenizers library.

    The first ``spaced`` strings begin with a space and have no other white space at their ends. They are joined by a
    carriage return, which the byte-level pattern makes a token of its own there, so that many share a call; a lot in
    which a string holds one itself, and all other strings, are encoded one by one.
    """
    mark = model.encode("\r", add_special_tokens=False).ids
    lots = [(k, min(k + 4096, spaced)) for k in range(0, spaced, 4096)]
    joined = ["\r".join(strings[a:b]) for a, b in lots]
    good = [len(mark) == 1 and text.count("\r") == b - a - 1 for text, (a, b) in zip(joined, lots, strict=True)]
    found = iter(model.encode_batch_fast([t for t, g in zip(joined, good, strict=True) if g], add_special_tokens=False))
    sizes, parts = [], []

    def one_by_one(part: list[str]) -> None:
        n, flat = rows_of([e.ids for e in model.encode_batch_fast(part, add_special_tokens=False)])
        sizes.append(n)
        parts.append(flat)

    for fits, (a, b) in zip(good, lots, strict=True):
        ids = np.array(next(found).ids, np.int32) if fits else None
        at = np.append(np.flatnonzero(ids == mark[0]), len(ids)) if fits else ()
        if len(at) == b - a:
            sizes.append(np.diff(at, prepend=-1) - 1)
            parts.append(ids[ids != mark[0]])
        else:
            one_by_one(strings[a:b])
    one_by_one(strings[spaced:])
    return np.concatenate(sizes), np.concatenate(parts)


MANIFEST = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: tokens of one file; a document is never cut, so a longer one is a file of its own
FILE_TOKENS = 16_000_000
#: distinct pieces (about 150 bytes each) that a Python worker keeps
TABLE_PIECES = 900_000
#: characters that are encoded at once
LOT_CHARS = 4_000_000


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write token files in ascending ``doc_id`` order; returns the manifest.

    Null and empty texts hold only ``end_id``. Rows are ordered by id and then text, repeated rows are kept, null
    ids come first (stored as the smallest int64). Extra columns are not read. An empty table writes no file.
    """
    conf = docs.sparkSession.conf
    n = partitions or int(conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator) -> Iterator:
        import os
        import uuid

        import public_tokenizers
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

        def load():
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            words = word_model(model)
            return PieceTable(lambda new, spaced: encode_pieces(model, words, new, spaced), TABLE_PIECES)

        # the table serves all tasks of a Python worker: what it holds depends on the tokenizer alone
        known = per_process(("tokenizers", path), load)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int] = []
        size = 0

        def flush():
            nonlocal ids, names, size, seq
            path = f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            system, inside = local_path(path)
            with system.open_output_stream(inside) as out:
                for piece in file_bytes(np.array(names, np.int64), ids):
                    out.write(piece)
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, path, len(names), size), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=MANIFEST.names)
            ids, names, size, seq = [], [], 0, seq + 1
            return row

        system, inside = local_path(folder)
        system.create_dir(inside, recursive=True)
        for batch in batches:
            keys = [-(2**63) if k is None else k for k in batch.column(0).to_pylist()]
            texts = batch.column(1).fill_null("")
            for lot in slices(pc.utf8_length(texts).to_pylist(), LOT_CHARS):
                for key, x in zip(keys[lot], known.texts(texts.slice(lot.start, lot.stop - lot.start)), strict=True):
                    x = np.append(x, end_id).astype(np.uint32)
                    if names and size + len(x) > FILE_TOKENS:
                        yield flush()
                    names.append(key)
                    ids.append(x)
                    size += len(x)
        if names:
            yield flush()

    return materialise(rows.mapInArrow(run, MANIFEST), "manifest")


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files the manifest names."""
    order = Window.orderBy("part", "seq")  # one row per file
    files = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).select("path", "base")
    files = files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inside = local_path(path)
                with system.open_input_file(inside) as source:
                    reader = TokenFile(source)
                    ids = reader.all_tokens().astype("<u4")
                docs, starts = reader.doc_ids, reader.starts
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                null = docs == -(2**63)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(base + starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], names=READ.names)

    return files.mapInArrow(run, READ)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder))
