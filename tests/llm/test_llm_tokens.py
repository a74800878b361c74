import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from molweave.llm.bpe import DuckBpe, bpe_roundtrip, load_ranks, op4_bpe
from molweave.llm.token_file import TokenFile, encode_levels, encode_pieces, file_bytes, op2_token_file, read_token_files, word_model, write_token_files
from molweave.llm.words import PieceTable
from molweave.session import scratch_path


@pytest.fixture(scope="module")
def plain():
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return model


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_edge_cases_as_the_library(edge, plain):
    for r in bpe_roundtrip(edge).select("text", "ids", "n_tokens", "decoded", "score").collect():
        want = plain.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == u4(want) and r["n_tokens"] == len(want) and r["score"] == "x"
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table(spark, edge):
    assert bpe_roundtrip(edge.limit(0)).count() == 0
    assert read_token_files(write_token_files(edge.limit(0), scratch_path(spark, "none"))).count() == 0


def test_long_words_and_runs(plain):
    rng = np.random.default_rng(1)
    words = ["!" * 3000, "ab" * 700, "".join(rng.choice(list("abcé日"), 2500)), " " + "e" * 999, "x" * 63, "x" * 64, "x" * 65]
    sizes, flat = DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(words)
    for word, got in zip(words, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == plain._encode_single_piece(word)


def test_long_words_of_late_halves(plain):
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # tokens that can be cut into two tokens which both have larger ranks
    late = [t for t, r in ranks.items() if any(ranks.get(t[:k], -1) > r and ranks.get(t[k:], -1) > r for k in range(1, len(t))) and t.decode("utf-8", "ignore").encode() == t]
    rng = np.random.default_rng(2)
    words = ["".join(late[i].decode() for i in rng.integers(0, len(late), 30)) for _ in range(200)]
    sizes, flat = DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(words)
    for word, got in zip(words, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == plain._encode_single_piece(word)


def test_pieces_the_short_and_the_whole_way(library):
    words = word_model(library)
    assert words is not None
    strings = [" the", " Zebra", " thhestin", " naïve", " Žižek", " ªº", " слово", " 日本", " e\u0301", " don't", " word,", " 12ab", " a\rb", " x", "front", "", "two words", ",", " ünï"]
    for spaced in (0, 14):
        sizes, flat = encode_pieces(library, words, strings, spaced)
        want = [library.encode(s, add_special_tokens=False).ids for s in strings]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    lower = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert word_model(lower) is None


def test_other_pattern_encodes_whole_texts(edge):
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lines = tiktoken.Encoding("lines", pat_str=".+|\n", mergeable_ranks=ranks, special_tokens={})
    small = edge.where("length(text) < 1000 or text is null")
    for r in bpe_roundtrip(small, pattern=".+|\n").select("text", "ids").collect():
        assert bytes(r["ids"]) == u4(lines.encode_ordinary(r["text"] or ""))


def test_full_table_keeps_what_is_met_again(plain):
    asked = []

    def encode(new, spaced):
        asked.extend(new)
        return np.array([len(plain.encode_ordinary(s)) for s in new]), np.array([i for s in new for i in plain.encode_ordinary(s)], np.int32)

    table, rng = PieceTable(encode, limit=60, keep=True), np.random.default_rng(3)
    for k in range(200):
        text = "the often " + " ".join(f"rare{i}, x" for i in rng.integers(0, 500, 5)) + " met word."
        assert table.texts([text])[0].tolist() == plain.encode_ordinary(text)
    assert asked.count(" often") < 10 < sum(a.startswith(" rare") for a in asked)


@pytest.mark.parametrize("keep", [False, True])
def test_piece_table_restarts(plain, keep):
    table = PieceTable(lambda new, spaced: (np.array([len(plain.encode_ordinary(s)) for s in new]), np.array([i for s in new for i in plain.encode_ordinary(s)], np.int32)), limit=5, keep=keep)
    for text in ["a b c d", "e f g", "", " x", "y ", "a  b", "one\ntwo three", "a b c d"]:
        assert table.texts([text])[0].tolist() == plain.encode_ordinary(text)


def test_op4_whole_table(spark, sf, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(u4(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70_000, 7))])
def test_direct_addressing(ids):
    cut = len(ids) // 2
    parts = [np.array(ids[:cut], np.uint32), np.array(ids[cut:], np.uint32)]
    reader = TokenFile(io.BytesIO(b"".join(file_bytes(np.array([3, 9]), parts))))
    assert reader.all_tokens().tolist() == ids
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(3, ids[:cut]), (9, ids[cut:])]
    for i in range(0, len(ids), max(1, len(ids) // 300)):
        assert reader.token(i) == ids[i]
    with pytest.raises(IndexError):
        reader.token(len(ids))


def test_levels_hold_only_what_goes_on():
    levels = encode_levels(np.array([1, 300, 70_000], np.uint32))
    assert [len(chunks) for chunks, _, _ in levels] == [3, 2, 1]


def test_token_files_edge_cases(spark, edge, library):
    folder = scratch_path(spark, "tokens")
    rows = read_token_files(write_token_files(edge, folder, partitions=3)).collect()
    source = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for doc, text in source:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(u4(ids))))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_op2_whole_table(spark, sf, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got, start = {r["doc_id"]: tuple(r) for r in op2_token_file(spark, sf).collect()}, 0
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[doc] == (doc, start, len(ids), zlib.crc32(u4(ids)))
        start += len(ids)
