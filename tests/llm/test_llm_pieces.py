import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from molweave.llm.pieces import PieceModel, UnitTable, fields, op13_pieces, piece_roundtrip, positions

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", "a", " ", "  ", "Hello world", " Hello  world ", "▁x ▁▁ y▁", "日本語のテキスト 벨", "\n\n\ttabs", "nbsp word", "e" * 500, "!" * 100 + " x",
    "😀🎉 emoji", "<0x41> <s> </s> <unk>", "a\u0000b", " \n ", "x  y   z    ", "​﻿x", "ﬁ ① ｶﾞ é", "　wide space", "­soft",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    return UnitTable(PieceModel(PATH))


def random_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    letters = list("abcdeé 日本▁ \n,.!1234😀ßﬁ①ｶﾞ́　­")
    return ["".join(rng.choice(letters, rng.integers(1, 80))) for _ in range(n)]


def agree(table, library, texts):
    got = table.texts(texts)
    decoded = table.model.decode([ids for ids, _ in got])
    for text, (ids, ends), back in zip(texts, got, decoded, strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and back == library.decode(want)
        spans = [dict(fields(v)) for k, v in fields(library.encode(text, out_type="serialized_proto")) if k == 2]
        last = max([len(text.encode())] if table.model.plain else [s.get(5, 0) for s in spans] + [0])
        assert ends.tolist()[:-1] == [0] + [s.get(5, 0) for s in spans]
        if spans:
            assert [0, *ends.tolist()[:-2]][1:] == [s.get(4, 0) for s in spans] or not table.model.plain
        assert ends[-1] == last or not table.model.plain


def test_as_the_library(table, library):
    agree(table, library, TEXTS + random_texts(2000))


def test_decoding_any_ids(table, library):
    rng = np.random.default_rng(1)
    for k in range(1500):
        ids = rng.integers(0, 300 if k % 2 else 32_000, rng.integers(0, 8)).tolist()
        assert table.model.decode([np.array(ids, np.int32)]) == [library.decode(ids)]
    with pytest.raises(IndexError):
        table.model.decode([np.array([32_000])])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_map(tmp_path, rule, squeeze):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    compiled = proto.ModelProto.FromString(normalizer.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    model = proto.ModelProto.FromString(open(PATH, "rb").read())
    model.normalizer_spec.precompiled_charsmap = compiled
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    mapped = UnitTable(PieceModel(str(path)))
    assert not mapped.model.plain
    agree(mapped, sentencepiece.SentencePieceProcessor(model_file=str(path)), TEXTS + random_texts(400, 2))


def test_other_models_are_refused(tmp_path):
    model = proto.ModelProto.FromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        PieceModel(str(tmp_path / "unigram.model"))


def test_table_starts_anew(library):
    small = UnitTable(PieceModel(PATH), limit=5)
    for text in ["a b c d", "e f g", "", " x", "y ", "a  b", "one\ntwo three", "a b c d"]:
        agree(small, library, [text])


def test_long_units(table, library):
    rng = np.random.default_rng(4)
    agree(table, library, ["".join(rng.choice(list("theinr"), 5000)), "ab" * 3000, "word" * 2000 + " end", " " * 3000 + "x"])


def test_edge_rows(edge, library):
    for r in piece_roundtrip(edge).select("text", "ids", "n_tokens", "decoded", "score", positions("ids").alias("list"), positions("ends").alias("ends_list")).collect():
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["list"] == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want) and r["score"] == "x"
        assert r["ends_list"][-1] == len((r["text"] or "").encode()) and len(r["ends_list"]) == len(want)
    assert piece_roundtrip(edge.limit(0)).count() == 0


def test_whole_table(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
