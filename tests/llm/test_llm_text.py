import random
import zlib

import pytest

from molweave.llm import language, toxicity
from molweave.llm.language import fit as fit_language
from molweave.llm.language import op5_language, predict
from molweave.llm.toxicity import Folding, fold, op1_toxicity


def test_language_backs_off(spark, edge):
    rows = [(i, t, k) for i, (t, k) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 20)]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "the dog"), (2, "hundekatze"), (3, None), (4, "123 !?"), (5, "caterdog"), (6, "")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["en", "de", "und", "und", "en", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert predict(edge, model).count() == edge.count() and predict(edge.limit(0), model).count() == 0


def test_language_without_labels(spark):
    model = fit_language(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert predict(spark.createDataFrame([("words",)], "text string"), model).first()["lang_pred"] == "und"


def test_language_sample_is_bounded(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "'abc' AS text", "'en' AS lang")
    assert 300 < language.sample_rows(many, "doc_id", "lang", 500).count() < 700
    assert language.sample_rows(many, "doc_id", "lang", 5000).count() == 5000
    few = spark.range(50).selectExpr("id AS doc_id", "'abc' AS text", "'fy' AS lang")
    kept = {r["lang"]: r["count"] for r in language.sample_rows(many.unionByName(few), "doc_id", "lang", 500).groupBy("lang").count().collect()}
    assert kept["fy"] == 50 and 300 < kept["en"] < 700


def test_rare_language_beside_a_hot_one(spark):
    rng = random.Random(8)
    syllables = {"hot": ["ka", "lo", "mi", "ten", "ra", "su"], "rare": ["vry", "gho", "zhe", "quo", "xip", "wug"]}
    text = lambda kind: " ".join("".join(rng.choices(syllables[kind], k=rng.randint(2, 4))) for _ in range(40))
    rows = [(i, text("hot"), "hot") for i in range(3000)] + [(5000 + i, text("rare"), "rare") for i in range(50)]
    # a model too small for the hot language's words alone
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=400)
    assert sum(len(t) for t in model["table"].values()) <= 400
    asked = spark.createDataFrame([(i, text("rare" if i % 2 else "hot")) for i in range(40)], "doc_id long, text string")
    assert all(r["lang_pred"] == ("rare" if r["doc_id"] % 2 else "hot") for r in predict(asked, model).collect())


def test_words_are_letters_and_their_marks():
    texts = ["Ab cd", None, "", "x\u00b2 \u00bd \u2167 \u2460 123", "\u0301a\u0301b \u0301", "\u0939\u093f\u0928\u094d\u0926\u0940 \u0928", "a_b-c", "  "]
    import pyarrow as pa

    words, index, counts = language.words_of(pa.array(texts, pa.string()))
    flat, out = [words[i] for i in index.tolist()], []
    for n in counts.tolist():
        out.append(flat[:n])
        flat = flat[n:]
    assert out == [["ab", "cd"], [], [], ["x"], ["a\u0301b"], ["\u0939\u093f\u0928\u094d\u0926\u0940", "\u0928"], ["a", "b", "c"], []] and not flat


def test_numbers_and_marks_have_no_language(spark):
    model = fit_language(spark.createDataFrame([(1, "one two three", "en")] * 5, "doc_id long, text string, lang string"))
    texts = ["\u00b2", "\u00bd", "\u2167", "\u2460", "\u0301", "12", None, "", "\u00b2x"]
    got = predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == dict.fromkeys(range(8), "und") | {8: "en"}


def test_scores_do_not_depend_on_lots(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    table = {n: {} for n in range(6)} | {1: {c: k for k, c in enumerate("abcdefgh")}}
    model = {"langs": ["x", "y", "z"], "table": table, "rows": np.array([[rng.random() for _ in range(3)] for _ in range(8)], np.float32)}
    texts = pa.array([" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(200)])
    names, scores = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "CELLS", 21)
    monkeypatch.setattr(language, "CACHE", 3)
    again, others = language.Scorer(model).predict(texts)
    assert names == again and np.allclose(scores, others, atol=1e-12)


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_language(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_folding():
    assert fold("1D10T", Folding()) == " idiot "
    assert fold("ѕtuріd \uff41\u200bb", Folding()) == " stupid ab "
    assert fold(None, Folding()) == "  "


def toy(spark, toxic_word="grumpf"):
    rng = random.Random(4)
    filler = [f"w{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(200):
        words = rng.choices(filler, k=40)
        bad = i % 4 == 0
        if bad:
            words[5] = toxic_word
        elif i % 16 == 1:  # the same word in a harmless phrase
            words[5:7] = [toxic_word, "cake"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_and_exceptions(spark, edge):
    docs, labels = toy(spark)
    model = toxicity.fit(docs, labels, exceptions=["grumpf cake"])
    asked = [(1, "w1 w2 grumpf w3"), (2, "w1 w2 grumpf cake w3"), (3, "w1 w2 w3"), (4, "w1 GRUМPF w2"), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k]["score"] >= 0.5 for k in range(1, 7)] == [True, False, False, True, False, False]
    assert got[2]["n_terms"] == 0
    assert toxicity.toxicity(edge, model).count() == edge.count()
    assert toxicity.toxicity(edge.limit(0), model).count() == 0


def test_exceptions_are_learned(spark):
    docs, labels = toy(spark)
    assert "grumpf cake" in toxicity.fit(docs, labels)["exceptions"]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 0)], [(1, 1)]])
def test_lexicon_from_few_labels(spark, rows):
    docs, _ = toy(spark)
    model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, model).where("score between 0 and 1").count() == 200


def test_op1_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op1_toxicity(spark, sf).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    known = [r for r in got if label.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in known) >= 0.9 * len(known)
