"""Language identification by known words, backing off to character n-grams (operator 5).

A word the model knows is scored by its log frequency in every language. Any other word falls back to its longest
known character n-grams, five characters first and single characters last. Scores of words are made relative to
the best language and summed over the text. Texts are cut into words by Arrow, and every different word of a lot is
looked up once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, id_remainder, map_text, table

#: labelled documents of each language (about, at most) from which a model is fitted
SAMPLE = 5_000
#: words and n-grams that a model holds at most, dealt over its languages; of each language the most frequent stay
MODEL_ROWS = 200_000
#: languages that a model learns at most; the most frequent stay
LANGUAGES = 1_000
#: longest n-gram
LONGEST = 5
#: occurrences below which a word counts as unseen
LEAST = 3
#: words whose scores a task keeps
CACHE = 200_000
#: scores (words times languages) that are summed at once
CELLS = 4_000_000
#: what stands between words; a word is a letter and the letters and combining marks after it
BETWEEN = r"[^\p{L}\p{M}]+"
NO_LANGUAGE = "und"
#: characters whose words are looked up at once
LOT_CHARS = 500_000

OUTPUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[k : k + n] for k in range(len(marked) - n + 1)] if n > 1 else list(word)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of some texts in lower case, the words of all texts in a row by their place among them, and how
    many each text has."""
    cut = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), BETWEEN)
    coded = cut.flatten().dictionary_encode()
    # marks without a letter before them are no part of a word
    words = [w if w[:1].isalpha() else _from_letter(w) for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy()
    good = np.array([bool(w) for w in words], dtype=bool)[index] if len(words) else np.zeros(0, bool)
    counts = np.add.reduceat(good.astype(np.int64), cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()) if len(texts) else np.zeros(0, np.int64)
    return words, index[good].astype(np.int64), counts


def _from_letter(word: str) -> str:
    return next((word[k:] for k, c in enumerate(word) if c.isalpha()), "")


def sample_rows(df: DataFrame, key: str, lang: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each language at most, chosen by a hash of ``key``; all rows of a smaller one."""
    counts = df.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__n"))
    # a bounded number of languages, so a small table
    counts = counts.orderBy(F.desc("__n"), "__lang").limit(LANGUAGES)
    share = F.lit(bound).cast("double") / F.col("__n")
    kept = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)
    return df.join(F.broadcast(counts), F.col(lang) == F.col("__lang")).where(kept).drop("__lang", "__n")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, rows: int = MODEL_ROWS) -> dict:
    """A model of bounded size from at most about ``sample`` rows of each language with text and language.

    Sample and size are dealt by language, so a small language is learned beside a large one. Rows without text or
    language teach nothing; without any the model knows no language.
    """
    given = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    source = sample_rows(given.where("text is not null and lang is not null"), "key", "lang", sample)
    schema = "n int, gram string, lang string, times long"

    def count(batches: Iterator) -> Iterator:
        words: dict[str, Counter] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                found, index, _ = words_of(batch.column(0).filter(pc.equal(langs.indices, k)))
                times = np.bincount(index, minlength=len(found)).tolist()
                seen = words.setdefault(name, Counter())
                for word, n in zip(found, times, strict=True):
                    if n:
                        seen[word] += n
        for name, seen in words.items():
            found = {0: seen}
            for n in range(1, LONGEST + 1):
                now = found[n] = Counter()
                for word, times in seen.items():
                    for gram in grams(word, n):
                        now[gram] += times
            for n, counts in found.items():
                items = list(counts.items())
                for k in range(0, len(items), 50_000):
                    part = items[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int32()), pa.array([g for g, _ in part], pa.string()), pa.array([name] * len(part), pa.string()), pa.array([t for _, t in part], pa.int64())], names=["n", "gram", "lang", "times"])
        words.clear()
        give_back()

    counts = source.select("text", "lang").mapInArrow(count, schema).groupBy("n", "gram", "lang").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST)
    # the rank filter cuts every language in its tasks before it is shuffled
    order = Window.partitionBy("lang").orderBy(F.desc("times"), "n", "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    n_langs = max(1, given.where("text is not null").select("lang").where("lang is not null").distinct().limit(LANGUAGES).count())
    top = ranked.where(F.col("rank") <= max(1, rows // n_langs)).drop("rank").toPandas()
    top = top.sort_values(["times", "n", "gram", "lang"], ascending=[False, True, True, True])
    langs = sorted(set(top["lang"]))
    at = {name: k for k, name in enumerate(langs)}
    table: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(LONGEST + 1)}
    for n, gram, name, times in zip(top["n"].tolist(), top["gram"].tolist(), top["lang"].tolist(), top["times"].tolist(), strict=True):
        table[n].setdefault(gram, np.zeros(len(langs)))[at[name]] = times
    # n-grams and words point to the rows of one matrix
    index: dict[int, dict[str, int]] = {n: {} for n in table}
    scores: list[np.ndarray] = []
    for n, found in table.items():
        total = sum(found.values()) + 1.0 if found else None
        for gram, seen in found.items():
            logs = np.log((seen + 0.5) / (total + 0.5 * len(found)))
            index[n][gram] = len(scores)
            scores.append(logs - logs.max())
    return {"langs": langs, "table": index, "rows": np.array(scores, np.float32).reshape(len(scores), len(langs))}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.table, self.known = model["langs"], model["table"], model["rows"]
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of words: their own, else the mean of their longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        whole = np.fromiter((self.table[0].get(w, -1) for w in words), np.int64, len(words))
        out[whole >= 0] = self.known[whole[whole >= 0]]
        left = np.flatnonzero(whole < 0).tolist()
        for n in range(LONGEST, 0, -1):
            seen = self.table[n]
            flat: list[int] = []
            sizes, who, still = [], [], []
            for i in left:
                found = [seen[g] for g in grams(words[i], n) if g in seen] if n <= len(words[i]) + 2 else []
                if found:
                    flat += found
                    sizes.append(len(found))
                    who.append(i)
                else:
                    still.append(i)
            if who:
                size = np.array(sizes)
                out[who] = np.add.reduceat(self.known[flat], np.cumsum(size) - size, axis=0) / size[:, None]
            left = still
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of scores for different words."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE:
            self.reset()
            new = words
        if new:
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            if base + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), base + len(new), 1024), len(self.langs)), np.float32)
                grown[:base] = self.rows[:base]
                self.rows = grown
            self.rows[base : base + len(new)] = self.scores(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts."""
        found, index, counts = words_of(texts)
        names, scores = [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        if not self.langs or not len(index):
            return names, scores
        # an empty piece is no word but has a place
        number = self.numbers(list(dict.fromkeys(found)))
        place = {w: n for w, n in zip(dict.fromkeys(found), number.tolist(), strict=True)}
        rows = np.fromiter((place[w] for w in found), np.int64, len(found))[index]
        some = np.flatnonzero(counts)
        ends = np.cumsum(counts[some])
        total = np.zeros((len(some), len(self.langs)))
        begin, step = 0, max(1, CELLS // len(self.langs))
        while begin < len(rows):
            # texts may go on in the next part
            part = self.rows[rows[begin : begin + step]]
            first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, min(begin + step, len(rows)) - 1, "right")
            starts = np.maximum(np.append(0, ends)[first : last + 1], begin) - begin
            total[first : last + 1] += np.add.reduceat(part, starts, axis=0, dtype=np.float64)
            begin += step
        mean = total / counts[some][:, None]
        best = mean.argmax(1)
        # words are not independent: their number counts by its square root
        odds = np.exp((mean - mean[np.arange(len(some)), best][:, None]) * np.sqrt(counts[some])[:, None])
        scores[some] = 1 / odds.sum(1)
        for k, b in zip(some.tolist(), best.tolist(), strict=True):
            names[k] = self.langs[b]
        return names, scores


def predict(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1). Null texts and texts without a letter get ``und`` and 0;
    so does every text if the model saw no labelled row. Ties go to the smaller language name. Whole texts are read;
    repeated rows get equal results, input columns named like an output are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def run(texts: pa.Array) -> list[pa.Array]:
            names, scores = scorer.predict(texts)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return run

    return map_text(df, text, OUTPUT, make, keep, LOT_CHARS, arrow=True)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows from which the query may learn."""
    return docs.where(F.coalesce(id_remainder("doc_id", 4), F.lit(0)) != 2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training_rows(docs)), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
