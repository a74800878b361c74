"""Toxicity by a weighted lexicon (operator 1).

Texts are lower-cased and folded: look-alike letters of other scripts and digit substitutions become plain letters,
everything that is no letter or digit becomes a space. One Aho-Corasick automaton finds lexicon terms (whole words
and word beginnings) and exception phrases; a term inside an exception does not count. The weights of the hits are
added up, set against the length of the text and mapped to 0..1 by a logistic curve. Terms, weights, exceptions and
the curve are learned from labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder, map_text, table

#: labelled documents of each class (about, at most) from which the lexicon is learned
SAMPLE = 20_000
#: terms that a lexicon holds at most
TERMS = 20_000
#: candidate (term, class) counts that are pulled together at most
CANDIDATES = 200_000
#: toxic documents that a term must occur in
LEAST = 3
#: log-likelihood ratio from which a term counts as bound to the toxic class
SIGNIFICANT = 12.0
#: lengths of word beginnings that may become terms
STEMS = (4, 5, 6)

#: fixed values: letters of other scripts that look like Latin ones, and digits and signs written for letters
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class Folding(dict):
    """A table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str | int:
        char = chr(code)
        out = HOMOGLYPHS.get(char) or DIGITS.get(char)
        if out is None:
            plain = unicodedata.normalize("NFKC", char)
            if unicodedata.category(char) in ("Cf", "Mn"):
                out = ""  # invisible joints and added accents hide nothing
            elif len(plain) == 1 and plain != char:
                out = HOMOGLYPHS.get(plain) or DIGITS.get(plain) or (plain if plain.isalnum() else " ")
            else:
                out = char if char.isalnum() else " "
        self[code] = out
        return out


def fold(text: str | None, table: Folding) -> str:
    return f" {(text or '').lower().translate(table)} "


def terms_of(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) >= n)
    return out


def automaton(weights: dict[str, float], exceptions: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(term, (len(term), weight))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 2, None))
    found.make_automaton()
    return found


def hits(folded: str, machine) -> dict[int, float]:
    """Start of every word that a term covers, with its largest weight; words in exception phrases left out."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded) if len(machine) else ():
        begin = end - size + 1
        if weight is None:
            spared.append((begin, end))
        elif weight > found.get(begin, 0.0):
            found[begin] = weight
    for begin, end in spared:
        for at in [k for k in found if begin <= k < end]:
            del found[at]
    return found


def features(folded: str, machine) -> tuple[float, float]:
    """(log of the weight found, log of the weight per 100 words)."""
    total = sum(hits(folded, machine).values())
    return math.log1p(total), math.log1p(100 * total / max(folded.count(" ") - 1, 20))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.full(len(y), 1 / max(len(y), 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + 1e-4 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, exceptions: list[str] | None = None) -> dict:
    """A lexicon of bounded size from at most about ``sample`` documents of each class.

    ``exceptions`` are phrases in which terms never count; phrases of two words around a hit that only clean training
    documents use are added. Rows without label are ignored; an id labelled twice counts as toxic if one label says so.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    spread = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30))
    chosen = rows.where(F.lit(False))
    for y in (0, 1):
        cut = int(min(1.0, sample / max(sizes.get(y, 0), 1)) * (1 << 30))
        chosen = chosen.unionByName(rows.where((F.col("y") == y) & (spread < cut)))
    # the number of chosen ids is bounded by the sample, so they can go to every task
    known = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "y")

    def count(batches: Iterator) -> Iterator:
        folding = Folding()
        seen = {0: Counter(), 1: Counter()}
        total = Counter()
        for batch in batches:
            for one, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(one, folding)
                for phrase in exceptions or []:
                    folded = folded.replace(f" {phrase} ", " ")
                seen[y].update(terms_of(folded))
                total[y] += 1
        for y, n in total.items():
            items = [("", n), *seen[y].items()]
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), *(pa.array([n if y == c else 0 for _, n in part], pa.int64()) for c in (1, 0))], names=["term", "bad", "good"])

    sums = known.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # a term of the toxic class is met in a larger share of toxic than of clean documents
    ratio = (F.col("bad") + 0.5) / (F.col("good") + 0.5)
    useful = (F.col("term") == "") | ((F.col("bad") >= LEAST) & (ratio > 2 * max(sizes.get(1, 0), 1) / max(sizes.get(0, 0), 1) * min(1, sample / max(sizes.get(1, 0), 1)) / min(1, sample / max(sizes.get(0, 0), 1))))
    found = sums.where(useful).orderBy(F.desc(F.col("term") == ""), F.desc("bad"), "term").limit(CANDIDATES).collect()
    n1, n0 = next(((r["bad"], r["good"]) for r in found if r["term"] == ""), (0, 0))
    weights: dict[str, float] = {}
    for term, bad, good in (tuple(r) for r in found if r["term"]):
        tilt = math.log((bad + 0.5) / (n1 + 1)) - math.log((good + 0.5) / (n0 + 1))
        even = (bad + good) / max(n1 + n0, 1)
        ratio = 2 * (bad * math.log(bad / max(even * n1, 1e-9)) + (good * math.log(good / max(even * n0, 1e-9)) if good else 0))
        if tilt > 1.5 and ratio > SIGNIFICANT:
            weights[term] = tilt
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:TERMS])

    def look(batches: Iterator) -> Iterator:
        folding, machine = Folding(), automaton(weights, exceptions or [])
        for batch in batches:
            out = []
            for one, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(one, folding)
                phrases = set()
                for at in hits(folded, machine):
                    before, after = folded[:at].rsplit(None, 1)[-1:], folded[at : at + 400].split(None, 2)
                    phrases.update([" ".join([*before, *after[:1]]), " ".join(after[:2])])
                out.append((y, *features(folded, machine), [p for p in phrases if " " in p]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string())), strict=True)], names=["y", "a", "b", "phrases"])

    scored = known.mapInArrow(look, "y int, a double, b double, phrases array<string>")
    spared = scored.select("y", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).where((F.col("bad") == 0) & (F.col("n") >= LEAST))
    learned = [r["phrase"] for r in spared.orderBy(F.desc("n"), "phrase").limit(TERMS).collect()]
    points = scored.select("y", "a", "b").toPandas()
    curve = _logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy(float)) if n1 and n0 else np.array([-4.0, 1.0, 0.0])
    return {"weights": weights, "exceptions": [*(exceptions or []), *learned], "curve": curve}


OUTPUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_terms", T.LongType())])


def toxicity(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``n_terms`` (words that lexicon terms cover) of every whole text.

    Null and empty texts are scored as texts without terms. Repeated rows get equal scores; input columns named like
    an output are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        folding, machine = Folding(), automaton(model["weights"], model["exceptions"])
        bias, a, b = model["curve"].tolist()

        def run(texts):
            scores, counts = [], []
            for one in texts:
                found = hits(folded := fold(one, folding), machine)
                total = sum(found.values())
                z = bias + a * math.log1p(total) + b * math.log1p(100 * total / max(folded.count(" ") - 1, 20))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                counts.append(len(found))
            return [pa.array(scores, pa.float64()), pa.array(counts, pa.int64())]

        return run

    return map_text(df, text, OUTPUT, make, keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(F.coalesce(id_remainder("doc_id", 5), F.lit(0)) != 0)
    found = toxicity(docs, fit(docs, labels), keep=["doc_id"])
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")
