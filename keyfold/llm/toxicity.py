"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded first: case, accents, look-alike letters of other scripts, digits put for
letters; signs and blanks between words become one blank.  Lexicon entries are words, and
beginnings of words of 4 to 8 letters, that labelled toxic documents use far more often than
clean ones; their weights are log odds.  Phrases around an entry that occur in clean documents
only are exceptions.  The sum of weights, plain and by length, gives the score through a
logistic fit.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import texts

# Look-alike letters, and signs and digits put for letters.
HOMOGLYPHS = dict(zip("абвгдеёзікмнорстухуѕјԁһԛԝ", "a6brдeeзikmhopctyxysjdhqw"))
GREEK = dict(zip("αβεηικνορτυχωγ", "abenikvoptuxwy"))
DIGITS = dict(zip("0134578@$", "oieastbas"))


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for code in [*range(0x21, 0x250), *range(0x370, 0x530), *range(0x2010, 0x2030), *range(0xFF01, 0xFF5F)]:
        c = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        c = HOMOGLYPHS.get(c) or GREEK.get(c) or DIGITS.get(c) or c
        out[code] = c if c.isalnum() else " "
    out.update({9: " ", 10: " ", 13: " "})
    return {k: v for k, v in out.items() if chr(k) != v}


_FOLD = str.maketrans({chr(k): v for k, v in _table().items()})


def fold(text: str) -> str:
    """The text as folded words between single spaces, with one at either end; " " if it has none."""
    words = text.translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Lengths of the beginnings of words that may be entries; shorter ones fit too much, longer ones add little to whole words.
BEGINNINGS = range(4, 9)


def _terms(word: str) -> set[str]:
    return {f" {word} ", *(f" {word[:n]}" for n in BEGINNINGS if n < len(word))}


def _count_terms(batches):
    for batch in batches:
        toxic: Counter = Counter()
        every: Counter = Counter()
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = set().union(*map(_terms, set(fold(text or "").split())))
            every.update(found)
            if label:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[t] for t in every], pa.int64())], names=["term", "docs", "toxic"])


class Matcher:
    """The lexicon and its exceptions as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for t, w in weights.items():
            self.found.add_word(t, (len(t), w))
        for t in exceptions:
            self.found.add_word(t, (len(t), None))
        self.any = bool(weights)
        if self.any:
            self.found.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries outside exceptions; of several that begin alike the longest."""
        if not self.any:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.found.iter(folded):
            a = end - n + 1
            if w is None:
                spared.append((a, end + 1))
            elif a not in best or n > best[a][0] - a:
                best[a] = (end + 1, w)
        if not spared:
            return [(a, b, w) for a, (b, w) in best.items()]
        spared.sort()
        begins = [a for a, _ in spared]
        reach = list(accumulate((e for _, e in spared), max))  # how far any exception reaches that begins there or before
        out = []
        for a, (b, w) in best.items():
            k = bisect_right(begins, a)
            if not k or reach[k - 1] < b:
                out.append((a, b, w))
        return out


def _features(matcher: Matcher, text: str | None) -> tuple[float, float]:
    f = fold(text or "")
    total = sum(w for _, _, w in matcher.hits(f))
    if not total:
        return 0.0, 0.0
    return float(np.log1p(total)), float(np.log1p(100 * total / f.count(" ")))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, turns: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, bound: int = 10_000, least: int = 4, ratio: float = 10.0):
    """(matcher's weights, exceptions, logistic coefficients) from at most bound labelled rows, the lowest by hash of doc_id.

    Entries stand in `least` toxic documents or more, and are `ratio` times likelier there; there
    are as many as the sample has.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(bound)
    rows = spark.createDataFrame(known.collect(), known.schema)  # no more than bound
    sample = texts(docs).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic").persist()
    n1, n = sample.agg(F.sum("toxic"), F.count("*")).first()
    n0 = (n or 0) - (n1 or 0)
    if not n1 or not n0:
        sample.unpersist()
        return {}, [], np.array([-5.0, 0.0, 0.0])
    counts = sample.mapInArrow(_count_terms, "term string, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    odds = (F.col("toxic") + 0.5) / n1 / ((F.col("docs") - F.col("toxic") + 0.5) / n0)
    best = counts.where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") >= ratio)
    best = best.orderBy(F.desc(F.col("toxic") * F.log("odds")), F.length("term"), "term").collect()  # terms of the bounded sample
    weights: dict[str, float] = {}
    reach: dict[str, int] = {}
    for r in best:
        t = r["term"]
        if any(t[:k] in weights and reach[t[:k]] >= r["toxic"] for k in range(5, len(t))):
            continue  # a shorter beginning already says it
        weights[t], reach[t] = float(np.log(r["odds"])), r["toxic"]

    def contexts(batches):
        m = Matcher(weights, [])
        for batch in batches:
            out: Counter = Counter()
            bad: Counter = Counter()
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                f = fold(text or "")
                for a, b, _ in m.hits(f):
                    end = f.find(" ", max(b - 1, a + 1))
                    before, after = f.rfind(" ", 0, a), f.find(" ", end + 1)
                    for phrase in ([f[before : end + 1]] if before >= 0 else []) + ([f[a : after + 1]] if after > 0 else []):
                        out[phrase] += 1
                        bad[phrase] += label
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64()), pa.array([bad[p] for p in out], pa.int64())], names=["phrase", "n", "toxic"])

    seen = sample.mapInArrow(contexts, "phrase string, n long, toxic long").groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    exceptions = [r["phrase"] for r in seen.where("toxic = 0 and n >= 3").orderBy(F.desc("n"), "phrase").collect()]

    def features(batches):
        m = Matcher(weights, exceptions)
        for batch in batches:
            x = [_features(m, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(2)], names=["a", "b", "toxic"])

    x = np.array([tuple(r) for r in sample.mapInArrow(features, "a double, b double, toxic int").collect()], float).reshape(-1, 3)
    sample.unpersist()
    x = x[np.lexsort(x.T)]
    return weights, exceptions, _logistic(x[:, :2], x[:, 2])


def score(docs: DataFrame, labels: DataFrame, bound: int = 10_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts get the score of a text without hits.  A null doc_id is not held out
    (nor can it be labelled); repeated rows are scored each.  Labels other than 0 and 1 and
    other columns are ignored; without usable labels every score is low.  An empty table gives
    an empty result.
    """
    weights, exceptions, b = learn(docs, labels, bound)

    def run(batches):
        m = Matcher(weights, exceptions)
        for batch in batches:
            x = np.array([_features(m, t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            s = 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype("int32"))], names=["doc_id", "score", "predicted"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
