"""Scores documents by a recurrent language model and by word counts.

Words are counted over all training documents.  The most frequent ones have ids of their own in
the model; any other is an unknown word to it, whose probability is the model's for "unknown"
times the word's own share among the rare (add-one).  Counts of frequent words travel with the
code (their number is a parameter); rare words are joined with the count table.

The model starts as a unigram, takes a first pass over a bounded number of documents in one
task, then every partition goes on from there with all of its training documents and the
results are averaged in a tree.  In training the documents of a slice stand one behind the
other in parallel streams, so that every window is full; scores carry the state through each
whole document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from ._tables import Scratch, texts
from ._text import list_array, slices, words

#: Stands among the word hashes for the end of a document.
END = np.int64(-7_046_029_254_386_353_131)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(buf, offsets) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows' words and ends, first): row r has first[r]:first[r + 1].  Some rows at a time, so that the arrays stay small."""
    parts, sizes, i, rows = [], [np.zeros(1, np.int64)], 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 19), "right")) - 1)
        w = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], folded=True)
        first = w.first + np.arange(j - i + 1)
        out = np.empty(int(first[-1]), np.int64)
        end = np.zeros(len(out), bool)
        end[first[1:] - 1] = True
        out[end] = END
        out[~end] = w.hashes.view(np.int64)
        parts.append(out)
        sizes.append(np.diff(first))
        i = j
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.cumsum(np.concatenate(sizes))


def _count(batches):
    for batch in batches:
        parts = [np.unique(_tokens(buf, offsets)[0], return_counts=True) for _, _, buf, offsets in slices(batch.column(0), 4 << 20)]
        if not parts:
            continue
        h, n = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        h, where = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(where, n).astype(np.int64))], names=["h", "c"])


class Vocabulary:
    """Frequent words: ids by hash, their counts; the totals of the corpus."""

    def __init__(self, h: np.ndarray, c: np.ndarray, modelled: int, n: int, v: int, n_classes: int):
        order = np.argsort(h.view(np.uint64))
        self.h, self.c, self.n, self.v = h[order], c[order], n, v
        # hashes by their first bits: bucket b is bucket[b]:bucket[b + 1], few have more than one
        self.shift = np.uint64(64 - max(1, (8 * len(h)).bit_length()))
        self.bucket = np.searchsorted(self.h.view(np.uint64) >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)
        top = np.lexsort((self.h, -self.c))[:modelled]
        top = top[np.argsort(self.h[top])]
        counts = np.append(self.c[top], max(0, n - int(self.c[top].sum()))).astype(float)
        by, self.bounds = gru.classes(counts, n_classes)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.unknown = int(rank[-1])
        self.ids = np.full(len(self.h), self.unknown, np.int64)
        self.ids[top] = rank[:-1]
        self.counts = counts[by]
        self.ids, self.c = np.append(self.ids, self.unknown), np.append(self.c, -1)  # of any other word
        self.logs = np.log10(np.append(self.c[:-1] + 1.0, 1))
        self.end = int(self.ids[self.find(np.array([END]))[0]])
        self.rare_n = int(counts[-1])
        self.rare_v = max(0, v - len(top))

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Places in ids and c; the last, of count -1, for a word that is not among the frequent."""
        last = len(self.h)
        if not last:
            return np.zeros(len(tokens), np.int32)
        of = (tokens.view(np.uint64) >> self.shift).view(np.int64)
        at = np.minimum(self.bucket[of], last - 1)
        left = np.flatnonzero(self.h[at] != tokens)
        while len(left):
            to = at[left] + 1
            more = to < self.bucket[of[left] + 1]
            at[left[~more]] = last
            left, to = left[more], to[more]
            at[left] = to
            left = left[self.h[to] != tokens[left]]
        return at


def _trainer(vocabulary: Vocabulary, shape: gru.Params, passes: int, rows: int, rate: float):
    def run(batches):
        p, moments, n = {k: v.copy() for k, v in shape.items()}, None, 0
        for batch in batches:
            for i, _, buf, offsets in slices(batch.column(0), 8 << 20):
                tokens, first = _tokens(buf, offsets)
                ids = vocabulary.ids[vocabulary.find(tokens)]
                docs = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
                n += sum(map(len, docs))
                for _ in range(passes):
                    moments = gru.train(p, vocabulary.bounds, docs, vocabulary.end, rows, rate=rate, moments=moments)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([gru.pack(p)], pa.binary())], names=["part", "n", "model"])

    return run, "part long, n long, model binary"


def _average(models: DataFrame, fan: int, scratch: Scratch, groups: int) -> bytes | None:
    """The mean of the models, weighted by tokens, fan at a time."""

    def mean(key, table):
        n = table.column("n").to_numpy()
        order = np.argsort(table.column("part").to_numpy())
        total = sum(np.frombuffer(table.column("model")[int(i)].as_py(), "<f4").astype(np.float64) * n[i] for i in order) / n.sum()
        return pa.table({"part": pa.array([key[0].as_py()]), "n": pa.array([int(n.sum())]), "model": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    level = 0
    while True:
        groups = -(-groups // fan)
        models = models.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part").applyInArrow(mean, "part long, n long, model binary")
        models = scratch.save(models, f"mean{level}")
        level += 1
        if groups <= 1:
            break
    row = models.first()
    return bytes(row["model"]) if row else None


def _most_frequent(counts: DataFrame, most: int):
    """Words of the highest counts, at most `most` of them: whole classes of like count, so that no task sorts all words."""
    steps = 16  # classes to a doubling
    of = F.floor(F.log2(F.col("c").cast("double")) * steps).cast("int")
    taken, least = 0, None
    for r in counts.groupBy(of.alias("k")).count().orderBy(F.desc("k")).collect():  # at most 64 * steps rows
        taken += r["count"]
        if taken > most:
            break
        least = r["k"]
    return counts.where(of >= least if least is not None else F.lit(False)).toPandas()


def fit(docs: DataFrame, scratch: Scratch, frequent: int, modelled: int, n_classes: int, width: int, hidden: int, first_docs: int, rows: int, rate: float):
    """(vocabulary, parameters, count table) from docs with a text column, all of them training documents."""
    counts = scratch.save(docs.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.sum(F.when(F.col("h") == int(END), F.col("c")))).first()
    top = _most_frequent(counts, frequent)
    vocabulary = Vocabulary(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), modelled, int(n), int(v), n_classes)
    p = gru.start(vocabulary.counts, vocabulary.bounds, width, hidden)
    if not v:
        return vocabulary, p, counts
    # About first_docs documents by a hash, without a sort; no more than twice as many if doc_ids repeat.
    chance = min(1.0, first_docs / int(ends))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(chance * (1 << 31))).select("text").limit(2 * first_docs)
    run, schema = _trainer(vocabulary, p, 2, min(rows, 32), rate / 2)
    row = some.mapInArrow(run, schema).first()
    p = gru.unpack(bytes(row["model"]), p) if row else p
    run, schema = _trainer(vocabulary, p, 1, rows, rate)
    models = scratch.save(docs.select("text").mapInArrow(run, schema), "models")
    parts = models.agg(F.max("part")).first()[0]
    mean = _average(models, 16, scratch, parts + 1) if parts is not None else None
    return vocabulary, gru.unpack(mean, p) if mean else p, counts


def score(docs: DataFrame, frequent: int = 100_000, modelled: int = 3000, n_classes: int = 52, width: int = 16, hidden: int = 24, first_docs: int = 400, rows: int = 256, rate: float = 9e-3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Counts and gradients cover every training document.  Null and empty texts are one end token.  A null doc_id is not held out;
    repeated rows count and are scored each; other columns are ignored.  With no training
    documents nothing is known and the scores are uniform.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    t = texts(docs)
    vocabulary, p, counts = fit(t.where(~_held_out(F.col("doc_id"))), scratch, frequent, modelled, n_classes, width, hidden, first_docs, rows, rate)
    floor = np.log10(vocabulary.n + vocabulary.v + 1.0)
    rare_floor = np.log10(vocabulary.rare_n + vocabulary.rare_v + 1.0)

    def run(batches):
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1), 8 << 20):
                tokens, first = _tokens(buf, offsets)
                at = vocabulary.find(tokens)
                ids, logs = vocabulary.ids[at], vocabulary.logs[at]
                rows = j - i
                of = np.repeat(np.arange(rows), np.diff(first))
                near = vocabulary.c[at] >= 0
                base = np.bincount(of, logs, rows) - np.diff(first) * floor
                known = np.bincount(of[near], minlength=rows)
                ll = gru.log_likelihoods(p, vocabulary.bounds, [ids[a:b] for a, b in zip(first[:-1], first[1:])], vocabulary.end) / np.log(10)
                odd = ids == vocabulary.unknown
                ll -= np.bincount(of[odd], minlength=rows) * rare_floor
                ll += np.bincount(of[odd], logs[odd], rows)
                far, where = tokens[~near], of[~near]
                order = np.lexsort((far, where))
                far, where = far[order], where[order]
                new = np.append(True, (far[1:] != far[:-1]) | (where[1:] != where[:-1])) if len(far) else np.empty(0, bool)
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(far)))
                per = np.bincount(where[at], minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part + row + np.arange(rows)), batch.column(0).slice(i, rows), pa.array(np.diff(first).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(ll), list_array(far[at], per, pa.int64()), list_array(times.astype(np.int32), per, pa.int32())],
                    names=["row", "doc_id", "n_tokens", "known", "base", "ll", "far", "times"],
                )
                row += rows

    scratch.keep("counts")
    scored = scratch.save(t.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, ll double, far array<long>, times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(counts, "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("add"))
    out = scored.drop("far", "times").join(found, "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("ll") + add).alias("score"))
