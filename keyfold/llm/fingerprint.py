"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases, phrases are named by a hash of what they hold, the names
are cut again, and so on.  Where to cut is found by deterministic coin tossing: runs of one
symbol become one, each symbol is labelled by the lowest bit in which it differs from its left
neighbour, this is repeated until labels are few, and phrases begin at local maxima.  A cut
depends on a few neighbours only, so equal substrings get equal phrases inside, wherever they
stand.  The fingerprint is the smallest phrase names of the upper levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Scratch, texts
from ._text import _BASE, _BASE_INVERSE, _powers, mix

LEAST_LEVEL, KEPT = 3, 32
_NAMES = mix(np.arange(1, 257, dtype=np.uint64))


def _lowest_difference(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One round of coin tossing; a text's first symbol is set against itself with bit 0 turned."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[starts] = x[starts] ^ x.dtype.type(1)
    d = x ^ before
    bit = np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1)).astype(x.dtype)
    return (bit << x.dtype.type(1)) | ((x >> bit) & x.dtype.type(1))


def _groups(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Names of consecutive groups of symbols that begin at the places given."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    end = np.append(begin[1:], len(values))
    return mix((total[end] - total[begin]) * _powers(_BASE_INVERSE, len(values))[begin] + (end - begin).astype(np.uint64))


def _cut(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all texts, and where each text begins among them."""
    fresh = np.empty(len(x), bool)
    fresh[0] = True
    fresh[1:] = x[1:] != x[:-1]
    fresh[starts] = True
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(x)))
    names, long = x[at], length > 1  # a symbol that stands once keeps its name, whatever else is in the batch
    names[long] = mix(names[long] + (length[long].astype(np.uint64) - np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    starts = np.searchsorted(at, starts)
    label = _lowest_difference(names, starts).astype(np.uint8)
    for _ in range(2):
        label = _lowest_difference(label, starts)
    top = np.zeros(len(label), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    top[starts[1:] - 1] = False  # no phrase begins at a text's last symbol: what follows is another text
    top[starts] = True
    begin = np.flatnonzero(top)
    return _groups(names, begin), np.searchsorted(begin, starts)


def phrase_names(raw: list[bytes], least_level: int = LEAST_LEVEL) -> list[np.ndarray]:
    """Distinct names of each text's phrases at the upper levels; of a short text, of its highest level."""
    out: list[list[np.ndarray]] = [[] for _ in raw]
    who = np.array([i for i, r in enumerate(raw) if r], np.int64)
    if not len(who):
        return [np.empty(0, np.uint64) for _ in raw]
    data = np.frombuffer(b"".join(raw), np.uint8)
    x = _NAMES[data]
    starts = np.concatenate([[0], np.cumsum([len(raw[i]) for i in who])[:-1]]).astype(np.int64)
    level = 0
    while len(who):
        x, starts = _cut(x, starts)
        level += 1
        size = np.diff(np.append(starts, len(x)))
        if level >= least_level:
            for i, a, n in zip(who.tolist(), starts.tolist(), size.tolist()):
                out[i].append(x[a : a + n])
        elif (size == 1).any():
            for i, a in zip(who[size == 1].tolist(), starts[size == 1].tolist()):
                out[i].append(x[a : a + 1])
        more = size > 1
        if not more.all():
            x = x[np.repeat(more, size)]
            who, size = who[more], size[more]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.empty(0, np.int64)
    return [np.unique(np.concatenate(o)) if o else np.empty(0, np.uint64) for o in out]


def fingerprints(raw: list[bytes], kept: int = KEPT) -> list[np.ndarray]:
    """Ascending 32-bit sketches."""
    return [np.unique(n[:kept] >> np.uint64(32)) for n in phrase_names(raw)]


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of phrases in common, from the smallest of both together; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:kept]
    return float(np.isin(union, a).__and__(np.isin(union, b)).sum() / len(union))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES_OUT = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_EDGES = _SCHEMA + ", part int, edge int, text string"
FIRST, LAST = 1, 2


def _compared(ids: list, own: list[str], following: list[str]) -> list[tuple]:
    """Result rows of texts, each with the text that follows it."""
    halves = [len(t) // 2 for t in own]
    edited = [(t[: len(t) - h] + n[:h]).encode() for t, h, n in zip(own, halves, following)]
    raw = {t: k for k, t in enumerate(dict.fromkeys([*own, *following]))}  # most texts stand in both lists
    prints = fingerprints([t.encode() for t in raw])
    after = fingerprints(edited)
    out = []
    for i, t, n, e, f in zip(ids, own, following, edited, after):
        a = prints[raw[t]]
        out.append((i, len(t), hashlib.sha256(e).hexdigest(), text_of(a), text_of(f), likeness(a, f), likeness(a, prints[raw[n]])))
    return out


def _table(rows: list[tuple], edges: bool) -> pa.RecordBatch:
    kinds, names = _KINDS, _NAMES_OUT
    if edges:
        kinds, names = [*kinds, pa.int32(), pa.int32(), pa.string()], [*names, "part", "edge", "text"]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _within(limit: int = 1 << 20):
    """Compares neighbours of a sorted partition; its first and last row also go out as they are."""

    def run(batches):
        part, held, size, begun = TaskContext.get().partitionId(), [], 0, False
        edge = lambda row, which: (row[0], *[None] * 6, part, which, row[1])
        plain = lambda rows: [(*r, part, 0, None) for r in rows]
        compared = lambda h: _compared([x[0] for x in h[:-1]], [x[1] for x in h[:-1]], [x[1] for x in h[1:]])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((i, t))
                size += len(t)
                if not begun:
                    yield _table([edge(held[0], FIRST)], True)
                    begun = True
                if size >= limit:
                    yield _table(plain(compared(held)), True)
                    held, size = held[-1:], len(t)
        if held:
            yield _table([*plain(compared(held)), edge(held[-1], LAST)], True)

    return run


def _across(batches):
    for batch in batches:
        ids, own, following = (c.to_pylist() for c in batch.columns)
        yield _table(_compared(ids, own, following), False)


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the next by doc_id, nulls first (rows of one doc_id by a hash of their
    text, then the text), and the first after the last; a single document is next to itself.
    Null and empty texts have an empty fingerprint, alike only to an empty one.  Other columns
    are ignored; an empty table gives an empty result.

    Rows are dealt out once, by ranges.  The last row of each range meets the first row of the
    next one in a second step, of two rows a range.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprint")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = t.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    rows = scratch.save(dealt.mapInArrow(_within(), _EDGES), "rows", "zstd")  # hexadecimal digits, half of them redundant
    heads = rows.where(F.col("edge") == FIRST)
    turn = Window.partitionBy(F.lit(0)).orderBy("part")  # a row a range, without its text
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("part", F.coalesce(F.lead("part").over(turn), F.min("part").over(whole)).alias("to"))
    last = rows.where(F.col("edge") == LAST).select("part", "doc_id", "text").join(following, "part")
    met = last.join(heads.select(F.col("part").alias("to"), F.col("text").alias("following")), "to").select("doc_id", "text", "following")
    return rows.where("edge = 0").select(*_NAMES_OUT).union(met.mapInArrow(_across, _SCHEMA))
