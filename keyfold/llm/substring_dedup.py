"""Removes bytes covered by long strings that occur more than once.

Every window of 200 bytes has an anchor, the leftmost of its 24-byte grams with the smallest
hash; equal windows have equal anchors at equal places.  Consecutive windows with one anchor
form a span; equal spans are handled as one.  Where an anchor has several different spans,
their bytes are dealt out by anchor and a Burrows-Wheeler transform of every bucket tells which
windows occur again (see bwt).  Anchors and spans only choose what to compare: a window is
compared with every other window that could equal it.

Spans of one anchor that together are too long for a bucket are split: by half of the windows'
places relative to the anchor, and by the bytes that all windows of a half have in common
around it.  Equal windows stay together, and each turn doubles what those of a group share,
until at the last all windows of a group are equal; so a group never outgrows a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch, texts
from ._text import prefix_hash, slices, span_hash
from .bwt import repeated_starts

_PLACE = np.uint64(28)
_MASK = np.uint64((1 << 28) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def spans(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, hash, first window, windows) of each span of the rows of a slice."""
    empty = np.empty(0, np.int64)
    if len(buf) < length:
        return empty, empty, empty, empty, empty
    prefix = prefix_hash(buf)
    at = np.arange(len(buf) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    place = _sliding_min(((grams >> _PLACE) << _PLACE) | at.astype(np.uint64), length - gram + 1) & _MASK
    windows = np.maximum(0, np.diff(offsets) - length + 1)
    total = int(windows.sum())
    if not total:
        return empty, empty, empty, empty, empty
    row = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    p = place[start].astype(np.int64)
    new = np.append(True, (p[1:] != p[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, total))
    lo, anchor = start[first], p[first]
    h = span_hash(prefix, lo, lo + n + length - 1) + (anchor - lo).astype(np.uint64)
    return row[first], grams[anchor].view(np.int64), h.view(np.int64), lo - offsets[row[first]], n


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, min(b, n)))
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _anchor(buf: np.ndarray, length: int, gram: int) -> int:
    """Place of the anchor of the first window, and so of all windows of the span."""
    at = np.arange(length - gram + 1)
    grams = span_hash(prefix_hash(buf[:length]), at, at + gram)
    return int(np.argmin(((grams >> _PLACE) << _PLACE) | at.astype(np.uint64)))


#: A piece of a span whose windows are compared within `key`: windows first .. first + n of span (a, s), whose anchor is `at`
#: bytes behind the first (-1: not yet looked up) and low .. high bytes behind each; known: no need to tell that they occur again.
_PIECE = "key long, same long, a long, s long, first int, n int, at int, low int, high int, known boolean, bytes binary"


def _halves(length: int, gram: int):
    names = [x.split()[0] for x in _PIECE.split(", ")]
    number = lambda seed, raw: int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=(seed & (2**64 - 1)).to_bytes(8, "little")).digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw, at = r["bytes"], r["at"]
                if at < 0:
                    at = _anchor(np.frombuffer(raw, np.uint8), length, gram)
                mid = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], mid), (mid + 1, r["high"])):
                    x, y = max(0, at - high), min(r["n"] - 1, at - low)
                    if x <= y:
                        part = raw[x : y + length]
                        key = number(r["key"] ^ low, raw[at - low : at + length - high])  # what all windows of the half cover
                        out.append((key, number(at - x, part), r["a"], r["s"], r["first"] + x, y - x + 1, at - x, low, high, r["known"], part))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 11, _KINDS)], names=names)

    return run


_KINDS = [*[pa.int64()] * 4, *[pa.int32()] * 5, pa.bool_(), pa.binary()]


def _bounded(work: DataFrame, scratch: Scratch, length: int, gram: int, group_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(pieces by key, no key with more than group_bytes of different ones; (a, s, x, y) of windows found to occur again on the way)."""
    done, found, turn = [], [], 0
    while True:
        work = scratch.save(work, f"pieces{turn}")
        size = F.sum(F.length("bytes"))
        big = work.where("low < high").groupBy("key").agg(size.alias("size")).where(F.col("size") > group_bytes).select("key")
        big = scratch.save(big, f"big{turn}")
        if big.isEmpty():
            done.append(work)
            break
        done.append(work.join(big, "key", "left_anti").select(*work.columns))
        halves = scratch.save(work.join(big, "key").select(*work.columns).mapInArrow(_halves(length, gram), _PIECE), f"halves{turn}")
        often = halves.groupBy("key", "same").agg(F.count("*").alias("m")).where("m > 1").select("key", "same")
        found.append(halves.where("not known").join(often, ["key", "same"]).select("a", "s", F.col("first").alias("x"), (F.col("first") + F.col("n")).alias("y")))
        one = F.min(F.struct("a", "s", "first")).alias("one")
        rest = [F.first(c).alias(c) for c in ("n", "at", "low", "high", "bytes")]
        work = halves.groupBy("key", "same").agg(one, *rest, (F.bool_or("known") | (F.count("*") > 1)).alias("known"))
        work = work.select("key", "same", "one.a", "one.s", "one.first", "n", "at", "low", "high", "known", "bytes")
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out, found


def repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 24, bucket_bytes: int = 1_000_000, group_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(docs as doc_id, text, th; doc_id, th, x: the byte intervals (begin, end) to remove), by doc_id and text hash."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    t = texts(docs).withColumn("th", F.xxhash64("text"))

    def find(batches):
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1)):
                row, a, s, lo, n = spans(buf, offsets, length, gram)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(a), pa.array(s), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "th", "a", "s", "lo", "n"])

    seg = scratch.save(t.mapInArrow(find, "doc_id long, th long, a long, s long, lo int, n int"), "spans")
    # Written, so that both sides of the join are plain shuffles and a very common anchor can be split.
    multi = scratch.save(seg.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "anchors")
    cand = scratch.save(seg.join(multi, "a"), "candidates")
    scratch.drop("spans", "anchors")
    kinds = scratch.save(cand.groupBy("a", "s").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.struct("doc_id", "th", "lo")).alias("rep")), "kinds")
    # Grouped by the complement for the same reason: the join shuffles both sides anew.
    per = kinds.groupBy(F.bitwise_not("a").alias("not_a")).agg(F.count("*").alias("different"), F.min("c").alias("least"))
    per = per.where("different > 1 and least = 1").select(F.bitwise_not("not_a").alias("a"))
    open_ = kinds.join(per, "a").select("a", "s", "c", "n", "rep.doc_id", "rep.th", "rep.lo")
    by_doc = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "s", "c", "lo", "n")).alias("x"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), *(F.col(f"x.{k}").alias(k) for k in ("a", "s", "c", "lo", "n")))
    same = lambda d, h: F.col("doc_id").eqNullSafe(F.col(d)) & F.col("th").eqNullSafe(F.col(h))
    once = t.join(by_doc, same("d", "h"))  # repeated rows give repeated contexts, dropped below

    def cut(batches):
        for batch in batches:
            text = [x.encode() for x in batch.column(0).to_pylist()]
            lists = [batch.column(k) for k in range(1, 6)]
            per_row = np.diff(lists[0].offsets.to_numpy())
            flat = [x.flatten() for x in lists]
            lo, n = flat[3].to_numpy(), flat[4].to_numpy()
            of = np.repeat(np.arange(len(text)), per_row)
            bytes_ = [text[r][a : a + k + length - 1] for r, a, k in zip(of.tolist(), lo.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([flat[0], flat[1], flat[2], flat[4], pa.array(bytes_, pa.binary())], names=["a", "s", "c", "n", "bytes"])

    ctx = once.select("text", "a", "s", "c", "lo", "n").mapInArrow(cut, "a long, s long, c long, n int, bytes binary").dropDuplicates(["a", "s"])
    whole = lambda x: F.lit(x).cast("int")
    ctx = ctx.select(F.col("a").alias("key"), F.col("s").alias("same"), "a", "s", whole(0).alias("first"), "n", whole(-1).alias("at"), whole(0).alias("low"), whole(length - gram).alias("high"), (F.col("c") > 1).alias("known"), "bytes")
    pieces, found = _bounded(ctx, scratch, length, gram, group_bytes)
    size = pieces.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size) // bucket_bytes))

    def look(key, table):
        raw = table.column("bytes").to_pylist()
        text = np.zeros(sum(map(len, raw)) + len(raw), np.int64)
        at, begin = 0, []
        for r in raw:
            begin.append(at)
            text[at : at + len(r)] = np.frombuffer(r, np.uint8).astype(np.int64) + 1
            at += len(r) + 1
        again = repeated_starts(text, length)
        a, lo, hi = [], [], []
        for k, (b, n, first, known) in enumerate(zip(begin, *(table.column(c).to_pylist() for c in ("n", "first", "known")))):
            if known:
                continue
            for x, y in zip(*_runs(again[b : b + n])):
                a.append(k)
                lo.append(first + x)
                hi.append(first + y)
        take = pa.array(a, pa.int64())
        return pa.table({"a": table.column("a").take(take), "s": table.column("s").take(take), "x": pa.array(lo, pa.int32()), "y": pa.array(hi, pa.int32())})

    dealt = pieces.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "a", "s", "first", "n", "known", "bytes")
    part = dealt.groupBy("bucket").applyInArrow(look, "a long, s long, x int, y int")
    for f in found:
        part = part.union(f)

    first = kinds.where("c = 1").select(F.col("a").alias("ka"), F.col("s").alias("ks"), "rep.doc_id", "rep.th", "rep.lo")
    partial = part.join(first, (F.col("a") == F.col("ka")) & (F.col("s") == F.col("ks"))).select("doc_id", "th", (F.col("lo") + F.col("x")).alias("begin"), (F.col("lo") + F.col("y") + length - 1).alias("end"))
    every = cand.join(kinds.where("c > 1").select("a", "s"), ["a", "s"]).select("doc_id", "th", F.col("lo").alias("begin"), (F.col("lo") + F.col("n") + length - 1).alias("end"))
    # A set: rows that repeat a document have its spans once.
    gone = every.union(partial).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("x"))
    gone = scratch.save(gone, "gone")
    scratch.keep("gone")
    return t, gone


def _join(t: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("x.begin").alias("begins"), F.col("x.end").alias("ends"))
    return t.join(g, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "begins", "ends")


def _kept(raw: bytes, begins, ends) -> tuple[list[tuple[int, int]], bytes]:
    cover = _covered(len(raw), np.array(begins or [], np.int64), np.array(ends or [], np.int64))
    out, at = [], 0
    for a, b in cover:
        out.append(raw[at:a])
        at = b
    return cover, b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, kept (the remaining bytes) for every row of docs; see dedup()."""
    def run(batches):
        for batch in batches:
            kept = [_kept((x or "").encode(), b, e)[1] for x, b, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return _join(*repeated_bytes(docs, length)).mapInArrow(run, "doc_id long, kept binary")


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Null and empty texts, and texts under length bytes, keep all they have.  Rows that repeat a
    doc_id are rows of their own, and a repeated row repeats its text: both are removed (if long
    enough).  A null doc_id is kept as null.  Other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches):
        for batch in batches:
            n, removed, count, sha = [], [], [], []
            for x, b, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw = (x or "").encode()
                cover, kept = _kept(raw, b, e)
                n.append(len(raw))
                removed.append(len(raw) - len(kept))
                count.append(len(cover))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, removed, count)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _join(*repeated_bytes(docs, length)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
