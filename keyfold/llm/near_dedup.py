"""Near-duplicate documents from bottom-k sketches of one hash function.

1. One pass hashes each document's 5-word shingles and keeps, besides the number of distinct
   shingles and a hash of the whole set, the k smallest hash values: the sketch.
2. Documents with equal sets are one class; its smallest doc_id stands for it from here on.
3. Retained values are inverted into lists.  Of each sketch only the rarest values are listed:
   two sketches that share at least `need` values must share one among the m - need + 1 rarest
   of each (m values in the sketch), so nothing is lost by leaving the frequent ones out, and
   a passage that many documents quote makes no long list.
4. Documents that share a list are overlaps.  Each meets the smallest document of its lists and,
   block by block, the others that do; the union sketch of two estimates their similarity, and
   those that it does not rule out are joined to clusters.  Only sketches travel for this.
5. Full shingle sets travel once, to their clusters, where links are verified.
6. Groups, whether of a list's smallest document or clusters, are cut into blocks, each with the
   group's smallest document, so that near copies by the thousand are one component after linear
   work.  Where a group is still in several, what is not in the largest meets all blocks.

`need` is exact for sets no larger than the sketch.  Beyond, a pair at the threshold is missed
with a probability under 1e-9 (binomial tail over the union sketch).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch, texts
from ._text import lean, list_array, mix, slices, words
from .components import connected_components

_MULT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending as signed integers.

    Fewer than size words, but at least one, make one shingle; no word makes none.
    """
    w = words(buf, offsets, folded=True)
    h, total = w.hashes, len(w.hashes)
    if total >= size:
        grams = np.zeros(total - size + 1, np.uint64)
        for k in range(size):
            grams += h[k : total - size + 1 + k] * _MULT[k]
        grams = mix(grams).view(np.int64)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            short = (h[a:b] * _MULT[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    flat = np.concatenate([*sets, np.empty(0, np.int64)]).view(np.uint64)
    ends = np.cumsum([0, *map(len, sets)])
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat ^ np.uint64(salt)), out=total[1:])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def tail_need(k: int, threshold: float, miss: float = 1e-9) -> int:
    """The largest s for which fewer than s of k union-sketch values are shared with probability under miss."""
    p, s = 0.0, 0
    while True:
        p += math.comb(k, s) * threshold**s * (1 - threshold) ** (k - s)
        if p > miss:
            return max(1, s)
        s += 1


def _sketches(k: int, size: int):
    schema = "doc_id long, n long, h1 long, h2 long, sketch array<long>"

    def run(batches):
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1)):
                sets = shingle_sets(buf, offsets, size)
                n = np.array([len(s) for s in sets], np.int64)
                h1, h2 = set_hashes(sets)
                flat = np.concatenate([s[:k] for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(h1), pa.array(h2), list_array(flat, np.minimum(n, k), pa.int64())],
                    names=["doc_id", "n", "h1", "h2", "sketch"],
                )

    return run, schema


def _overlaps(sets: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """Matrix of intersection sizes, from an inverted index cut into strips of values.

    Values are taken in the order of the first set that holds them, so the sets of a strip are
    few where sets that have nothing in common stand apart.
    """
    m = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    value, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), lengths)
    shared = count[where] > 1
    row, where = row[shared], where[shared]
    first = np.full(len(value), m)
    np.minimum.at(first, where, row)
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(value))  # values in one set only come last
    where = rank[where]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    out = np.zeros((m, m), np.float32)
    columns = int(where[-1]) + 1 if len(where) else 0
    for at in range(0, columns, width):
        a, b = np.searchsorted(where, (at, at + width))
        who, place = np.unique(row[a:b], return_inverse=True)
        strip = np.zeros((len(who), min(width, columns - at)), np.float32)
        strip[place, where[a:b] - at] = 1
        out[np.ix_(who, who)] += strip @ strip.T
    out[np.arange(m), np.arange(m)] = lengths
    return out


def _alike(sketches: list[np.ndarray], n: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Matrix of pairs that the union sketch of both does not rule out, each with itself too."""
    t = percent / 100
    shared = _overlaps(sketches)
    high = np.iinfo(np.int64).max
    top = np.array([high if c <= k else s[-1] for s, c in zip(sketches, n)], np.int64)
    rank = np.stack([np.searchsorted(s, top, "right") for s in sketches])  # [a, b]: values of a up to b's largest
    own = np.array([len(s) for s in sketches])
    union = np.where(top[:, None] <= top[None, :], own[:, None] + rank.T, rank + own[None, :]) - shared
    exact = (top == high)[:, None] & (top == high)[None, :]
    slack = np.where(exact, 0, 6.5 * np.sqrt(union * t * (1 - t)))
    return shared + slack + 1e-3 >= t * union


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.int64)
    both = _overlaps(sets).astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _star(ids: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
    """(document, smallest document it is joined with) of all that are joined with a smaller one."""
    order = np.argsort(ids, kind="stable")
    ids, linked = ids[order], linked[np.ix_(order, order)]
    label = np.arange(len(ids))
    while True:
        low = np.where(linked, label[None, :], len(ids)).min(axis=1, initial=len(ids))
        low = np.minimum(low, label)[low] if len(low) else low
        if np.array_equal(low, label):
            break
        label = low
    keep = ids[label] != ids
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[label][keep])], names=["u", "v"])


def _whole_groups(batches, weight: str, most_rows: int, most_weight: int):
    """Tables of whole groups (equal first column; rows come sorted by it), closed beyond a number of rows or a weight."""
    held: list[pa.RecordBatch] = []
    rows = heavy = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        ahead = np.concatenate([[0], np.cumsum(batch.column(batch.schema.get_field_index(weight)).to_numpy())])
        begins = np.flatnonzero(g[1:] != g[:-1]) + 1
        at = 0
        for s in ([0] if last is not None and g[0] != last else []) + begins.tolist():
            if rows + s - at >= most_rows or heavy + ahead[s] - ahead[at] >= most_weight:
                yield pa.Table.from_batches([*held, batch.slice(at, s - at)])
                held, rows, heavy, at = [], 0, 0, s
        held.append(batch.slice(at))
        rows, heavy, last = rows + len(g) - at, heavy + ahead[-1] - ahead[at], g[-1]
    if held:
        yield pa.Table.from_batches(held)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    col = table.column(name).combine_chunks()
    flat, at = col.values.to_numpy(), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


class _Meetings:
    """What compares the documents of a group: rows (g, rep) in, links (u, v) out, as stars; groups are met by the batch."""

    def __init__(self, docs: DataFrame, reps: DataFrame, scratch: Scratch, k: int, size: int, percent: int, batch_rows: int, batch_shingles: int):
        self.docs, self.reps, self.scratch, self.k, self.size, self.percent, self.batch_rows, self.batch_shingles = docs, reps, scratch, k, size, percent, batch_rows, batch_shingles

    def estimate(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """Links that the sketches do not rule out."""
        k, percent, most = self.k, self.percent, self.batch_rows

        def run(batches):
            for t in _whole_groups(batches, "n", most, 1 << 62):
                ids, n, sketches = t.column("rep").to_numpy(), t.column("n").to_numpy(), _lists(t, "sketch")
                mark = mix(ids.view(np.uint64) + mix(np.array([s.sum(dtype=np.int64) for s in sketches]).view(np.uint64)))
                _, at = np.unique(mark, return_index=True)
                at.sort()
                yield _star(ids[at], _alike([sketches[i] for i in at], n[at], k, percent))

        met = rows.join(self.reps.select("rep", "n", "sketch"), "rep").select("g", "rep", "n", "sketch")
        return met.repartition("g").sortWithinPartitions("g", "rep").mapInArrow(lean(run), "u long, v long")

    def verify(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """Links by the full sets; with a name, of what may be few documents."""
        size, percent, most, heavy = self.size, self.percent, self.batch_rows, self.batch_shingles

        def full(batches):
            for b in batches:
                ids, h1, h2, met, text = (b.column(b.schema.get_field_index(c)) for c in ("rep", "h1", "h2", "met", "text"))
                for i, j, buf, offsets in slices(text):
                    sets = shingle_sets(buf, offsets, size)
                    a, c = set_hashes(sets)
                    # a doc_id may stand for several texts; the hashes tell which one is meant
                    own = np.flatnonzero((a == h1.slice(i, j - i).to_numpy()) & (c == h2.slice(i, j - i).to_numpy()))
                    take, n = pa.array(own + i), [len(sets[x]) for x in own]
                    flat = np.concatenate([sets[x] for x in own]) if len(own) else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([ids.take(take), met.take(take), pa.array(n, pa.int64()), list_array(flat, n, pa.int64())], names=["rep", "met", "n", "members"])

        def run(batches):
            for t in _whole_groups(batches, "n", most, heavy):
                yield _star(t.column("rep").to_numpy(), _linked(_lists(t, "members"), percent))

        per = rows.groupBy("rep").agg(F.collect_set("g").alias("met")).join(self.reps.select("rep", "h1", "h2"), "rep")
        if name:  # written, so that Spark knows its size and leaves the texts where they are if it is small
            per = self.scratch.save(per, name)
        sets = texts(self.docs).withColumnRenamed("doc_id", "rep").join(per, "rep").mapInArrow(lean(full), "rep long, met array<long>, n long, members array<long>")
        dealt = sets.select(F.explode("met").alias("g"), "rep", "n", "members").repartition("g").sortWithinPartitions("g", "rep")
        return dealt.mapInArrow(lean(run), "u long, v long")


def _components(member: DataFrame, compare, blocks, links: DataFrame | None, scratch: Scratch, name: str, block_rows: int) -> DataFrame:
    """(node, component) of documents that the groups (group, rep, n) join by `compare`, or `links` besides.

    A group is known by its smallest document.  Each of its blocks meets that document; where
    the group is not one component then, the documents outside its largest one meet all blocks.
    """
    heads = scratch.save(member.groupBy("group").agg(blocks.cast("int").alias("blocks")), f"{name}-heads")
    member = scratch.save(member.join(heads, "group").select("group", "rep", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own")), f"{name}-members")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = heads.where("blocks > 1")
    first = large.select("group", numbers("blocks").alias("own")).select(F.xxhash64("group", "own").alias("g"), F.col("group").alias("rep"))
    found = scratch.save(compare(member.select(F.xxhash64("group", "own").alias("g"), "rep").union(first)), f"{name}-links")
    found = found.union(links) if links is not None else found
    joined = connected_components(found, scratch, f"{name}-joined")
    if large.isEmpty():
        return joined
    of = member.where("blocks > 1").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    per = of.groupBy("group", "c").agg(F.count("*").alias("n"))
    open_ = per.groupBy("group").agg(F.max_by("c", "n").alias("largest"), F.count("*").alias("parts"), F.ceil((F.sum("n") - F.max("n")) / block_rows).cast("int").alias("turns")).where("parts > 1")
    open_ = scratch.save(open_.select("group", "largest", "turns"), f"{name}-open")
    if open_.isEmpty():
        return joined
    of = of.join(open_, "group")
    every = of.select("group", "own", numbers("turns").alias("turn"), "rep")
    apart = of.where("c <> largest").withColumn("turn", F.pmod(F.xxhash64(F.lit(name), "rep"), F.col("turns")).cast("int")).select("group", numbers("blocks").alias("own"), "turn", "rep")
    more = scratch.save(compare(every.union(apart).select(F.xxhash64("group", "own", "turn").alias("g"), "rep"), f"{name}-again"), f"{name}-more")
    return connected_components(found.union(more), scratch, f"{name}-all") if not more.isEmpty() else joined


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, k: int = 64, block_rows: int = 1000, block_shingles: int = 500_000, batch_rows: int = 256, batch_shingles: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Links pairs with 100 * |intersection| >= percent * |union| of their shingle sets and returns
    the smallest doc_id reachable.  Null and empty texts, and texts without words, have an empty
    set and stand alone.  Rows that repeat a doc_id are one document, linked by any of its texts;
    each row is returned with its own set's size.  A null doc_id stands alone with a null
    component and is kept.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    run, schema = _sketches(k, size)
    sk = scratch.save(texts(docs).mapInArrow(lean(run), schema), "sketches")
    found = sk.where("n > 0 and doc_id is not null")
    reps = scratch.save(found.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")

    need = tail_need(k, percent / 100)
    whole = k * percent // 100  # such a set and any partner are whole in their sketches
    values = reps.select("rep", "h1", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    # Tables that are joined are written: both sides are then plain shuffles, of which a very common key can be split.
    often = scratch.save(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = values.join(often, "v").groupBy("rep", "h1", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    required = F.when(F.col("m") <= whole, F.ceil(F.col("m") * percent / 100)).otherwise(F.lit(need))
    spare = F.greatest(F.lit(0), (F.col("m") - required + 1 - (F.col("m") - F.size("vs"))).cast("int"))
    lists = scratch.save(ranked.select("rep", "n", F.explode(F.slice("vs", F.lit(1), spare)).alias("x")).select("rep", "n", F.col("x.v").alias("v")), "lists")
    hubs = scratch.save(lists.groupBy("v").agg(F.count("*").alias("c"), F.min("rep").alias("group")).where("c > 1").select("v", "group"), "hubs")
    member = lists.join(hubs, "v").groupBy("group", "rep").agg(F.max("n").alias("n"))

    meet = _Meetings(docs, reps, scratch, k, size, percent, batch_rows, batch_shingles)
    rows = F.ceil(F.count("*") / block_rows)
    clusters = _components(member, meet.estimate, rows, None, scratch, "near", block_rows)
    member = clusters.select(F.col("component").alias("group"), F.col("node").alias("rep")).join(reps.groupBy("rep").agg(F.max("n").alias("n")), "rep")
    again = found.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("doc_id")
    several = found.join(again, "doc_id").join(reps.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    joined = _components(member.select("group", "rep", "n"), meet.verify, F.greatest(rows, F.ceil(F.sum("n") / block_shingles)), several, scratch, "exact", block_rows)

    of = reps.select("h1", "h2", "n", "rep").join(joined.select(F.col("node").alias("rep"), F.col("component").alias("joined")), "rep", "left")
    of = scratch.save(of.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("kn"), F.coalesce("joined", "rep").alias("joined")), "result")
    scratch.keep("sketches", "result")
    out = sk.join(of, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") == F.col("kn")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("joined", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
