"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is wanted t / s times; the whole part is
certain, the fraction is a probability.  Pairs of documents trade probability mass, counted in
words, in a random direction that leaves every expectation as it was, until one of the two is
at 0 or 1.  Words are thus conserved and one fractional document is left of each leaf group;
those residuals are combined in a tree of groups, and the last of each source is drawn.

Documents are dealt to leaves by hash and go from large to small, so that what is left at the
end is small; a hot source or doc_id is only more leaves.  Draws depend on seed, source and
leaf, not on partitions: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per source: rank, source, source_size, docs, target, from a table (source, size).

    Sources rank by code point, null last, and weigh by rank, repeating.  They share all words
    by weight; a target stops at most times its source's size and the excess is shared again,
    which ends at min(cap, level * weight).  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights)).cast("int") + 1))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("capped", F.col("cap") / F.col("weight") <= (F.col("total") - before) / left)
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    level = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / free
    return per.select("rank", "source", "source_size", "docs", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def settle(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of documents in falling order of size: chosen (0, 1, nan for the residual) and the residual's place or -1.

    One document at a time trades with a run of the next ones that have one probability in
    common and together its size, so that it soon is settled however large it is; p is updated.
    """
    eps = 1e-9
    n = len(p)
    out = np.full(n, np.nan)
    sums = np.concatenate([[0.0], np.cumsum(size)])
    cuts = np.flatnonzero(np.diff(p)) + 1
    bounds = [0, *cuts.tolist(), n] if n else [0]
    runs = [(a, b, float(p[a])) for a, b in zip(bounds[:-1], bounds[1:])][::-1]  # a stack; each run is first, end, p
    hold, mass, turn = -1, 0.0, 0
    while runs:
        a, b, q = runs.pop()
        if q <= eps or q >= 1 - eps:
            out[a:b] = float(q > 0.5)
            continue
        if hold < 0:
            hold, mass = a, q * size[a]
            if a + 1 < b:
                runs.append((a + 1, b, q))
            continue
        own = float(size[hold])
        m = min(b, max(a + 1, int(np.searchsorted(sums, sums[a] + own))))
        if m < b:
            runs.append((m, b, q))
        w = sums[m] - sums[a]
        other = q * w
        give, take = min(mass, w - other), min(other, own - mass)
        u = draw[turn % n]
        turn += 1
        move = -give if u * (give + take) < take else take
        mass, other = mass + move, other - move
        runs.append((a, m, float(min(1.0, max(0.0, other / w)))))
        if mass <= eps * own or mass >= own * (1 - eps):
            out[hold] = float(mass > own / 2)
            hold = -1
    if hold >= 0:
        p[hold] = mass / size[hold]
    return out, hold


def _level(seed: int, level: int):
    """Settles one group; rows in: source_rank, bucket, row, size, p; rows out also have chosen, null for the residual."""

    def run(key, table):
        rank, bucket = key[0].as_py(), key[1].as_py()
        size, p = table.column("size").to_numpy(), table.column("p").to_numpy().copy()
        ids = table.column("row").combine_chunks()
        order = np.lexsort((np.arange(len(size)), ids.fill_null(-1).to_numpy(zero_copy_only=False), -size))
        draw = np.random.default_rng([seed, level, rank, bucket]).random(max(1, len(size)))
        sorted_p = p[order]
        chosen, hold = settle(sorted_p, size[order], draw)
        out = pa.table({"rank": pa.array(np.full(len(size), rank)), "bucket": pa.array(np.full(len(size), bucket)), "row": ids.take(pa.array(order)), "size": pa.array(size[order]), "leaf": table.column("leaf").take(pa.array(order)), "p": pa.array(sorted_p), "chosen": pa.array(chosen, from_pandas=True)})
        return out

    return run, "rank long, bucket long, row long, size long, leaf long, p double, chosen double"


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, leaf_rows: int = 5000, fan: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs.

    size counts words; null and empty texts have size 0 and are never taken.  A null source is
    a source of its own, a null doc_id an ordinary document, repeated rows are documents each.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = scratch.save(sizes, "sizes")
    per = scratch.save(targets(sizes, weights, most), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + 1e-9)
    leaves = F.ceil(F.col("docs") / leaf_rows).cast("long")
    t = per.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), wanted - F.col("whole"))).withColumn("leaves", leaves)
    # Rows that agree in all that counts are numbered, so that a doc_id of very many rows is dealt to many leaves, in the same way each time.
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), F.col("leaves")).alias("leaf"), F.col("doc_id").alias("row"), "size", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0).alias("p"))
    run, schema = _level(seed, 0)
    leaf = scratch.save(rows.withColumn("bucket", F.col("leaf")).groupBy("rank", "bucket").applyInArrow(run, schema), "leaf")

    groups = per.agg(F.max(leaves)).first()[0] or 0
    rest, level, decided = leaf.where("chosen is null"), 0, []
    while groups > 1:
        level += 1
        groups = -(-groups // fan)
        run, schema = _level(seed, level)
        up = rest.withColumn("bucket", F.floor(F.col("bucket") / fan)).drop("chosen")
        up = scratch.save(up.groupBy("rank", "bucket").applyInArrow(run, schema), f"level{level}")
        decided.append(up.where("chosen is not null"))
        rest = up.where("chosen is null")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "rank"), F.lit(1 << 30)) / float(1 << 30)
    last = rest.withColumn("chosen", (draw < F.col("p")).cast("double"))
    for part in decided:
        last = last.union(part)
    last = last.select(F.col("rank").alias("r"), F.col("leaf").alias("l"), F.col("chosen").alias("late"))
    out = leaf.join(last, (F.col("rank") == F.col("r")) & (F.col("leaf") == F.col("l")) & F.col("chosen").isNull(), "left")
    out = out.join(t.select("rank", "source", "source_size", "target", "whole"), "rank")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("chosen", "late", F.lit(0.0)).cast("long")).otherwise(0)
    return out.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
