"""Document quality by weak supervision.

Rules look at text statistics and vote good, bad or abstain.  How far each rule is to be
believed is not set by hand: expectation-maximisation over all documents' vote patterns
estimates, per rule, how often it votes which way on good and on bad documents, and the
posterior probability of being good replaces an all-rules-must-pass filter.

The patterns are counted by Spark; at most 2^rules of them come to the driver, whatever the
size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import Scratch, texts
from ._text import CONTINUATION, SPACE, lean, mix, prefix_hash, slices, span_hash, words

BAD, ABSTAIN, GOOD = 0, 1, 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_MULT = mix(np.arange(101, 106, dtype=np.uint64)) | np.uint64(1)

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs", "n_distinct_words"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over keys: the key occurs again somewhere; the key occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    again, before = np.empty(len(keys), bool), np.empty(len(keys), bool)
    again[order] = same[:-1] | same[1:]
    before[order] = same[:-1]
    return again, before


def text_stats(buf: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of each row of a slice, by the names in STATS."""
    rows = len(offsets) - 1
    prefix = prefix_hash(buf)
    w = words(buf, offsets, prefix=prefix)
    row_of_word = np.repeat(np.arange(rows), np.diff(w.first))
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(w.first), "word_chars": _per_row(~SPACE[buf] & ~CONTINUATION[buf], offsets)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_bangs", _BANG)):
        out[name] = _per_row(table[buf], offsets)

    breaks = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    row_of_line = np.searchsorted(offsets[1:], begin, "right")
    filled = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end, row_of_line = begin[filled], end[filled], row_of_line[filled]
    _, before = _repeats(span_hash(prefix, begin, end) ^ salt[row_of_line])
    out["n_lines"] = np.bincount(row_of_line, minlength=rows)
    out["n_dup_lines"] = np.bincount(row_of_line[before], minlength=rows)

    covered = np.zeros(len(w.hashes), bool)
    n = len(w.hashes) - window + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for k in range(window):
            grams += w.hashes[k : n + k] * _MULT[k % 5]
        inside = row_of_word[:n] == row_of_word[window - 1 :]
        at = np.flatnonzero(inside)
        again, _ = _repeats(mix(grams[at]) ^ salt[row_of_word[at]])
        for k in range(window):
            covered[at[again] + k] = True
    out["n_repeat_words"] = np.bincount(row_of_word[covered], minlength=rows)
    _, before = _repeats(w.hashes ^ salt[row_of_word])
    out["n_distinct_words"] = out["n_words"] - np.bincount(row_of_word[before], minlength=rows)
    return out


def _stats(batches):
    for batch in batches:
        for i, j, buf, offsets in slices(batch.column(1)):
            s = text_stats(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(s[k].astype(np.int64)) for k in STATS)], names=["doc_id", *STATS])


def _vote(vote: int, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), vote).otherwise(ABSTAIN)


def rules() -> dict[str, tuple[int, Column]]:
    """The rules over STATS columns, by name: what each votes where it holds; elsewhere it abstains."""
    per_word = lambda name: F.col(name) / F.when(F.col("n_words") > 0, F.col("n_words"))
    symbols, bangs = per_word("n_symbols"), per_word("n_bangs")
    distinct, length = per_word("n_distinct_words"), per_word("word_chars")
    letters = F.col("n_upper") + F.col("n_lower")
    upper = F.col("n_upper") / F.when(letters > 0, letters)
    dup = F.col("n_dup_lines") / F.when(F.col("n_lines") >= 4, F.col("n_lines"))
    n = F.col("n_words")
    return {
        "symbols": (BAD, symbols >= 0.25),
        "shouting": (BAD, upper >= 0.4),
        "bangs": (BAD, bangs >= 0.2),
        "lines": (BAD, dup > 0.5),
        "monotone": (BAD, (n >= 30) & (distinct < 0.15)),
        "word_length": (BAD, (length < 2) | (length > 15)),
        "prose": (GOOD, (n >= 10) & (upper <= 0.15) & (symbols <= 0.02) & (distinct >= 0.3)),
    }


#: Before any data: how often a rule votes, by what it votes, on bad and on good documents; the share of good ones.
PRIOR = {BAD: (0.3, 0.005), GOOD: (0.4, 0.8)}
PRIOR_SHARE = 0.9


def fit(patterns: np.ndarray, counts: np.ndarray, votes: list[int], strength: float = 100.0, turns: int = 1000) -> tuple[float, np.ndarray]:
    """EM for (share of good documents, table[rule, class, vote]); class 0 bad, 1 good.

    patterns: votes by row and rule; votes: what each rule votes when it does.  The prior counts
    as `strength` documents, however many there are: it says which class is which and where to
    begin, and the rates become the data's.
    """
    k = patterns.shape[1]
    prior = np.zeros((k, 2, 3))
    for i, v in enumerate(votes):
        for c in (0, 1):
            prior[i, c, v], prior[i, c, ABSTAIN] = PRIOR[v][c], 1 - PRIOR[v][c]
    total = counts.sum()
    share, table = PRIOR_SHARE, prior
    hot = np.eye(3)[patterns]
    weight = np.array([1 - PRIOR_SHARE, PRIOR_SHARE]) * strength
    with np.errstate(divide="ignore"):
        for _ in range(turns if total else 0):
            log = np.einsum("pkv,kcv->cp", hot, np.log(np.maximum(table, 1e-12))) + np.log([[1 - share], [share]])
            good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
            mass = np.stack([(1 - good) * counts, good * counts])
            new_share = (mass[1].sum() + weight[1]) / (total + weight.sum())
            table = np.einsum("cp,pkv->kcv", mass, hot) + prior * weight[None, :, None]
            table /= table.sum(axis=2, keepdims=True)
            if abs(new_share - share) < 1e-10:
                break
            share = new_share
    return float(share), table


def _base_failed(least_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _fitted(voted: DataFrame) -> Column:
    """Posterior probability of being good over v_ columns, fitted to all rows."""
    votes = rules()
    names = [f"v_{k}" for k in votes]
    seen = voted.groupBy(*names).count().collect()  # at most 2 ** len(votes) rows
    patterns = np.array([[r[k] for k in names] for r in seen], np.int64).reshape(len(seen), len(names))
    order = np.lexsort(patterns.T)
    counts = np.array([r["count"] for r in seen], float)
    share, table = fit(patterns[order], counts[order], [v for v, _ in votes.values()])
    llr = np.log(np.maximum(table[:, 1, :], 1e-12)) - np.log(np.maximum(table[:, 0, :], 1e-12))
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for k, name in enumerate(names):
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in llr[k])), F.col(name).cast("int") + 1)
    return 1 / (1 + F.exp(-odds))


def _votes() -> list[Column]:
    return [_vote(*v).cast("tinyint").alias(f"v_{k}") for k, v in rules().items()]


_SCHEMA = "doc_id long, " + ", ".join(f"{k} long" for k in STATS)


def quality(docs: DataFrame, least_words: int = 10, repeat_percent: int = 20, posterior: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept.

    Null texts count as empty: no words, base_failed, not kept.  A null doc_id, repeated rows
    and further columns change nothing; each row is judged by its own text.  An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = texts(docs).mapInArrow(lean(_stats), _SCHEMA)
    voted = scratch.save(stats.select("doc_id", *STATS[:5], _base_failed(least_words, repeat_percent).alias("base_failed"), *_votes()), "votes")
    p = _fitted(voted)
    return voted.select("doc_id", *STATS[:5], "base_failed", p.alias("p_good"), (~F.col("base_failed") & (p >= posterior)).alias("kept"))


def keep_good(docs: DataFrame, least_words: int = 10, repeat_percent: int = 20, posterior: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns; nothing is shuffled but vote counts.

    Texts are read once: what passes the base rules is written with its votes and read again
    when the fit to all votes is known.
    """
    scratch = Scratch(docs.sparkSession, "quality")

    def run(batches):
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for i, j, buf, offsets in slices(batch.column(text)):
                s = text_stats(buf, offsets)
                row = pa.StructArray.from_arrays([c.slice(i, j - i) for c in batch.columns], names=batch.schema.names)
                yield pa.RecordBatch.from_arrays([row, *(pa.array(s[k].astype(np.int64)) for k in STATS)], names=["document", *STATS])

    schema = T.StructType([T.StructField("document", docs.schema)] + [T.StructField(k, T.LongType()) for k in STATS])
    failed = _base_failed(least_words, repeat_percent)
    judged = docs.mapInArrow(lean(run), schema).select(F.when(~failed, F.col("document")).alias("document"), failed.alias("failed"), *_votes())
    judged = scratch.save(judged, "judged")
    return judged.where(~F.col("failed") & (_fitted(judged) >= posterior)).select("document.*")
