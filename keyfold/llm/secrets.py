"""Secret scans: fixed patterns, and formats learned from labelled credentials.

Labelled credentials are of two sources: the strings that the fixed patterns find in the
corpus, by kind, and strings made by rule for publicly documented token formats.  Of each kind
a prefix tree is grown and its statistically compatible states are merged (Hoeffding bound on
the frequencies of ending and of each next symbol) into a probabilistic automaton.  The same is
done for the runs of credential characters that the patterns leave, nearly all of them
harmless.  Every run, or what fixed patterns leave of it, is scored by how much likelier the
likeliest kind's automaton makes it than the automaton of harmless runs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch, texts
from ._text import lean

# The base patterns and least lengths, the kinds in order.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

# Token formats that their issuers document, then formats of what is no secret, as parts of literal text or (characters, least and most of them).
_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_URL = _WORD + "_-"
FORMATS = {
    "github": ("ghp_", (_WORD, 36, 36)),
    "github_app": ("gho_", (_WORD, 36, 36)),
    "github_fine": ("github_pat_", (_WORD, 22, 22), "_", (_WORD, 59, 59)),
    "gitlab": ("glpat-", (_URL, 20, 20)),
    "slack_bot": ("xoxb-", ("0123456789", 10, 13), "-", ("0123456789", 10, 13), "-", (_WORD, 24, 24)),
    "stripe": ("sk_live_", (_WORD, 24, 34)),
    "generic_sk": ("sk-", (_WORD, 40, 64)),
    "google": ("AIza", (_URL, 35, 35)),
    "npm": ("npm_", (_WORD, 36, 36)),
    "pypi": ("pypi-", (_URL, 60, 90)),
    "sendgrid": ("SG.", (_URL, 22, 22), ".", (_URL, 43, 43)),
    "jwt": ("eyJ", (_URL, 20, 40), ".eyJ", (_URL, 40, 90), ".", (_URL, 43, 43)),
    "base64_key": ((_WORD + "+/", 43, 43), "="),
    "aws_secret": ((_WORD + "+/", 40, 40),),
}

_N = "0123456789"
_X = "0123456789abcdef"
HARMLESS_FORMATS = {
    **{f"line of {c}": ((c, 12, 100),) for c in "+/_.=-"},
    "phone": (("+0123456789", 1, 1), (_N, 10, 14)),
    "phone_groups": ((_N, 2, 4), "-", (_N, 3, 4), "-", (_N, 4, 7)),
    "date_time": ("20", (_N, 2, 2), "-", (_N, 2, 2), "-", (_N, 2, 2), "T", (_N, 2, 6)),
    "uuid": ((_X, 8, 8), "-", (_X, 4, 4), "-", (_X, 4, 4), "-", (_X, 4, 4), "-", (_X, 12, 12)),
}

LEAST_RUN = min(LEAST.values())
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)


def made(name: str, n: int = 200) -> list[str]:
    """n strings of a format, the same each time."""
    g = np.random.default_rng([11, *name.encode()])
    part = lambda x: x if isinstance(x, str) else "".join(g.choice(list(x[0]), int(g.integers(x[1], x[2] + 1))))
    return ["".join(map(part, (FORMATS | HARMLESS_FORMATS)[name])) for _ in range(n)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, ordered."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int]] = (), least: int = LEAST_RUN) -> list[tuple[int, int]]:
    """Maximal runs of credential characters, less what base spans cover; parts under the least length are left out."""
    if not base:
        return [m.span() for m in _RUN.finditer(text)]
    out, ends = [], [(a, b) for a, _, b in base]
    k = 0
    for m in _RUN.finditer(text):
        at, stop = m.span()
        while k < len(ends) and ends[k][1] <= at:
            k += 1
        for a, b in ends[k:]:  # ordered by start
            if a >= stop:
                break
            if a - at >= least:
                out.append((at, a))
            at = max(at, b)
        if stop - at >= least:
            out.append((at, stop))
    return out


#: Classes of characters; signs stand for themselves.
CLASSES = {"0": "0123456789", "a": "abcdef", "z": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ"}
SPREAD = {c: len(of) for c, of in CLASSES.items()}
_SYMBOLS = str.maketrans({x: c for c, of in CLASSES.items() for x in of})


def symbols(word: str) -> str:
    """The classes of a word's characters."""
    return word.translate(_SYMBOLS)


class Automaton:
    """A probabilistic automaton over symbol(); states hold arrivals, endings and counted arcs."""

    def __init__(self):
        self.seen, self.ends, self.arcs = [0], [0], [{}]

    def add(self, word: str, times: int = 1) -> None:
        q = 0
        self.seen[0] += times
        for c in symbols(word):
            if c not in self.arcs[q]:
                self.arcs[q][c] = [len(self.seen), 0]
                self.seen.append(0)
                self.ends.append(0)
                self.arcs.append({})
            arc = self.arcs[q][c]
            arc[1] += times
            q = arc[0]
            self.seen[q] += times
        self.ends[q] += times

    def _differ(self, a: int, na: int, b: int, nb: int, alpha: float) -> bool:
        return bool(na and nb) and abs(a / na - b / nb) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, p: int, q: int, alpha: float, depth: int) -> bool:
        todo = [(p, q, 0)]
        while todo:
            p, q, d = todo.pop()
            if p == q:
                continue
            if self._differ(self.ends[p], self.seen[p], self.ends[q], self.seen[q], alpha):
                return False
            for c in self.arcs[p].keys() | self.arcs[q].keys():
                x, y = self.arcs[p].get(c, (None, 0)), self.arcs[q].get(c, (None, 0))
                if self._differ(x[1], self.seen[p], y[1], self.seen[q], alpha):
                    return False
                if x[0] is not None and y[0] is not None and d < depth:
                    todo.append((x[0], y[0], d + 1))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Merges the tree below q into p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for c, (to, n) in self.arcs[q].items():
                if c in self.arcs[p]:
                    self.arcs[p][c][1] += n
                    todo.append((self.arcs[p][c][0], to))
                else:
                    self.arcs[p][c] = [to, n]

    def merge(self, alpha: float = 0.05, depth: int = 3) -> Automaton:
        """Merges each state, in breadth-first order, into the first compatible one before it; one that has none stays."""
        red, blue = [0], deque((0, c) for c in sorted(self.arcs[0]))
        known = {0}
        while blue:
            p, c = blue.popleft()
            q = self.arcs[p][c][0]
            if q in known:
                continue
            into = next((r for r in red if self._compatible(r, q, alpha, depth)), None)
            if into is None:
                red.append(q)
                known.add(q)
                blue.extend((q, x) for x in sorted(self.arcs[q]))
            else:
                before = {r: set(self.arcs[r]) for r in red}
                self.arcs[p][c][0] = into
                self._fold(into, q)
                for r in red:
                    blue.extend((r, x) for x in sorted(set(self.arcs[r]) - before[r]))
        return self

    def _trim(self) -> None:
        """Leaves out the states that no arc leads to any more."""
        order = [0]
        place = {0: 0}
        for q in order:
            for to, _ in self.arcs[q].values():
                if to not in place:
                    place[to] = len(order)
                    order.append(to)
        self.seen, self.ends = [self.seen[q] for q in order], [self.ends[q] for q in order]
        self.arcs = [{c: [place[to], n] for c, (to, n) in self.arcs[q].items()} for q in order]

    def table(self) -> Automaton:
        """Fills the costs that score() reads: of each arc and of ending, in nats, add-half smoothed."""
        self._trim()
        alphabet = 5 + sum(not c.isalnum() for c in CHARACTERS)
        rest = [-math.log(0.5 / (n + 0.5 * (alphabet + 1))) for n in self.seen]
        spread = {c: math.log(SPREAD.get(c, 1)) for c in symbols(CHARACTERS)}
        self.costs = [{c: (arcs[c][0] if c in arcs else 0, rest[q] - math.log(2 * (arcs[c][1] if c in arcs else 0) + 1) + more) for c, more in spread.items()} for q, arcs in enumerate(self.arcs)]
        self.end = [r - math.log(2 * n + 1) for r, n in zip(rest, self.ends)]
        return self

    def score(self, word: str) -> float:
        """Log-likelihood of a whole word, its ending included; a symbol that a state has not seen leads back to the first state."""
        return self._score(symbols(word))

    def _score(self, classes: str) -> float:
        q, total = 0, 0.0
        for c in classes:
            q, cost = self.costs[q][c]
            total -= cost
        return total - self.end[q]


def learn(strings: Iterable[str]) -> Automaton:
    a = Automaton()
    for s in sorted(strings):
        a.add(s)
    return a.merge().table()


class Formats:
    """The automata of all kinds against those of harmless runs; verdicts are kept by classes of characters, as runs repeat."""

    def __init__(self, kinds: list[Automaton], harmless: list[Automaton], margin: float, keep: int = 200_000):
        self.kinds, self.harmless, self.margin, self.keep = kinds, harmless, margin, keep
        self.seen: dict[str, bool] = {}

    def secret(self, word: str) -> bool:
        """Whether some kind makes the word likelier than a harmless run by the margin, in nats."""
        classes = symbols(word)
        out = self.seen.get(classes)
        if out is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            least = max(h._score(classes) for h in self.harmless) + self.margin
            out = self.seen[classes] = any(k._score(classes) > least for k in self.kinds)
        return out

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        return [(a, 3, b) for a, b in candidates(text, base) if self.secret(text[a:b])]


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


HARMLESS = 3


def _harmless(runs: list[str], secret: list[Automaton], margin: float, turns: int = 3) -> Automaton | None:
    """The automaton of runs, without those that still look like secrets beside it: undetected ones must not teach it."""
    least = {s: max(k.score(s) for k in secret) - margin for s in runs}
    kept = runs
    for _ in range(turns):
        if not kept:
            return None
        a = learn(kept)
        left = [s for s in runs if least[s] <= a.score(s)]
        if len(left) == len(kept):
            break
        kept = left
    return a


def _labelled(batches):
    """Credentials by kind, and the runs that the patterns leave; distinct within a batch."""
    for batch in batches:
        found: set[tuple[int, str]] = set()
        for t in batch.column(1).to_pylist():
            if not t:
                continue
            base = base_spans(t)
            for a, k, b in base:
                s = t[a:b]
                found.add((k, ASSIGN.match(s).group(2) if k == 0 else s))
            found.update((HARMLESS, t[a:b]) for a, b in candidates(t, base))
        kind, value = [list(x) for x in zip(*found)] if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(value, pa.string())], names=["kind", "value"])


def train(docs: DataFrame, bound: int = 2000, margin: float = 24.0) -> Formats:
    """Automata of the kinds found, of the documented formats and of harmless runs.

    Each kind learns from about `bound` distinct strings at most, harmless runs from ten times
    as many, chosen by hash.  Learning, not scoring, reads strings up to 200 characters.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    labelled = texts(docs).mapInArrow(lean(_labelled), "kind int, value string").select("kind", F.substring("value", 1, 200).alias("value")).distinct()
    found = scratch.save(labelled, "labelled")
    place = F.pmod(F.xxhash64("value"), F.lit(1 << 31))
    n = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # four rows
    share = {k: min(1.0, bound * (10 if k == HARMLESS else 1) / v) for k, v in n.items()}
    kinds: list[list[str]] = [[], [], [], []]
    if n:
        of = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 31)))))
        for r in found.where(place < of[F.col("kind")]).limit(20 * bound).collect():
            kinds[r["kind"]].append(r["value"])
    scratch.drop("labelled")
    secret = [learn(s) for s in [*kinds[:HARMLESS], *map(made, FORMATS)] if s]
    left = _harmless(kinds[HARMLESS], secret, margin / 2)
    return Formats(secret, [*([left] if left else []), *(learn(made(f)) for f in HARMLESS_FORMATS)], margin)


def scan(docs: DataFrame, bound: int = 2000, margin: float = 24.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs.

    spans lists kind:start:end by start and kind, in code points, end exclusive; spans of the
    kind format are those that the automata add.  Null and empty texts have no spans.  A null
    doc_id, repeated rows and other columns change nothing; an empty table gives an empty result.
    """
    formats = train(docs, bound, margin)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                for c, v in zip(cols, (*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + formats.spans(t, base)))):
                    c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, bound: int = 2000, margin: float = 24.0, mark: str = "<SECRET>") -> DataFrame:
    """docs with each secret (overlapping spans as one) replaced by mark; null texts stay null.

    All columns are kept; n_chars, where there is one, follows the text.
    """
    formats = train(docs, bound, margin)

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = sorted(base + formats.spans(text, base))
        if not spans:
            return text
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            new = pa.array([None if t is None else clean(t) for t in batch.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
