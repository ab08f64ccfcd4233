"""Token ids by the tokenizers library, with each chunk of text encoded once.

Both supported pre-tokenizers never let a token run across a space that follows a character
other than white space, nor across a single line end between two such characters, so a text cut
there gives the same ids piece by piece.  Pieces repeat far more than texts do: Arrow cuts the
texts, finds each piece among those known, and puts the ids together; known pieces and their
ids, as little-endian bytes, are Arrow arrays, and the library is asked only for new ones.  A word of plain
Latin letters is one pre-token that no normaliser changes but in case, and punctuation after it
is another, so for these the library's BPE model is asked for the word alone.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = re.compile(r"(?<=\S) ")
#: A space behind white space of any kind that re knows, for Arrow's matcher, which takes a fraction of the time.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_LINES = re.compile(r"\S+(?:\n\S+)+")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_TAIL = ".,;:!?#$%&*"
_PROBES = ["a", "The", "house", "Übermäßig", "ñandúÿÀ", "Qzxvkw", "éàç"]
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
_made: dict[str, Encoder] = {}


def _byte_table() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}


_BYTES = _byte_table()
_SPACE = " ".translate(_BYTES)


def _bytes(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of whole texts, put together from pieces; the known ones take about `most` bytes."""

    def __init__(self, path: str, most: int = 32 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.most = most
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())  # pieces behind a space
        self.tails: dict[str, bytes] = {"": b""}
        self.line_end = self._whole("\n")
        #: Whether words go to the model in lower case or behind the symbol of the space before them; none if neither gives the library's ids.
        self.lower = next((x for x in (False, True) if self._agrees(x)), None)

    def _agrees(self, lower: bool) -> bool:
        self.lower = lower
        return all(self._word(w, lead) == self._whole(lead + w) for w in _PROBES for lead in (" ", ""))

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, lead: str) -> bytes:
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return _bytes([t.id for t in self.tokenize(word if self.lower or not lead else _SPACE + word)])

    def plain(self, word: str) -> bool:
        """Whether the model may be asked for the word alone."""
        return self.lower is not None and word.isalpha() and (word.isascii() or _WORD.fullmatch(word) is not None)

    def tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[tail] = self._whole(tail)
        return self.tails[tail]

    def piece(self, piece: str, lead: str) -> bytes:
        """Ids of one piece behind lead, a space or nothing; words, punctuation after them and lines are asked for on their own."""
        word = piece.rstrip(_TAIL)
        if self.plain(word):
            return self._word(word, lead) + self.tail(piece[len(word) :]) if len(word) < len(piece) else self._word(word, lead)
        if "\n" in piece and _LINES.fullmatch(piece):
            head, *lines = piece.split("\n")
            return self.line_end.join([self.piece(head, lead), *(self.piece(x, "") for x in lines)])
        return self._whole(lead + piece)

    def _find(self, words: pa.Array) -> np.ndarray:
        """The places of pieces among the known ones; new ones become known."""
        if self.known.nbytes + self.ids.nbytes > self.most:  # what these texts do not use goes
            used = pc.drop_null(pc.index_in(words, value_set=self.known).unique())
            self.known, self.ids = self.known.take(used), self.ids.take(used)
        at = pc.index_in(words, value_set=self.known)
        miss = pc.is_null(at)
        new = words.filter(miss)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if len(new):
            coded = new.dictionary_encode()
            place[miss.to_numpy(zero_copy_only=False)] = len(self.known) + coded.indices.to_numpy()
            piece = self.piece
            ids = pa.array([piece(x, " ") for x in coded.dictionary.to_pylist()], pa.large_binary())
            self.known, self.ids = pa.concat_arrays([self.known, coded.dictionary]), pa.concat_arrays([self.ids, ids])
        return place

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null texts have none."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(col):
            return []
        col = pc.fill_null(col, "")
        unsafe = pc.match_substring_regex(col, _UNSAFE)
        cut = pc.split_pattern(pc.if_else(unsafe, "", col), " ")
        at, words = cut.offsets.to_numpy(), cut.values
        careful = {k: _CUT.split(col[k].as_py()) for k in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist()}
        more = pa.array([x for parts in careful.values() for x in parts[1:]], pa.large_string())
        place = self._find(pa.concat_arrays([words, more]))
        place, rest = place[: len(words)], place[len(words) :]
        # A text's first piece has no space before it: it takes a place of its own behind the known ones.
        place[at[:-1]] = len(self.known) + np.arange(len(col))
        first = pa.array([self.piece(x, "") if x else b"" for x in words.take(pa.array(at[:-1])).to_pylist()], pa.large_binary())
        out = _joined(pa.concat_arrays([self.ids, first]), place, at)
        if careful:
            ends = np.cumsum([0, *(len(parts) - 1 for parts in careful.values())])
            for (k, parts), ids in zip(careful.items(), _joined(self.ids, rest, ends)):
                out[k] = self.piece(parts[0], "") + ids
        return out


def _joined(ids: pa.Array, place: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The bytes at the places given, one behind the other, from each cut to the next."""
    found = ids.take(pa.array(place))
    ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1][cuts].tolist()
    data = memoryview(found.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def forget() -> None:
    """Gives back what this worker keeps of encoders."""
    _made.clear()


def groups(column: pa.Array, limit: int = 4 << 20):
    """(first row, rows) of an Arrow string column, about limit bytes at a time."""
    col = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    at = 0
    while at < len(col):
        to = min(len(col), max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1))
        yield at, col.slice(at, to - at)
        at = to
