"""Tokenizers inside Arrow functions.

Texts are cut into units whose encodings, put together, are the text's encoding; the units of
a batch are cut in NumPy and made distinct by Arrow, and only units not seen before go to the
library, in batches of bounded bytes. Units end at white space, which is exact for tokenizers
that drop it (tried on load); for others whole texts are encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

UNIT_CACHE = 600_000  #: entries a Python worker keeps; then those go that were not met lately
KEPT_BYTES = 64  #: of the longest units that are kept: a text without white space is one unit
BATCH_BYTES = 1 << 20  #: text handed to the library at once
JOINED = 500  #: plain words encoded as one text
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"  #: a to z and the letters from U+00C0 to U+00FF
_PLAIN = re.compile(_LETTER + rb"+")
_WHITE, _MARK, _ENDING, _TRAIL = range(1, 5)
_SPACE = b" \t\n\x0b\x0c\r"
_KINDS = bytearray(256)
for _kind, _of in (
    (_WHITE, _SPACE),
    (_MARK, b".,;:!?#$%&*|)"),  # these stand apart after a letter or digit; no apostrophe, which may begin a contraction
    (_ENDING, b"0123456789abcdefghijklmnopqrstuvwxyz"),
    (_TRAIL, bytes({*range(0x80, 0xC0)} - {0x97, 0xB7})),  # after 0xC3 it ends a letter
):
    for _byte in _of:
        _KINDS[_byte] = _kind
#: A-Z can't be lowered early where a combining mark follows (lead bytes of U+0300 to U+037F)
#: or where it could make a special string.
_DELICATE = (b"\xcc", b"\xcd", b"<|")
_codecs: dict[str, "Codec"] = {}


def binaries(column: pa.LargeBinaryArray, edges: np.ndarray | None = None) -> list[bytes]:
    """The values of a column; with edges the rows from one edge to the next as one value."""
    edges = np.arange(len(column) + 1) if edges is None else edges
    if not len(column):
        return [b""] * (len(edges) - 1)
    _, offsets, body = column.buffers()
    cuts, body = np.frombuffer(offsets, np.int64)[column.offset + edges].tolist(), body.to_pybytes() if body else b""
    return [body[i:j] for i, j in zip(cuts, cuts[1:])]


class Recent(dict):
    """Units and what became of them. When half of `limit` are in, they become the older half, and what was that is dropped."""

    def __init__(self, limit: int):
        self.limit, self.older = limit, {}

    def look_up(self, units: list[bytes]) -> list:
        """What became of each; None where it is in neither half. What is in the older one comes back."""
        if len(self) > self.limit // 2:
            self.older = dict(self)
            self.clear()
        out = list(map(self.get, units))
        for i, x in enumerate(out):
            if x is None and (x := self.older.get(units[i])) is not None:
                out[i] = self[units[i]] = x
        return out

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Codec:
    """One tokenizer in one Python worker. `encode(texts)` gives lists of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splits, self.ends = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_padding()
            tok.no_truncation()
            self.encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            a, b, lower, mark, both, white = self.encode(["Ab", "Cde3", "ab cde3", "?!", " \nAb \t\n Cde3?!\r\n", " \n\t\x0b\x0c\r "])
            self.splits = both == a + b + mark and lower == a + b and not white
            suffix = getattr(tok.model, "end_of_word_suffix", None)
            if self.splits and suffix:
                self.ends = np.zeros(tok.get_vocab_size(), bool)
                self.ends[[i for word, i in tok.get_vocab().items() if word.endswith(suffix)]] = True
        self.lengths, self.bytes = Recent(UNIT_CACHE), Recent(UNIT_CACHE)

    def units(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Pieces whose encodings, put together, are the texts' encodings, and how many there are before each text and in all."""
        if not self.splits:
            return pa.array(texts, pa.large_binary()), np.arange(len(texts) + 1)
        as_is = np.array([any(x in t for x in _DELICATE) for t in texts], bool)
        whole = b" ".join([b"", *(t if d else t.translate(_LOWER) for t, d in zip(texts, as_is)), b""])
        edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
        kinds = np.frombuffer(whole.translate(_KINDS), np.uint8)
        solid, marks = kinds != _WHITE, kinds == _MARK
        first = np.flatnonzero(marks[1:] & ~marks[:-1]) + 1
        after = np.flatnonzero(marks[:-1] & ~marks[1:]) + 1
        before = kinds[first - 1]
        letter = (before == _ENDING) | ((before == _TRAIL) & (np.frombuffer(whole, np.uint8)[first - 2] == 0xC3))
        first = first[letter & ~solid[after]]
        begins = np.zeros(len(kinds), bool)
        np.greater(solid[1:], solid[:-1], out=begins[1:])
        begins[first[~as_is[np.searchsorted(edges, first, "right") - 1]]] = True
        offsets = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid))
        body = whole.translate(None, _SPACE)
        cut = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        return cut, np.searchsorted(np.flatnonzero(begins), edges)

    def fresh(self, units: Iterable[bytes]) -> Iterator[tuple[list[bytes], list]]:
        """Units with their ids, in batches. Plain words are encoded many to a text, which is
        cut again after each id that ends a word."""
        plain, other, size = [], [], 0
        for u in units:
            if self.ends is not None and _PLAIN.fullmatch(u):
                plain.append(u)
            else:
                other.append(u)
            size += len(u)
            if size >= BATCH_BYTES:
                yield from self._encoded(plain, other)
                plain, other, size = [], [], 0
        yield from self._encoded(plain, other)

    def _encoded(self, plain: list[bytes], other: list[bytes]) -> Iterator[tuple[list[bytes], list]]:
        if other:
            yield other, self.encode([u.decode() for u in other])
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for g, ids in zip(groups, self.encode([b" ".join(g).decode() for g in groups])):
            ids = np.asarray(ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(g):
                raise ValueError("a word's last id does not end it")
            yield g, np.split(ids, cut[:-1])

    def _of(self, texts: list[bytes], known: Recent, make) -> tuple[list, pa.Array, np.ndarray]:
        """What `make` gives of the ids of distinct units, the number of each unit's among them, and the units before each text."""
        units, edges = self.units(texts)
        units = units.dictionary_encode()
        distinct = binaries(units.dictionary)
        made = known.look_up(distinct)
        new = {u: i for i, u in enumerate(distinct) if made[i] is None}
        for some, ids in self.fresh(new):
            for u, x in zip(some, map(make, ids)):
                made[new[u]] = x
                if len(u) <= KEPT_BYTES:
                    known[u] = x
        return made, units.indices, edges

    def forget(self) -> None:
        """Drop the units met so far."""
        for known in (self.lengths, self.bytes):
            known.forget()

    def count(self, texts: list[bytes]) -> list[int]:
        made, indices, edges = self._of(texts, self.lengths, len)
        sums = np.append(0, np.cumsum(np.array(made, np.int64)[indices.to_numpy()]))
        return np.diff(sums[edges]).tolist()

    def id_bytes(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        made, indices, edges = self._of(texts, self.bytes, lambda ids: np.asarray(ids, "<u4").tobytes())
        return binaries(pa.array(made, pa.large_binary()).take(indices), edges)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def by_bytes(texts: list[bytes | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def safe_pieces(text: bytes, limit: int = BATCH_BYTES) -> Iterator[bytes]:
    """A long text in pieces cut before white space, where the tokenizer cuts as well."""
    start = 0
    while len(text) - start > limit:
        end = max(text.rfind(c, start + 1, start + limit) for c in (b" ", b"\n", b"\t", b"\r"))
        if end <= start:
            ends = [e for e in (text.find(c, start + limit) for c in (b" ", b"\n", b"\t", b"\r")) if e > 0]
            if not ends:
                break
            end = min(ends)
        yield text[start:end]
        start = end
    yield text[start:]
