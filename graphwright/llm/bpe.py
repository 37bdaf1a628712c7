"""Byte-pair encoding, decoding and counting with published vocabularies.

Both operators split a text into pre-tokens with the vocabulary's own pattern and
merge each pre-token with a priority queue of merge ranks over a doubly linked list
of symbols; queue entries whose pair no longer exists are skipped when popped.
Merged pre-tokens are remembered in a bounded table, because words recur.

Nothing is shuffled: each text is handled where it lies, so copies, hot sources and
very long texts (O(n log n) for one unbroken pre-token) need no special care.
Null texts count as empty texts: no tokens, an empty decoded string.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphwright.llm.blocks import spans

#: Pre-tokens remembered per worker; a full table becomes the older one of two.
MAX_REMEMBERED = 150_000
#: Bits of an identifier in the key of a pair.
PAIR = 20
#: Bytes of text that are encoded and decoded at a time, or one text if that is longer.
BLOCK = 1 << 20
#: Longer pre-tokens are merged each time they occur.
MAX_WORD = 128

# Code points with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def _property(letter: str) -> str:
    """The code points of a general category's first letter, as ranges for a character class."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == letter:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.cache
def _splitter(kind: str) -> re.Pattern[str]:
    """The pre-token pattern: 'byte' keeps white space, 'word' drops it."""
    letters, numbers = _property("L"), _property("N")
    endings = "'s|'t|'re|'ve|'m|'ll|'d"
    if kind == "byte":
        return re.compile(f"{endings}| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
    return re.compile(f"{endings}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")


@functools.cache
def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Apply every merge, lowest rank and then leftmost first; return how many there were.

    symbols: identifiers, changed in place; a symbol merged into the one before it becomes -1.
    ranks: rank of a pair (left << PAIR | right); made: the identifier that a rank makes.
    """
    n, merges, get = len(symbols), 0, ranks.get
    wide = 12 if n < 1 << 12 else 40  # bits for a place in the list; short words keep to small integers
    mask = (1 << wide) - 1
    queue = [rank << wide | i for i, rank in enumerate(map(get, [a << PAIR | b for a, b in zip(symbols, symbols[1:], strict=False)])) if rank is not None]
    if not queue:
        return 0
    heapq.heapify(queue)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    symbols.append(-1)
    while queue:
        top = heapq.heappop(queue)
        i = top & mask
        j = after[i]
        if get(symbols[i] << PAIR | symbols[j]) != top >> wide:
            continue  # stale: one of the two has been merged since
        symbols[i], symbols[j] = new, _ = made[top >> wide], -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = get(new << PAIR | symbols[k])
            if rank is not None:
                heapq.heappush(queue, rank << wide | i)
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << PAIR | new)
            if rank is not None:
                heapq.heappush(queue, rank << wide | h)
    symbols.pop()
    return merges


class _Remembered(dict):
    """A table that fills itself. Once full it becomes the older one of two, and the one before that is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class Vocabulary:
    """A vocabulary file in the tokenizers library's JSON form: byte-level symbols, with or without word ends.

    Texts are cut at blanks first, and what stands between two blanks is remembered
    with its result, as are the pre-tokens in it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids: dict[str, int] = model["vocab"]
        self.ranks = {ids[a] << PAIR | ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        end = model.get("end_of_word_suffix") or ""
        self.bytes, self.last = ([ids[c + e] for c in byte_symbols()] for e in ("", end))
        self.ends = bool(end)
        self.lowers = whole.get("normalizer") is not None
        self.split = _splitter("word" if self.lowers else "byte")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: a blank that belongs neither to the word before nor to the word after it
        self.loose = re.compile(f"[{WHITE}] (?![^{WHITE}])")
        count, encode = _Remembered(self._count), _Remembered(self._encode)
        blank = "" if self.lowers else " "
        self.counts = _Remembered(lambda part: sum(map(count.__getitem__, self.split.findall(blank + part))))
        self.encoded = _Remembered(lambda part: b"".join(map(encode.__getitem__, self.split.findall(blank + part))))
        self.count_word, self.encode_word = count.__getitem__, encode.__getitem__

    def _symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        symbols = [*map(self.bytes.__getitem__, raw)]
        if self.ends:
            symbols[-1] = self.last[raw[-1]]
        return symbols

    def _count(self, word: str) -> int:
        symbols = self._symbols(word)
        return len(symbols) - merge(symbols, self.ranks, self.made)

    def _encode(self, word: str) -> bytes:
        symbols = self._symbols(word)
        merge(symbols, self.ranks, self.made)
        return _numbers([s for s in symbols if s >= 0]).tobytes()

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens before the first blank, and what follows each blank; all pre-tokens if a blank stands loose."""
        if self.lowers:
            # the capital sigma has one lower-case form here, wherever it stands
            return [], unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split(" ")
        if self.loose.search(text):
            return self.split.findall(text), []
        first, *rest = text.split(" ")
        return self.split.findall(first), rest

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings; those have the odd places."""
        return self.cut.split(text) if self.cut and "<" in text else [text]

    def count(self, text: str) -> int:
        """The number of tokens: initial symbols less merges, without making identifiers."""
        total = 0
        for k, piece in enumerate(self.pieces(text)):
            if k % 2:
                total += 1
            else:
                words, parts = self.parts(piece)
                total += sum(map(self.count_word, words)) + sum(map(self.counts.__getitem__, parts))
        return total

    def encode(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, piece in enumerate(self.pieces(text)):
            if k % 2:
                out.append(self.special[piece].to_bytes(4, "little"))
            else:
                words, parts = self.parts(piece)
                out += map(self.encode_word, words)
                out += map(self.encoded.__getitem__, parts)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings, put together with the library's blank between tokens where a vocabulary has no decoder."""
        return " ".join(map(self.strings.__getitem__, _numbers(ids)))


def _numbers(of: list[int] | bytes) -> array:
    """Little-endian unsigned 32-bit integers from or for bytes."""
    out = array("I", of)
    if sys.byteorder == "big":
        out.byteswap()
    return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker and path."""
    return Vocabulary(path)


def coded(column: pa.Array, v: Vocabulary) -> pa.Array:
    """struct<ids, decoded> of each text, made block by block: Python's lists of a whole batch would take several times its size."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
    out = [pa.array([], kind)]
    for lo, hi in spans(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BLOCK):
        ids = [v.encode(t or "") for t in column.slice(lo, hi - lo).to_pylist()]
        out.append(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(v.decode, ids), pa.string())], fields=list(kind)))
    return pa.concat_arrays(out)


def encode_decode(text: Column, path: str) -> Column:
    """struct<ids binary, decoded string> of a text column; ids are little-endian unsigned 32-bit integers.

    path: a JSON vocabulary with word ends that every executor can open. Null texts count as empty. Texts are coded whole, each row for
    itself, so repeated rows have equal values. Of pairs of one rank the first in the text is merged first, as in the library.
    """

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for column in texts:
            yield coded(column, v)

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "ids binary, decoded string")(text)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens (bigint) of a text column under a byte-level JSON vocabulary; null texts have none. Texts are counted whole, each row for itself."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for column in texts:
            yield pa.array([v.count(t or "") for t in column.to_pylist()], pa.int64())

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "bigint")(text)
