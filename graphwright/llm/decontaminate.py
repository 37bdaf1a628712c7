"""Finding benchmark items in documents, within an edit distance, by the pigeonhole principle.

An item with an error budget of e is split into e + 1 pieces: where the item stands in a text with at most e
edits, a piece stands there unchanged. All pieces of a block of items make one automaton, which finds their exact hits in
a text; a hit says where the item would stand, give or take e, and such windows, merged where they
overlap, are verified with Myers' bit-parallel distance (1999), on one long integer for an item of any length.

Items are dealt in blocks of bounded size, which are sent to all tasks; each block is one pass over the texts, which are
not shuffled. Items and texts are compared in lower case with white space made equal.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits allowed for a character of an item.
RATE = 0.08
#: Characters of items in a block.
BLOCK = 4 << 20
#: Characters of all items together, at most; a larger set is an error, since each block is a pass over the texts.
MOST = 1 << 28


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distance(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first of the nearest places of the item in the text, if within `most` edits.

    Myers' algorithm for a pattern anywhere in a text: the vertical differences of a column are
    two bit vectors, and a column takes a few operations on them.
    """
    m = len(item)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best = (m, 0) if m <= most else None
    for end, c in enumerate(text, 1):
        same = where.get(c, 0)
        x = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | (ones & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & ones
        minus, plus = up & x, ((down << 1) & ones) | (ones & ~(up | x))
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Items:
    """A block of items, ready to be found."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(number, text, int(len(text) * rate)) for number, text in items if text]
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, most) in enumerate(self.items):
            n = most + 1
            for i in range(n):
                a, b = len(text) * i // n, len(text) * (i + 1) // n
                places[text[a:b]].append((k, b))
        for piece, where in places.items():
            self.pieces.add_word(piece, where)
        self.pieces.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item that stands in a normalised text."""
        if not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, where in self.pieces.iter(text):
            for k, end in where:
                start = last + 1 - end
                most = self.items[k][2]
                windows[k].append((max(start - most, 0), start + len(self.items[k][1]) + most))
        out = []
        for k, spans in windows.items():
            number, item, most = self.items[k]
            best: tuple[int, int] | None = None
            spans.sort()
            low, high = spans[0]
            for a, b in [*spans[1:], (1 << 62, 1 << 62)]:
                if a <= high:
                    high = max(high, b)
                    continue
                got = distance(item, text[low:high], most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
                low, high = a, b
            if best:
                out.append((number, *best))
        return out


def dealt(items: DataFrame, block: int) -> list[list[tuple[int, str]]]:
    """Blocks of distinct (item, normalised text), each of at most `block` characters or one item. Items are the query set: more than MOST characters of them are an error."""
    parts: list[list[tuple[int, str]]] = [[]]
    known, total, size = set(), 0, 0
    for r in items.where("item is not null and text is not null").distinct().toLocalIterator():
        total += len(r.text)
        if total > MOST:
            raise ValueError(f"the items have over {MOST} characters")
        known.add((r.item, normalised(r.text)))
    for item in sorted(known):
        if size and size + len(item[1]) > block:
            parts.append([])
            size = 0
        parts[-1].append(item)
        size += len(item[1])
    return parts


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(id, item, distance, ends_at): each item that stands in a row's text with at most floor(rate * length) edits, at its nearest place.

    ends_at counts characters of the normalised text. The items are a stated query set: they are read to the driver and sent
    out in blocks of at most `block` characters, one pass each. Items with a null id, and null or blank items, match nothing;
    an item's repeated rows count once, and several texts under one id are as many items. Null texts match nothing.
    Repeated rows of `docs` give repeated rows. Texts are read whole, however long; of equally near places the first counts. Other
    columns of both tables are ignored, whatever their names; an empty table on either side gives no rows.
    """
    parts = dealt(items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")), block)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    id_kind, item_kind = texts.schema["id"].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_column].dataType)
    out = None
    for part in parts:

        def batches(rows: Iterator[pa.RecordBatch], part: list[tuple[int, str]] = part) -> Iterator[pa.RecordBatch]:
            ready = Items(part, rate)
            for batch in rows:
                found = [(i, *f) for i, t in enumerate(batch.column("text").to_pylist()) for f in ready.found(normalised(t))]
                columns = [*zip(*found, strict=True)] or [[], [], [], []]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(columns[0], pa.int64())), "item": pa.array(columns[1], item_type), "distance": pa.array(columns[2], pa.int32()), "ends_at": pa.array(columns[3], pa.int32())})

        found = texts.mapInArrow(batches, f"id {id_kind}, item {item_kind}, distance int, ends_at int")
        out = found if out is None else out.union(found)
    return out


def without_matches(docs: DataFrame, items: DataFrame, text_column: str = "text", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, with all columns, in whose text no item stands; rows with a null text stay. Options as for `matches`."""
    parts = dealt(items.select(F.lit(0).alias("item"), F.col(item_text).alias("text")), block)
    out = docs
    for part in parts:
        out = out.where(_clean(part, rate)(F.col(f"`{text_column}`")))
    return out


def _clean(part: list[tuple[int, str]], rate: float):
    """A function of a text column: whether no item of a block stands in it."""

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = Items(part, rate)
        for column in texts:
            yield pa.array([t is None or not ready.found(normalised(t)) for t in column.to_pylist()], pa.bool_())

    clean.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(clean, "boolean")
