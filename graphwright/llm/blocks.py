"""Batches of texts in blocks of bounded size, so that arrays over their characters stay small."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def blocks(texts: Sequence[str | bytes | None], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many characters or bytes together, or of one text if that is longer."""
    yield from spans([len(t or "") for t in texts], size)


def spans(sizes: Sequence[int], size: int) -> Iterator[tuple[int, int]]:
    """The same for texts of known sizes."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if len(sizes):
        yield first, len(sizes)
