"""A table of distinct chunks with their token ids, kept by each task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: At most so many chunks stay in a task's table between batches, and none longer than LONG characters.
KEEP, LONG = 150_000, 48


class ChunkTable:
    """Segments each distinct chunk once; texts get their ids by joining their chunks' entries back by position.

    ``encode`` takes a list of distinct chunks and returns one entry for each. The table is emptied when it holds
    more than ``keep`` chunks, so its memory is bounded; entries are recomputed then, and results do not change.
    """

    def __init__(self, encode: Callable[[list[str]], list[Any]], keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self.table: dict[str, Any] = {}

    def entries(self, chunked: list[list[str]]) -> list[list[Any]]:
        table = self.table
        if len(table) > self.keep:
            table.clear()
        new = list(set().union(*chunked).difference(table))
        found = self.encode(new) if new else []
        table.update(zip(new, found, strict=True))
        out = [[table[c] for c in chunks] for chunks in chunked]
        for c in new:
            if len(c) > LONG:
                del table[c]
        return out
