"""Encoding of whole texts piece by piece: what a worker remembers is encoded once.

A byte-level tokenizer first splits a text by a pattern and then merges each match on its own, so the
ids of a text are those of its pieces in a row. A worker remembers pieces in two generations of bounded
size: when the young one is full it becomes the old one and the one before is forgotten; a piece found in
the old one becomes young again. Callers pass texts, an empty string for a null.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Pieces of a generation (about 50 MB); longer ones are not remembered.
PIECES, LONGEST_KEPT = 250_000, 64


class PieceEncoder:
    """``encode`` turns a list of distinct pieces into their ids, as little-endian uint32 bytes."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]]):
        self.split = regex.compile(pattern).findall
        self.encode = encode
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.young) > PIECES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        rows = [self.split(text) for text in texts]
        missing = [piece for piece in set().union(*rows) if piece not in young]
        new = [piece for piece in missing if piece not in old]
        young.update((piece, old[piece]) for piece in missing if piece in old)
        young.update(zip(new, self.encode(new)) if new else ())
        out = [b"".join(map(young.__getitem__, row)) for row in rows]
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                young.pop(piece)
        return out
