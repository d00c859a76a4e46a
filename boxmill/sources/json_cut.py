"""Cutting a stream of bytes into the JSON documents that it holds, one after another in any layout.

Only quotes, backslashes and brackets are looked at, a block of bytes at a time: quotes that no backslash escapes tell
what is inside a string, brackets outside strings give the depth, and a document is what lies between two places of
depth zero.  Elements of an array at the top are documents too.  Anything but white space and commas between documents comes
out as a piece of its own, so that reading it as a document fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BLANK = b" \t\r\n\xef\xbb\xbf"


class Cutter:
    def __init__(self):
        self.depth = 0
        self.inside = self.escaped = self.listed = False
        self.parts: list[bytes] = []  # of the document that is open
        self.between: list[bytes] = []  # since the last document

    def _unescaped_quotes(self, data: np.ndarray) -> np.ndarray:
        quotes = data == 34
        slashes = np.flatnonzero(data == 92)
        if self.escaped and len(data):
            quotes[0] = False
        if not len(slashes):
            self.escaped = False
            return quotes
        # in a row of backslashes each second one is escaped itself; one escaped by the block before starts no row
        if self.escaped and slashes[0] == 0:
            slashes = slashes[1:]
        if not len(slashes):
            self.escaped = False
            return quotes
        head = np.ones(len(slashes), bool)
        head[1:] = slashes[1:] != slashes[:-1] + 1
        first = np.maximum.accumulate(np.where(head, np.arange(len(slashes)), 0))
        live = slashes[(np.arange(len(slashes)) - first) % 2 == 0]
        hit = live + 1
        self.escaped = bool(hit[-1] == len(data))
        quotes[hit[hit < len(data)]] = False
        return quotes

    def feed(self, block: bytes) -> Iterator[bytes]:
        data = np.frombuffer(block, np.uint8)
        quotes = self._unescaped_quotes(data)
        inside = (np.cumsum(quotes) + self.inside) & 1 == 1
        if len(data):
            self.inside = bool(inside[-1])
        outside = ~inside & ~quotes
        step = np.zeros(len(data), np.int64)
        step[outside & ((data == 123) | (data == 91))] = 1
        step[outside & ((data == 125) | (data == 93))] = -1
        after = self.depth + np.cumsum(step)
        at = np.flatnonzero(step)
        # only brackets next to the top can begin or end a document
        at = at[(after[at] <= 1) | (after[at] - step[at] <= 1)]
        low = 0
        for place in at.tolist():
            depth, opens = int(after[place]), step[place] > 0
            top = 1 if self.listed else 0
            if opens and depth == 1 and not self.listed and block[place] == 91:
                self.between.append(block[low:place])
                low, self.listed = place + 1, True
            elif opens and depth == top + 1:
                self.between.append(block[low:place])
                yield from self._between()
                low = place
                self.parts = [b""]
            elif not opens and depth == top and self.parts:
                self.parts.append(block[low : place + 1])
                yield b"".join(self.parts)
                low, self.parts = place + 1, []
            elif not opens and depth == 0 and self.listed:
                self.between.append(block[low:place])
                yield from self._between()
                low, self.listed = place + 1, False
            elif not opens and depth < 0:
                # a bracket too many: what comes is read from the top again
                self.between.append(block[low : place + 1])
                low = place + 1
                after[place:] -= depth
        (self.parts if self.parts else self.between).append(block[low:])
        if len(data):
            self.depth = int(after[-1])

    def _between(self) -> Iterator[bytes]:
        rest = b"".join(self.between).strip(_BLANK + b",")
        self.between = []
        if rest:
            yield rest

    def end(self) -> Iterator[bytes]:
        """What is left: an unfinished document, or something that is none."""
        if self.listed and not self.parts:
            self.between.append(b"[")
        yield from self._between()
        if self.parts:
            yield b"".join(self.parts)


def documents(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The documents of a stream of blocks; memory holds a block and the document that is open."""
    cutter = Cutter()
    for block in blocks:
        yield from cutter.feed(block)
    yield from cutter.end()
