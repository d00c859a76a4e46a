"""Periodic runs of words by seed and extend along diagonals.

A run of period q is a stretch of at least max(6, 4 q) words in which words q apart are the same, that no
neighbouring word extends, and that has no smaller period.  Its words match those q further on in a row of at least
max(6, 4 q) - q places: 5 for q = 1, otherwise at least 3 q.  So the places of the text are indexed by their grams of
that minimum overlap, in levels: grams of 5 words for lag 1, of 6 for lags 2 and 3, of 12 for lags 4 to 7, and so on,
each twice as long as those before and longer than all lags of its level.  Grams get exact names (a pair of names of
the level before), and only places whose gram comes again in the same text go on to the next level, so natural text
leaves the index after a level or two.

Two following occurrences of a gram whose lag belongs to the level are a seed on the diagonal of that lag.  A run gives such
a seed at its first word: an occurrence in between would be within the run and shorten its period.  For the same
reason a stretch of four lags around a seed has no period below its lag.  Seeds go by lag and place; a table of the
furthest place covered on each lag passes over seeds inside a stretch that was extended already.

All texts of a slice are handled together; a text longer than a slice is one by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxmill.llm import bytetext
from boxmill.llm.ship import ship

SHORTEST, EXPONENT = 6, 4
FIRST = SHORTEST - 1  # words that a run of lag 1 has in common with itself, one word on


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _again(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places with an equal name elsewhere, earlier and later place of following equal names)."""
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    several = np.zeros(len(name), bool)
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    return several, order[:-1][same], order[1:][same]


def _first_places(ids: np.ndarray, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places whose first ``FIRST`` words come again in their row; hashes may let a few others through."""
    at = np.flatnonzero(np.arange(len(ids)) + FIRST <= ends[row])
    code = bytetext.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    total = np.zeros(len(at), np.uint64)
    for k, step in enumerate(bytetext._numbers(FIRST, 5) | np.uint64(1)):
        total += code[at + k] * step
    return at[_again(bytetext.mix(total))[0]]


def seeds(ids: np.ndarray, row: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of all seeds, by lag and place, each row of equal lags at following places once.

    ``ids`` numbers the words of all rows one after another, ``ends`` has the end of each row.
    """
    lags, places = [], []
    at = _first_places(ids, row, ends)
    if len(at):
        many = np.int64(ids.max()) + 1
        name = _named(row[at])
        for k in range(FIRST):
            name = _named(name * many + ids[at + k])
    width, low, high = FIRST, 1, 2
    while len(at):
        several, one, two = _again(name)
        lag = at[two] - at[one]
        fit = (lag >= low) & (lag < high)
        lags.append(lag[fit])
        places.append(at[one][fit])
        at, name = at[several], name[several]
        if width == FIRST:
            longer = at + width < ends[row[at]]
            at = at[longer]
            name = _named(name[longer] * many + ids[at + width])
            width += 1
        else:
            held = np.full(len(ids) + 1, -1)
            held[at] = name
            longer = (at + 2 * width <= ends[row[at]]) & (held[np.minimum(at + width, len(ids))] >= 0)
            at = at[longer]
            name = _named(held[at] * (held.max() + 1) + held[at + width])
            width *= 2
        low, high = width // 3, 2 * width // 3
    if not lags:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lag, place = np.concatenate(lags), np.concatenate(places)
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    head = np.ones(len(lag), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return lag[head], place[head]


def _extent(ids: np.ndarray, place: int, lag: int, stop: int, step: int) -> int:
    """First place from ``place`` on, by ``step`` of 1 or -1, whose word differs from that ``lag`` further on."""
    reach = 16
    while place != stop:
        far = min(place + reach, stop) if step > 0 else max(place - reach, stop)
        span = slice(place, far) if step > 0 else slice(far + 1, place + 1)
        differs = np.flatnonzero(ids[span] != ids[span.start + lag : span.stop + lag])
        if len(differs):
            return span.start + int(differs[0 if step > 0 else -1])
        place, reach = far, 2 * reach
    return stop


def runs(ids: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start in the row, length, period) of all runs, by row, start and period."""
    found, covered = [], {}
    for lag, place in zip(*(x.tolist() for x in seeds(ids, row, ends))):
        if place < covered.get(lag, 0):
            continue
        k = int(row[place])
        first = _extent(ids, place, lag, int(starts[k]) - 1, -1) + 1
        last = _extent(ids, place, lag, int(ends[k]) - lag, 1)
        covered[lag] = last
        length = last - first + lag
        if length >= max(SHORTEST, EXPONENT * lag):
            found.append((k, first - int(starts[k]), length, lag))
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def _collapsed(words: list[bytes], own: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in own:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept) if k] if own else words)


def _rows(batches, text: str, carry: list[str], key: str | None, rewrite):
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for piece in bytetext.slices(batch, text):
            column = piece.column(piece.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            words = [(x or b"").split() for x in column]  # at 0x20 and 0x09 to 0x0D
            if rewrite is not None:
                keys = piece.column(piece.schema.get_field_index(key)).to_pylist()
                words = [rewrite(k, w) for k, w in zip(keys, words)]
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size)
            flat = pa.array([w for own in words for w in own], pa.binary())
            ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            by_row = [[] for _ in words]
            for k, *run in runs(ids, np.repeat(np.arange(len(words)), size), ends - size, ends):
                by_row[k].append(tuple(run))
            kept = [piece.column(piece.schema.get_field_index(c)) for c in carry]
            listed = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in by_row]
            made = [pa.array(size), pa.array(listed, pa.list_(spans)), pa.array(map(_collapsed, words, by_row), pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*carry, "n_words", "runs", "collapsed"])


def find_runs(
    docs: DataFrame,
    text: str = "text",
    carry: Sequence[str] | None = None,
    key: str | None = None,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The columns ``carry`` (default: all but the text), n_words, runs and collapsed, for every row.

    ``runs`` is an array of (start, length, period) in words, by start and period; ``collapsed`` is the text without
    the repetitions, words joined by one space, as UTF-8 bytes.  Words are ``[^\\x20\\x09-\\x0D]+`` of the whole
    text; a NULL or empty text has none, no runs and an empty ``collapsed``.  Rows are independent of each other,
    repeated ones included.  ``rewrite`` gets ``key`` and the words of a row and returns those to look at.  Columns
    of ``docs`` that are called as a column made here are replaced.
    """
    ship()
    made = ("n_words", "runs", "collapsed")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in (*made, text if carry is None else None)]
    names = dict.fromkeys([*kept, *([key] if rewrite is not None else [])])
    clear = "_text"
    while clear in docs.columns:
        clear += "_"
    bare = docs.select(*[docs[c] for c in names], docs[text].cast("string").alias(clear))
    kinds = {f.name: f.dataType.simpleString() for f in bare.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept)
    schema += "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    return bare.mapInArrow(lambda batches: _rows(batches, clear, kept, key, rewrite), schema)
