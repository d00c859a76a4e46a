"""CSV files with quoted line breaks, read by several tasks each.

Whether a byte lies inside quotes depends on all bytes before it.  A byte maps the state of a reader before it to
the state after it, and such maps compose: tasks reduce each block of a file to one map, the maps of a file's
blocks are composed in order, and then every block starts in a known state.  A block owns the records that begin
behind its first byte up to the first byte of the next block.
"""

from __future__ import annotations

import csv
import io
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmill import filesystem
from boxmill.filesystem import open_filesystem
from boxmill.session import settle

BLOCK_BYTES = 64 << 20
STEP_BYTES = 1 << 20
BATCH_ROWS = 4096
# states of a reader: before a field, in a plain field, in a quoted field, behind a quote in a quoted field
BEFORE, PLAIN, QUOTED, BEHIND = range(4)
# fixed values: endings of files that cannot be entered in the middle
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def ship() -> None:
    # workers get this module's functions by value; the package need not be installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(filesystem)


def _next_state(state: int, byte: int) -> int:
    if byte == ord('"'):
        return {BEFORE: QUOTED, PLAIN: PLAIN, QUOTED: BEHIND, BEHIND: QUOTED}[state]
    if state == QUOTED:
        return QUOTED
    return BEFORE if byte in b",\n\r" else PLAIN


def _number(states) -> int:
    """A map of the four states as one number below 256."""
    return sum(int(s) << 2 * i for i, s in enumerate(states))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(map of each byte, map that results from one map followed by another)."""
    of_byte = np.array([_number(_next_state(s, b) for s in range(4)) for b in range(256)], np.uint8)
    images = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    after = images[np.arange(256)[None, :, None], images[:, None, :]]
    return of_byte, (after << np.array([0, 2, 4, 6])).sum(axis=2).astype(np.uint8)


OF_BYTE, THEN = _tables()
UNCHANGED = _number(range(4))


def composed(data: bytes, before: int = UNCHANGED) -> int:
    """The map of all bytes together, after the map ``before``: neighbours are joined until one is left."""
    maps = OF_BYTE[np.frombuffer(data, np.uint8)]
    while len(maps) > 1:
        if len(maps) % 2:
            maps = np.append(maps, np.uint8(UNCHANGED))
        maps = THEN[maps[::2], maps[1::2]]
    return int(THEN[before, maps[0]]) if len(maps) else before


def _reduced(batches):
    opened: dict = {}
    for batch in batches:
        maps = []
        for path, low, high in zip(batch["path"], batch["low"], batch["high"]):
            disk, inside = open_filesystem(path, opened)
            whole, at = UNCHANGED, int(low)
            with disk.open_input_file(inside) as source:
                source.seek(at)
                while at < high and (data := source.read(min(STEP_BYTES, int(high) - at))):
                    whole, at = composed(data, whole), at + len(data)
            maps.append(whole)
        yield batch.assign(map=maps)


def _started(blocks: pd.DataFrame) -> pd.DataFrame:
    """State at the start of each block of one file; a row per block."""
    blocks = blocks.sort_values("low")
    state, states = BEFORE, []
    for one in blocks["map"]:
        states.append(state)
        state = int(one) >> 2 * state & 3
    return blocks.assign(state=states)[["path", "low", "high", "state"]]


def _first_record(source, low: int, high: int, state: int) -> int | None:
    """Where the first record begins that a block entered in ``state`` owns."""
    at = low
    source.seek(low)
    while at < high and (data := source.read(min(STEP_BYTES, high - at))):
        i = 0
        while i < len(data):
            if state == QUOTED:
                i = data.find(b'"', i)
                if i < 0:
                    break
            elif state == PLAIN:
                ends = [e for e in (data.find(b",", i), data.find(b"\n", i)) if e >= 0]
                if not ends:
                    break
                i = min(ends)
            if state != QUOTED and data[i] == 10:
                return at + i + 1
            state = _next_state(state, data[i])
            i += 1
        at += len(data)
    return None


class _Lines:
    """Decoded lines from a place on; ``at`` is where the next one begins."""

    def __init__(self, source, at: int):
        source.seek(at)
        self.source, self.at = io.BufferedReader(source, STEP_BYTES), at

    def __iter__(self):
        return self

    def __next__(self) -> str:
        line = self.source.readline()
        if not line:
            raise StopIteration
        first, self.at = self.at == 0, self.at + len(line)
        return line.decode("utf-8-sig" if first else "utf-8", "replace")


def _records(source, low: int, high: int, state: int, columns: list[str], checked: bool):
    csv.field_size_limit(sys.maxsize)
    start = 0 if low == 0 else _first_record(source, low, high, state)
    if start is None:
        return
    lines = _Lines(source, start)
    reader = csv.reader(lines)
    if start == 0:
        header = next(reader, columns)
        if checked and header != columns:
            raise ValueError(f"header {header} where {columns} was expected")
    while lines.at <= high:
        row = next(reader, None)
        if row is None:
            return
        if row:
            # an empty field is NULL; absent ones too
            yield [v or None for v in row[: len(columns)]] + [None] * (len(columns) - len(row))


def _parsed(columns: list[str]):
    checked = len(set(columns)) == len(columns)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=range(len(columns)), dtype=object).set_axis(columns, axis=1)

    def parse(batches):
        opened: dict = {}
        rows: list = []
        for batch in batches:
            for path, low, high, state in zip(batch["path"], batch["low"], batch["high"], batch["state"]):
                disk, inside = open_filesystem(path, opened)
                with disk.open_input_file(inside) as source:
                    for row in _records(source, int(low), int(high), int(state), columns, checked):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield frame(rows)
                            rows = []
        if rows:
            yield frame(rows)

    return parse


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """path, low, high, state of every block of the files below ``path``; the files are read once for it."""
    ship()
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long")))
    cut = files.select("path", low.alias("low"), "length")
    cut = settle(cut.select("path", "low", F.least(F.col("low") + block, "length").alias("high")))
    layout = "path string, low long, high long, map int"
    maps = cut.repartition(max(1, cut.count())).mapInPandas(_reduced, layout)
    # a row per block, however long the file
    return settle(maps.groupBy("path").applyInPandas(_started, "path string, low long, high long, state int"))


def read_cut_csv(spark: SparkSession, path: str, columns: list[str], block: int = BLOCK_BYTES) -> DataFrame:
    """Text columns of CSV files with the header ``columns``, each block of a file by a task of its own.

    Fields are split at commas, quotes are doubled inside quoted fields, a quote inside a plain field is a letter.
    Empty fields are NULL, empty lines are no rows, missing fields are NULL and surplus ones are dropped.  A file
    with another header is an error when its rows are read.
    """
    cut = blocks_of(spark, path, block)
    layout = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return cut.repartition(max(1, cut.count())).mapInPandas(_parsed(list(columns)), layout)
