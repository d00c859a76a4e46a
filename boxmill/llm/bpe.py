"""Byte-level BPE encoding and decoding of whole columns.

The pieces of a text are looked up in a table of pieces seen before; new ones are encoded together.  They
are put into padded matrices by length, one row per piece and one number per byte.  Each round every row
merges its leftmost pair of least rank: all pairs are looked up in a hash table of number pairs, ``argmin``
finds the leftmost minimum, and the rows are compacted.  Rows without a pair left are done.

Ranks and pattern come from the caller, and are read on the driver; the vocabulary is the only broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.filesystem import open_filesystem
from boxmill.llm import bytetext
from boxmill.llm.ship import ship

LONG_PIECE = 1024  # bytes; longer pieces are merged in place, with the same result
_BLOCK = 512
_KEPT_PIECES = 300_000  # pieces remembered in a task; the table starts anew beyond
_ROWS = 20_000
_NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Numbers of all tokens, and the hash table of the pairs that make one."""

    number: dict[bytes, int]
    keys: np.ndarray
    made: np.ndarray
    byte: np.ndarray
    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        if min(ranks.values()) < 0 or max(ranks.values()) >= 1 << 24:
            raise ValueError("ranks are whole numbers below 2**24")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing[:10]}")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        bits = max(4, (2 * len(pairs)).bit_length())
        keys, made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        key, value = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = _slot(key, bits)
        while len(key):
            # of those that want a free slot the last written gets it; the rest try the next one
            free = keys[at] == -1
            keys[at[free]] = key[free]
            placed = keys[at] == key
            made[at[placed]] = value[placed]
            key, value, at = key[~placed], value[~placed], (at[~placed] + 1) & ((1 << bits) - 1)
        top = max(ranks.values()) + 1
        spelled = [b""] * top
        for token, rank in ranks.items():
            spelled[rank] = token
        size = np.fromiter(map(len, spelled), np.int64, top)
        byte = np.fromiter((ranks[bytes([b])] for b in range(256)), np.int32, 256)
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        return cls(dict(ranks), keys, made, byte, flat, np.cumsum(size) - size, size)

    def parts(self) -> tuple:
        """What ``Vocabulary`` is made of, for a broadcast."""
        return self.number, self.keys, self.made, self.byte, self.flat, self.start, self.size

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of the token each pair makes; the largest int where it makes none."""
        bits = len(self.keys).bit_length() - 1
        key = a.astype(np.int64) << 24 | b
        at = _slot(key, bits)
        held = self.keys[at]
        out = np.where(held == key, self.made[at], _NONE)
        look = np.flatnonzero((held != key) & (held != -1))
        while len(look):
            at[look] = (at[look] + 1) & (len(self.keys) - 1)
            held = self.keys[at[look]]
            hit = held == key[look]
            out[look[hit]] = self.made[at[look[hit]]]
            look = look[~hit & (held != -1)]
        return out


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    disk, inside = open_filesystem(path)
    with disk.open_input_stream(inside) as source:
        lines = source.read().split(b"\n")
    return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in lines if line.strip()}


def _merge_rows(rows: np.ndarray, size: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, their count) of pieces; ``rows`` holds numbers of bytes, padded, ``size`` their count."""
    out, left = rows.copy(), size.copy()
    live = np.flatnonzero(size > 1)
    ids = rows[live]
    width = ids.shape[1]
    ranks = np.full((len(live), width), _NONE, np.int32)
    has = np.arange(1, width)[None, :] < size[live][:, None]
    i, j = np.nonzero(has)
    ranks[i, j] = vocabulary.pairs(ids[i, j], ids[i, j + 1])
    while len(live):
        at = ranks.argmin(axis=1)
        each = np.arange(len(live))
        least = ranks[each, at]
        done = least == _NONE
        if done.any():
            out[live[done], :width] = ids[done]
            going = ~done
            live, ids, ranks, at, least = live[going], ids[going], ranks[going], at[going], least[going]
            each = np.arange(len(live))
            if not len(live):
                break
        ids[each, at] = least
        # everything right of the merged pair moves one place to the left
        moved = np.arange(1, width)[None, :] + (np.arange(1, width)[None, :] > at[:, None])
        np.minimum(moved, width - 1, out=moved)
        ids[:, 1:] = np.take_along_axis(ids, moved, 1)
        ranks[:, 1:] = np.take_along_axis(ranks, moved, 1)
        ranks[:, -1] = _NONE
        left[live] -= 1
        n = left[live]
        # only the pairs on both sides of the merged one are new
        right = at + 1 < n
        ranks[each, at] = _NONE
        ranks[each[right], at[right]] = vocabulary.pairs(ids[each[right], at[right]], ids[each[right], at[right] + 1])
        before = at > 0
        ranks[each[before], at[before] - 1] = vocabulary.pairs(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        widest = int(n.max())
        if widest < width * 3 // 4:
            out[live, :width] = ids
            width = widest
            ids, ranks = np.ascontiguousarray(ids[:, :width]), np.ascontiguousarray(ranks[:, :width])
    return out, left


def _merge_long(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The numbers of one long piece: the same merges, with the least rank of each block kept at hand."""
    n = len(ids)
    ids, blocks = ids.copy(), -(-n // _BLOCK)
    ranks = np.full(blocks * _BLOCK, _NONE, np.int32)
    ranks[: n - 1] = vocabulary.pairs(ids[:-1], ids[1:])
    best = ranks.reshape(blocks, _BLOCK).min(axis=1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = np.ones(n, bool)
    while (block := int(best.argmin())) is not None and best[block] != _NONE:
        at = block * _BLOCK + int(ranks[block * _BLOCK : (block + 1) * _BLOCK].argmin())
        gone = after[at]
        ids[at], alive[gone] = ranks[at], False
        ranks[gone] = ranks[at] = _NONE
        after[at] = nxt = after[gone]
        if nxt < n:
            before[nxt] = at
            ranks[at] = vocabulary.pairs(ids[at : at + 1], ids[nxt : nxt + 1])[0]
        prev = before[at]
        if prev >= 0:
            ranks[prev] = vocabulary.pairs(ids[prev : prev + 1], ids[at : at + 1])[0]
        for k in {block, gone // _BLOCK, max(prev, 0) // _BLOCK}:
            best[k] = ranks[k * _BLOCK : (k + 1) * _BLOCK].min()
    return ids[alive]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Numbers of every piece."""
    found: list = [None] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = vocabulary.number.get(piece)
        if whole is not None:
            found[k] = np.array([whole], np.int32)
        elif len(piece) > LONG_PIECE:
            found[k] = _merge_long(vocabulary.byte[np.frombuffer(piece, np.uint8)], vocabulary)
        else:
            width = 4 * -(-len(piece) // 4) if len(piece) <= 64 else 1 << (len(piece) - 1).bit_length()
            buckets.setdefault(width, []).append(k)
    for width, members in buckets.items():
        step = max(1, _ROWS * 16 // width)
        for low in range(0, len(members), step):
            own = members[low : low + step]
            held = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in own), np.uint8).reshape(-1, width)
            size = np.fromiter((len(pieces[k]) for k in own), np.int64, len(own))
            numbers, left = _merge_rows(vocabulary.byte[held], size, vocabulary)
            for k, row, n in zip(own, numbers, left):
                found[k] = row[:n].copy()
    return found


class _Encoder:
    """Texts to numbers, remembering the pieces seen in this task."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts, their count in each)."""
        pieces: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = self.split(text)
            count[k] = len(own)
            pieces += own
        if len(self.known) > _KEPT_PIECES:
            self._forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            made = encode_pieces([p.encode("utf-8") for p in new], self.vocabulary)
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.known.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, *made])
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        numbers, ends = _gather(self.flat, self.start[at], self.size[at])
        upto = np.concatenate(([0], np.cumsum(count)))
        return numbers, np.diff(np.concatenate(([0], ends))[upto])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``flat`` one after the other, end of each)."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)], ends


def _encoded(batches, vocabulary: Vocabulary, pattern: str, text: str, ids: str):
    encode = _Encoder(vocabulary, pattern)
    for batch in batches:
        for piece in bytetext.slices(batch, text):
            at = piece.schema.get_field_index(text)
            numbers, count = encode([t or "" for t in piece.column(at).to_pylist()])
            ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers, pa.int32()))
            rest = [(n, piece.column(k)) for k, n in enumerate(piece.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], column], [*[n for n, _ in rest], ids])


def _decoded(batches, vocabulary: Vocabulary, ids: str, out: str):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids)).fill_null([])
        numbers, ends = column.values.to_numpy(False), column.offsets.to_numpy()
        numbers, ends = numbers[ends[0] : ends[-1]], ends - ends[0]
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(vocabulary.size) or not vocabulary.size[numbers].all()):
            raise ValueError("an id is not in the vocabulary")
        data, stops = _gather(vocabulary.flat, vocabulary.start[numbers], vocabulary.size[numbers])
        cut = np.concatenate(([0], stops))[ends]
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*batch.columns, held.cast(pa.binary())], [*batch.schema.names, out])


def _digests(batches, ids: str, decoded: str):
    for batch in batches:
        column, plain = batch.column(batch.schema.get_field_index(ids)), batch.column(batch.schema.get_field_index(decoded))
        numbers, ends = column.values.to_numpy(False).astype("<u4"), column.offsets.to_numpy()
        spelled = [hashlib.sha256(numbers[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
        shown = [hashlib.sha256(x.as_buffer()).hexdigest() for x in plain]
        rest = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n not in (ids, decoded)]
        yield pa.RecordBatch.from_arrays(
            [*[c for _, c in rest], pa.array(np.diff(ends).astype(np.int64)), pa.array(spelled), pa.array(shown)],
            [*[n for n, _ in rest], "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole ``text`` (array<int>) in place of the text.

    ``ranks`` is the path of a rank file, ``pattern`` what cuts a text into pieces that are merged apart.  A
    NULL text has no ids, as an empty one.  Each row is encoded by itself.  A column already called as
    ``ids`` is replaced.
    """
    ship()
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(read_ranks(ranks)).parts())
    rest = docs.select(*[docs[c] for c in docs.columns if c not in (text, ids)], docs[text].cast("string").alias(text))
    schema = _fields(rest.drop(text)) + f"`{ids}` array<int>"
    return rest.mapInArrow(lambda batches: _encoded(batches, Vocabulary(*held.value), pattern, text, ids), schema)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` plus the bytes (binary) that its ids spell; NULL ids spell none.

    An id that the vocabulary lacks is an error.
    """
    ship()
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.of(read_ranks(ranks)).parts())
    rest = encoded.drop(out).withColumn(ids, F.col(ids).cast("array<int>"))
    return rest.mapInArrow(lambda batches: _decoded(batches, Vocabulary(*held.value), ids, out), _fields(rest) + f"`{out}` binary")


def round_trip(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Per row ``key``, the columns ``carry``, n_tokens, and the SHA-256 of its ids and of the bytes that they decode to.

    ``encode`` and ``decode`` in one pass, so that ids and texts don't leave the task.
    """
    ship()
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(read_ranks(ranks)).parts())
    bare = docs.select(F.col(key), *carry, F.col(text).cast("string").alias("_text"))

    def run(batches):
        own = Vocabulary(*held.value)
        encoded = _encoded(batches, own, pattern, "_text", "_ids")
        return _digests(_decoded(encoded, own, "_ids", "_plain"), "_ids", "_plain")

    return bare.mapInArrow(run, _fields(bare.drop("_text")) + "n_tokens long, ids_sha256 string, decoded_sha256 string")
