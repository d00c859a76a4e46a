"""Image dimensions from file headers.

Tasks list the files; a small Python helper follows each one's offsets by seeking until the size is found, so it
holds some kilobytes and no pixel is decoded.  A file whose header is not understood gets NULL size.
"""

from __future__ import annotations

import io
import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill import filesystem
from boxmill import schema as S
from boxmill.filesystem import open_filesystem
from boxmill.sources.listing import image_files, list_files

STEP_BYTES = 1 << 13  # read at a time
# fixed values: extensions of files that are measured
MEASURED = (*S.IMAGE_EXTENSIONS, ".gif")


def ship() -> None:
    # workers get this module's functions by value; the package need not be installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(filesystem)


class _Pieces:
    """Bytes of a seekable file by place; one piece is held at a time."""

    def __init__(self, source, step: int = STEP_BYTES):
        self.source, self.step, self.low, self.held = source, step, 0, b""

    def take(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the end of the file."""
        if not self.low <= at <= at + n <= self.low + len(self.held):
            self.source.seek(at)
            self.held, self.low = self.source.read(max(n, self.step)), at
        return self.held[at - self.low : at - self.low + n]


def stream_size(source, step: int = STEP_BYTES) -> tuple[int, int] | None:
    """(width, height) of an open PNG, JPEG, GIF, BMP, WebP or TIFF; what lies between is skipped, not read."""
    pieces = _Pieces(source, step)
    data = pieces.take(0, 30)
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return abs(w), abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
            return _webp(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(pieces)
        if data[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff(pieces, "<" if data[:2] == b"II" else ">")
    except struct.error:  # cut inside a field
        pass
    return None


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the bytes of a picture."""
    return stream_size(io.BytesIO(data))


def _jpeg(pieces: _Pieces) -> tuple[int, int] | None:
    at = 2
    while len(head := pieces.take(at, 9)) == 9:
        if head[0] != 0xFF:
            return None
        marker = head[1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[5:9])
            return w, h
        elif 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return (
            int.from_bytes(data[24:27], "little") + 1,
            int.from_bytes(data[27:30], "little") + 1,
        )
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _tiff(pieces: _Pieces, end: str) -> tuple[int, int] | None:
    at = struct.unpack(end + "I", pieces.take(4, 4))[0]
    found = {}
    for i in range(struct.unpack(end + "H", pieces.take(at, 2))[0]):
        entry = pieces.take(at + 2 + 12 * i, 12)
        tag, kind = struct.unpack(end + "HH", entry[:4])
        if tag in (256, 257):
            short = kind == 3
            found[tag] = struct.unpack(end + ("H" if short else "I"), entry[8 : 10 if short else 12])[0]
            if len(found) == 2:
                return found[256], found[257]
    return None


def _measured(batches):
    opened: dict = {}
    for batch in batches:
        found = []
        for path in batch["path"]:
            try:
                disk, inside = open_filesystem(path, opened)
                with disk.open_input_file(inside) as source:
                    found.append(stream_size(source) or (None, None))
            except OSError:
                found.append((None, None))
        yield pd.DataFrame(
            {
                "path": batch["path"],
                "name": batch["name"],
                "image_width": pd.array([w for w, _ in found], dtype="Int32"),
                "image_height": pd.array([h for _, h in found], dtype="Int32"),
            }
        )


def read_image_sizes(spark: SparkSession, root: str, mode: str = "each") -> DataFrame:
    """``path, name, image_width, image_height`` of the image files below a folder, extensions in any case.

    ``each`` opens every picture.  ``first`` opens one, the first by path, and gives its size to all of them.
    A picture that cannot be read has NULL sizes: see ``readable`` and ``unreadable``.  Only paths are
    listed; tasks read of pictures what they must.
    """
    ship()
    listing = image_files(list_files(spark, root), MEASURED).select("path", "name")
    layout = "path string, name string, image_width int, image_height int"
    if mode == "each":
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return listing.repartition(parts, "path").mapInPandas(_measured, layout)
    if mode != "first":
        raise ValueError("mode is 'each' or 'first'")
    top = listing.orderBy("path").limit(1)
    one = top.mapInPandas(_measured, layout).collect()
    if not one:
        return spark.createDataFrame([], layout)
    return listing.select(
        "path", "name",
        F.lit(one[0]["image_width"]).cast("int").alias("image_width"),
        F.lit(one[0]["image_height"]).cast("int").alias("image_height"),
    )


def readable(sizes: DataFrame) -> DataFrame:
    return sizes.where("image_width is not null and image_height is not null")


def unreadable(sizes: DataFrame) -> DataFrame:
    """The report: pictures whose size was not found, which take no part in a conversion."""
    return sizes.where("image_width is null or image_height is null").select("path", "name")
