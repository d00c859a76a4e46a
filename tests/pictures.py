"""Smallest files that carry an image size."""

import struct
import zlib


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(w, h):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9
    sof = b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9
    return b"\xff\xd8" + app + sof + b"\xff\xd9"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\0" * 3


def bmp(w, h):
    return b"BM" + b"\0" * 16 + struct.pack("<ii", w, -h) + b"\0" * 8


def webp(w, h):
    body = b"VP8X" + struct.pack("<I", 10) + b"\0" * 4 + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def tiff(w, h):
    entries = struct.pack("<HHII", 256, 4, 1, w) + struct.pack("<HHIHH", 257, 3, 1, h, 0)
    return b"II*\0" + struct.pack("<I", 300) + b"\0" * 292 + struct.pack("<H", 2) + entries + b"\0" * 4
