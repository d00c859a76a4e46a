"""Paths that may be local (a shared mount) or any address ``pyarrow.fs`` knows."""

from __future__ import annotations

# fixed values: names under which Spark lists the same store
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}


def open_filesystem(path: str, opened: dict | None = None):
    """(filesystem, path inside it).

    ``opened`` keeps one file system per scheme and host, for callers that go through many paths.
    """
    from pyarrow import fs

    if "://" not in path:
        # also the form "file:/a b", in which Spark lists local files
        return fs.LocalFileSystem(), path.removeprefix("file:")
    scheme, _, rest = path.partition("://")
    scheme = _SAME_STORE.get(scheme, scheme)
    host = (scheme, rest.partition("/")[0])
    if opened is not None and host in opened:
        disk, depth = opened[host]
        return disk, rest if depth else "/" + rest.partition("/")[2]
    disk, inside = fs.FileSystem.from_uri(f"{scheme}://{rest}")
    if opened is not None and "%" not in rest and "?" not in rest:
        opened[host] = (disk, not inside.startswith("/"))
    return disk, inside


def read_text(path: str) -> str:
    """Text of a small settings file."""
    disk, inside = open_filesystem(path)
    with disk.open_input_stream(inside) as source:
        return source.read().decode("utf-8")
