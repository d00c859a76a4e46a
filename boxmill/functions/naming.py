"""File names, object keys and label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxmill.functions.folding import casefolded


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    """Last path component; trailing slashes and ``.`` components do not count."""
    p = _col(path)
    last = F.regexp_extract(p, r"(?:^|/)((?!\.(?:/|$))[^/]+)(?:/+\.?)*$", 1)
    # most names hold no slash and need no regular expression
    return F.when(F.instr(p, "/") > 0, last).when(p == ".", F.lit("")).otherwise(p)


def checked_name(path: Column | str) -> Column:
    """``base_name`` that fails the job on a missing or empty name."""
    p = _col(path)
    message = F.concat(F.lit("image name is empty: "), F.coalesce(p, F.lit("NULL")))
    return F.coalesce(F.nullif(base_name(p), F.lit("")), F.raise_error(message).cast("string"))


def absolute_path(path: Column | str) -> Column:
    """The path itself; the job fails when it is given but not absolute."""
    p = _col(path)
    message = F.concat(F.lit("image path is not absolute: "), p)
    return F.when(p.isNull() | F.startswith(p, F.lit("/")), p).otherwise(
        F.raise_error(message).cast("string")
    )


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"(?<=.)\.[^.]+$", "")


def suffix(name: Column | str) -> Column:
    return F.regexp_extract(_col(name), r"(?<=.)(\.[^.]+)$", 1)


def object_key(prefix: Column | str, name: Column | str) -> Column:
    """Storage key of a frame.  ``prefix`` is a column or a plain string value.

    The prefix test is a plain string test: prefix ``img`` also covers ``img1.jpg``.
    """
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    n = _col(name)
    return (
        F.when(F.coalesce(p, F.lit("")) == "", n)
        .when(F.startswith(n, p), n)
        .otherwise(F.concat(p, F.lit("/"), n))
    )


def clone_key(prefix: Column | str, folder: Column | str, name: Column | str) -> Column:
    """Storage key of a copied frame: prefix, folder and name, the prefix always put in front if there is one.

    Strings given for prefix and folder are values, not columns.
    """
    parts = [F.lit(c) if isinstance(c, str) else c for c in (prefix, folder)]
    return F.concat_ws("/", F.nullif(parts[0], F.lit("")), parts[1], _col(name))


def relative_key(prefix: Column | str, key: Column | str) -> Column:
    """Key without the prefix and without leading slashes (unless no prefix)."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    k = _col(key)
    cut = F.regexp_replace(F.substring(k, F.length(p) + F.lit(1), F.length(k)), "^/+", "")
    return F.when(F.coalesce(p, F.lit("")) == "", k).otherwise(cut)


def storage_option(options: Column | str, name: str) -> Column:
    """First non-empty value of ``name`` in a query-string; '' when absent."""
    raw = F.regexp_extract(_col(options), rf"(?:^|&){name}=([^&]+)", 1)
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def month_name(name: Column | str, month: Column | str) -> Column:
    """``YYYY-MM/name``; the month is an argument so that a rerun repeats it."""
    m = F.lit(month) if isinstance(month, str) else month
    return F.concat(m, F.lit("/"), _col(name))


def labels_folder(images_folder: Column | str) -> Column:
    """Folder of the label files: every ``images`` in the path becomes ``labels``."""
    return F.replace(_col(images_folder), F.lit("images"), F.lit("labels"))


def label_file_path(relative: Column | str) -> Column:
    """``images/<split>/x.jpg`` or ``<split>/x.jpg`` -> ``labels/<split>/x.txt``."""
    rel = _col(relative)
    parts = F.split(rel, "/")
    nested = (F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == "images")
    split = F.when(nested, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.concat(F.lit("labels/"), split, F.lit("/"), stem(base_name(rel)), F.lit(".txt"))


def is_hex_colour(text: Column | str) -> Column:
    return F.rlike(_col(text), F.lit("^#[0-9a-fA-F]{6}$"))


def hex_colour(text: Column | str) -> Column:
    """Lower-cased colour; NULL when it is not ``#rrggbb``."""
    t = _col(text)
    return F.when(is_hex_colour(t), F.lower(t))


def folded(name: Column | str) -> Column:
    """Key for case-insensitive equality, by full case folding: ``Straße`` and ``STRASSE`` are equal."""
    return casefolded(_col(name))


def same_name(a: Column | str, b: Column | str) -> Column:
    return folded(a) == folded(b)


def slug(name: Column | str) -> Column:
    """Task name as part of a file name; ``task`` when nothing is left."""
    kept = F.regexp_replace(_col(name), r"(?U)[^\p{L}\p{N}_\s-]", "")
    dashed = F.regexp_replace(kept, r"(?U)[-\s]+", "-")
    text = F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))
    return F.when(text == "", F.lit("task")).otherwise(text)


def frame_file_name(camera: Column | str, seq: Column | str, ts: Column | str) -> Column:
    """``cam3_000042_20240101T000007_179575.jpg``; the arrival time is written in the
    session's time zone, which ``build_session`` sets to UTC."""
    number = _col(seq).cast("string")
    # lpad would cut numbers beyond six digits
    padded = F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0"))
    return F.concat(
        F.lit("cam"), _col(camera).cast("string"), F.lit("_"), padded, F.lit("_"),
        F.date_format(_col(ts), "yyyyMMdd'T'HHmmss_SSSSSS"), F.lit(".jpg"),
    )
