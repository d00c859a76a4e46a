"""Column expressions (no Python runs per row)."""

from boxmill.functions.coercion import (
    attributes_json,
    attributes_map,
    creator_name,
    or_empty,
    parse_time,
    updated_date,
)
from boxmill.functions.geometry import (
    corners,
    exact_round,
    fixed,
    label_line,
    to_normalised,
    to_pixels,
)
from boxmill.functions.naming import (
    absolute_path,
    base_name,
    checked_name,
    folded,
    frame_file_name,
    hex_colour,
    is_hex_colour,
    labels_folder,
    label_file_path,
    month_name,
    clone_key,
    object_key,
    relative_key,
    same_name,
    slug,
    stem,
    storage_option,
    suffix,
)

__all__ = [name for name in dir() if not name.startswith("_")]
