"""File identity: the full path is the key, the base name a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_path() -> Column:
    """The path of the file a row was read from, as it is written, not URI-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def names_file(wanted: Column, path: Column) -> Column:
    """Is ``wanted`` this file: by its whole path, the end of it, or its base name."""
    return (wanted == path) | F.endswith(path, F.concat(F.lit("/"), F.regexp_replace(wanted, "^/+", "")))
