"""Column functions over inventories: path parts, flags and labels. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions that count as media.
MEDIA_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "heic", "tiff", "bmp", "mp4", "mov", "avi", "mkv", "wmv", "flv", "webm")


def path_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def path_parent(path: Column) -> Column:
    """The path without its last component; the parent of an entry of the root is '/'."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.when((parent == "") & F.startswith(path, F.lit("/")), "/").otherwise(parent)


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat_ws("/", parent, name))


def extension(name: Column) -> Column:
    """Lower-case extension; '' where there is none ('.jpg', 'a.', 'a')."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def kind_label(is_dir: Column) -> Column:
    return F.when(is_dir, "Folder").otherwise("File")


def _two_decimals(value: Column, unit: str) -> Column:
    # bround first: exact ties go to the even digit, as in C; format_string alone would round them up
    return F.format_string(f"%.2f {unit}", F.bround(value, 2))


def file_size_label(size: Column) -> Column:
    """KB below 1024 KB, else MB; the unit is chosen before rounding."""
    kb = size / F.lit(1024.0)
    return F.when(kb < 1024, _two_decimals(kb, "KB")).otherwise(_two_decimals(kb / 1024, "MB"))


def total_size_label(size: Column) -> Column:
    """KB, MB, GB or TB, each from one of its kind on; below that KB."""
    kb = size / F.lit(1024.0)
    mb, gb, tb = kb / 1024, kb / 1024**2, kb / 1024**3
    return F.when(tb >= 1, _two_decimals(tb, "TB")).when(gb >= 1, _two_decimals(gb, "GB")).when(mb >= 1, _two_decimals(mb, "MB")).otherwise(_two_decimals(kb, "KB"))


def content_digest(content: Column) -> Column:
    """SHA-256 as lower-case hex; null for null."""
    return F.sha2(content.cast("binary"), 256)
