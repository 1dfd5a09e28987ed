"""Path expressions with the rules of POSIX path objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(name: Column) -> Column:
    """Last dotted part of a name; a leading or trailing dot does not start one."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    """Name without its suffix."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


def extension(path: Column) -> Column:
    """Lower-case suffix of the file a path names."""
    return F.lower(suffix(file_name(path)))


def parent_folder(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, null when it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1))


def under_root(root: str, *parts: Column) -> Column:
    """Join columns below a root folder."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), *parts)


def dated_folder(date: Column) -> Column:
    """``YYYY/MM/DD`` of a date, null for null."""
    return F.date_format(date, "yyyy/MM/dd")


def placed_folder(path: Column, root: str) -> Column:
    """First three folders below the root, null when the file sits less than three folders deep."""
    parts = F.split(relative_path(path, root), "/")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 3), "/"))


def local_path(uri: Column) -> Column:
    """Plain path of a ``file:`` URI, other URIs unchanged."""
    return F.regexp_replace(uri, r"^file:/+", "/")
