"""Paths: folders, names, scopes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def folder_of(path: Column) -> Column:
    """Everything before the last separator; '' where there is none."""
    p = normal(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normal(path), "/"), -1)


def extension(path: Column) -> Column:
    """Upper case, without the dot; '' where there is none."""
    return F.upper(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def short_folder(folder: Column) -> Column:
    """A folder of at most two segments as it is, else its last two behind '.../'."""
    parts = F.filter(F.split(normal(folder), "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 2, folder).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))


def scope_bounds(root: str | None) -> tuple[str, str] | None:
    """The half-open range of paths under a root; None for everything.

    The prefix ends in a separator, so /a/b does not take in /a/bc; the end is the prefix with its last
    character raised by one.
    """
    if root is None or not root.strip():
        return None
    bare = root.rstrip("/\\")
    sep = "\\" if "\\" in root and "/" not in root else "/"
    prefix = bare + sep
    return prefix, prefix[:-1] + chr(ord(sep) + 1)


def in_scope(path: Column, root: str | None) -> Column:
    """A range over the bare column, so it is pushed down to the scan."""
    bounds = scope_bounds(root)
    return F.lit(True) if bounds is None else (path >= bounds[0]) & (path < bounds[1])


def expand_home(path: str, home: str | None = None) -> str:
    path, home = path.strip(), home or os.path.expanduser("~")
    if path == "~":
        return home
    return os.path.join(home, path[2:]) if path[:2] in ("~/", "~\\") else path


def ancestors(folder: Column, root: str = "") -> Column:
    """A folder and the folders above it, down to and with `root`, longest first."""
    parts = F.split(folder, "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = F.filter(every, lambda p: F.length(p) > len(root)) if root else F.filter(every, lambda p: p != "")
    return F.concat(inside, F.array(F.lit(root)))


def common_prefix(folders: DataFrame, column: str = "folder") -> str:
    """The longest common beginning of all folders, by whole segments.

    It is that of the least and the greatest array of segments, so two rows reach the driver.
    """
    parts = F.split(F.col(column), "/")
    row = folders.agg(F.min(parts), F.max(parts)).first()
    if row is None or row[0] is None:
        return ""
    return "/".join(a for k, (a, b) in enumerate(zip(row[0], row[1])) if row[0][: k + 1] == row[1][: k + 1])
