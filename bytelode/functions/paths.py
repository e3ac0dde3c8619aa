"""Rules on file and member names, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of compressed files, by length; a name must be longer than its suffix.
SUFFIXES = {4: (".zip", ".ZIP", ".tgz"), 3: (".gz", "-gz", ".zz", "-zz"), 2: (".z", "-z", "_z", ".Z")}
ALL_SUFFIXES = tuple(s for n in SUFFIXES for s in SUFFIXES[n])


def suffix_length(name: Column) -> Column:
    """Characters of a compressed file's suffix, the longest kind first; 0 without one."""
    out = F.lit(0)
    for n in sorted(SUFFIXES):
        out = F.when((F.length(name) > n) & F.right(name, F.lit(n)).isin(*SUFFIXES[n]), n).otherwise(out)
    return out


def strip_suffix(name: Column) -> Column:
    """The name of the decoded file; .tgz becomes .tar."""
    n = suffix_length(name)
    bare = F.left(name, F.length(name) - n)
    return F.when(F.right(name, F.lit(4)) == ".tgz", F.when(n == 4, F.concat(bare, F.lit(".tar"))).otherwise(name)).otherwise(bare)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalize_member(name: Column) -> Column:
    """Slashes forward, none in front."""
    return F.ltrim(F.translate(name, "\\", "/"), F.lit("/"))


def is_directory(name: Column) -> Column:
    return name.endswith("/")


def is_unsafe(name: Column) -> Column:
    """Whether a member's name would leave the folder it is extracted to."""
    return F.exists(F.split(normalize_member(name), "/"), lambda part: part == "..")


def safe_path(name: Column) -> Column:
    """The relative path of a member, without empty parts and dots; an error where it is unsafe."""
    parts = F.filter(F.split(normalize_member(name), "/"), lambda part: ~part.isin("", "."))
    return F.when(is_unsafe(name), F.raise_error(F.concat(F.lit("unsafe path: "), name))).otherwise(F.array_join(parts, "/"))


def skip_reason(kind: Column, name: Column, mode: str = "compress", recurse: bool = False, force: bool = False, to_stdout: bool = False) -> Column:
    """Why a file is left alone (null: it isn't). kind: file, link, directory, special or missing."""
    has = suffix_length(name) > 0
    out = F.when(kind == "missing", "does not exist").when(kind == "special", "is a special file")
    if not (force or to_stdout):
        out = out.when(kind == "link", "is a symbolic link")
    if not recurse:
        out = out.when(kind == "directory", "is a directory")
    if mode == "compress":
        return out if force else out.when((kind != "directory") & has, "already has a compressed suffix")
    return out if to_stdout else out.when((kind != "directory") & ~has, "has no compressed suffix")
