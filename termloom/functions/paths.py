"""Path predicates and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the extensions indexed unless others are asked for.
DEFAULT_EXTENSIONS = "txt,md"


def parse_extensions(option: str) -> list[str]:
    """Comma-separated option to a list; blanks around items are dropped."""
    return [item.strip() for item in option.split(",")]


def file_name(path: Column) -> Column:
    """Last component, ignoring slashes at the end."""
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; null when there is none.

    A name whose only dot is its first character has no extension, and
    neither has ``..``; a name ending in a dot has an empty one.
    """
    name = file_name(path)
    has_one = name.rlike(r"(?s)^.+\.[^.]*$") & (name != "..")
    return F.when(has_one, F.regexp_extract(name, r"\.([^.]*)$", 1))


def is_target(path: Column, extensions: list[str]) -> Column:
    """True when the extension is one of ``extensions``, case included."""
    return F.coalesce(extension(path).isin(extensions), F.lit(False))


def normalize(path: Column) -> Column:
    """Drop ``.`` components, repeated slashes and a trailing slash."""
    bare = F.regexp_replace(path, r"^file:(//)?(?=/)", "")
    no_dots = F.regexp_replace(bare, r"(?<=^|/)\.(/+|$)", "")
    single = F.regexp_replace(no_dots, r"/{2,}", "/")
    return F.regexp_replace(single, r"(?<=[^/])/$", "")


def under(path: Column, prefix: Column, component: bool = False) -> Column:
    """Path starts with ``prefix``, as text or as whole components."""
    if not component:
        return path.startswith(prefix)
    folder = F.concat(F.regexp_replace(prefix, r"/+$", ""), F.lit("/"))
    return (path == prefix) | path.startswith(folder)
