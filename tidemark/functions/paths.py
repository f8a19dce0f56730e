"""Document ids, mounts, ignore lists and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tidemark.model import SIDECAR_EXTENSION

# Path segments ignored unless a configuration says otherwise.
DEFAULT_IGNORE = [
    ".DS_Store", ".git", ".gitignore", ".obsidian", ".vscode", "node_modules", "target", ".cpcache",
]

_SIDECAR_RE = re.escape("." + SIDECAR_EXTENSION) + "$"


def is_sidecar(path: Column) -> Column:
    return path.endswith("." + SIDECAR_EXTENSION)


def content_path(path: Column) -> Column:
    """Path of the content file a sidecar belongs to; other paths are unchanged."""
    return F.regexp_replace(path, _SIDECAR_RE, "")


def sidecar_path(path: Column) -> Column:
    return F.when(is_sidecar(path), path).otherwise(F.concat(path, F.lit("." + SIDECAR_EXTENSION)))


def doc_id(mount: Column, relative: Column) -> Column:
    return F.concat(F.lit("/"), mount, F.lit("/"), content_path(F.regexp_replace(relative, "^/", "")))


def mount_of(id_: Column) -> Column:
    """Mount name of an id; null unless the id has a mount and a path."""
    return F.nullif(F.regexp_extract(id_, "^/([^/]+)/", 1), F.lit(""))


def relative_of(id_: Column) -> Column:
    return F.when(id_.rlike("^/[^/]+/"), F.regexp_extract(id_, "(?s)^/[^/]+/(.*)$", 1))


def parent_of(id_: Column) -> Column:
    return F.regexp_replace(id_, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Text after the last dot of the last segment, null when there is none."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit(""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column, ext: str) -> Column:
    """Base name without the extension ``ext``."""
    return F.regexp_replace(file_name(path), re.escape("." + ext) + "$", "")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def ancestors(id_: Column) -> Column:
    """Every folder above ``id_``, the root ``""`` first, as an array."""
    parts = F.split(id_, "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.array_distinct(above)


def _fold_dots(parts: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return (
            F.when((s == "") | (s == "."), acc)
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s)))
        )

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(_fold_dots(F.split(path, "/")), "/"))


def sibling(path: Column, other: Column) -> Column:
    """``other`` seen from the folder of ``path``; an absolute ``other`` is kept."""
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit(""))
    return F.when(other.startswith("/"), other).otherwise(normalise(F.concat(folder, other)))


def ignore_list(ignore: list[str] | None = None, extra: list[str] | None = None) -> list[str]:
    return list(DEFAULT_IGNORE if ignore is None else ignore) + list(extra or [])


def is_ignored(path: Column, names: list[str] | None = None) -> Column:
    """True when any segment of ``path`` equals one of ``names``."""
    names = ignore_list() if names is None else names
    if not names:
        return F.lit(False)
    return path.rlike("(?:^|/)(?:" + "|".join(re.escape(n) for n in names) + ")(?:/|$)")


# Private-use characters standing for the parts of a glob while it is rewritten.
_MARKS = {name: chr(0xE000 + i) for i, name in enumerate(
    ["any_deep", "any", "one", "alt", "not_class"])}
_ESCAPABLE = {ch: chr(0xE010 + i) for i, ch in enumerate("*?[]{},\\")}


def glob_regex(glob: Column) -> Column:
    """Anchored regular expression for a path glob held in a column.

    ``*`` stays inside a segment and ``**`` crosses segments; ``?``, ``[a-z]``,
    ``[!a]``, ``{a,b}`` and backslash escapes work as in path matchers.
    """
    out = glob
    for ch, mark in _ESCAPABLE.items():
        out = F.replace(out, F.lit("\\" + ch), F.lit(mark))
    out = F.replace(out, F.lit("\\"), F.lit(""))
    outside = r"(?![^\[\]]*\])"  # not within a character class
    out = F.regexp_replace(out, r"\*\*" + outside, _MARKS["any_deep"])
    out = F.regexp_replace(out, r"\*" + outside, _MARKS["any"])
    out = F.regexp_replace(out, r"\?" + outside, _MARKS["one"])
    out = F.regexp_replace(out, r",(?=[^{}]*\})", _MARKS["alt"])
    out = F.regexp_replace(out, r"([.^$+()|])" + outside, r"\\$1")
    out = F.replace(out, F.lit("[!"), F.lit(_MARKS["not_class"]))
    for mark, regex in (
        ("[", "(?!/)["), (_MARKS["not_class"], "(?!/)[^"), ("{", "(?:"), ("}", ")"),
        (_MARKS["alt"], "|"), (_MARKS["any_deep"], ".*"), (_MARKS["any"], "[^/]*"),
        (_MARKS["one"], "[^/]"),
    ):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    for ch, mark in _ESCAPABLE.items():
        out = F.replace(out, F.lit(mark), F.lit(ch if ch == "," else "\\" + ch))
    return F.concat(F.lit("(?s)^(?:"), out, F.lit(")$"))


def glob_folder(glob: Column) -> Column:
    """Longest folder a glob fixes literally: what comes before its first wildcard."""
    return F.regexp_replace(
        F.regexp_extract(glob, r"^((?:[^*?\[{\\/]*/)*)", 1), "/$", "")


def glob_parts(glob: Column) -> Column:
    """``struct<kind, prefix, suffix, regex>`` of a glob.

    Most globs are literal text around at most one wildcard. Those are decided by
    comparing ends (kind ``exact``, ``star`` or ``deep``); only the others (kind
    ``regex``) need their regular expression.
    """
    plain = r"[^*?\[\]{}\\]*"
    head, tail = F.regexp_extract(glob, f"(?s)^({plain})", 1), F.regexp_extract(glob, f"(?s)({plain})$", 1)
    kind = (
        F.when(glob.rlike(f"(?s)^{plain}$"), "exact")
        .when(glob.rlike(rf"(?s)^{plain}\*{plain}$"), "star")
        .when(glob.rlike(rf"(?s)^{plain}\*\*{plain}$"), "deep")
        .otherwise("regex")
    )
    return F.struct(kind.alias("kind"), head.alias("prefix"), tail.alias("suffix"), glob_regex(glob).alias("regex"))


def matches_parts(id_: Column, parts: Column) -> Column:
    """Whether an id matches a glob taken apart by ``glob_parts``."""
    prefix, suffix = parts["prefix"], parts["suffix"]
    ends = (
        id_.startswith(prefix) & id_.endswith(suffix)
        & (F.length(id_) >= F.length(prefix) + F.length(suffix))
    )
    middle = id_.substr(F.length(prefix) + 1, F.length(id_) - F.length(prefix) - F.length(suffix))
    return (
        F.when(parts["kind"] == "exact", id_ == prefix)
        .when(~id_.startswith(prefix), False)
        .when(parts["kind"] == "regex", F.call_function("rlike", id_, parts["regex"]))
        .when(parts["kind"] == "deep", ends)
        .otherwise(ends & ~F.contains(middle, F.lit("/")))
    )


def matches_glob(id_: Column, glob: Column | str) -> Column:
    glob = F.lit(glob) if isinstance(glob, str) else glob
    return F.call_function("rlike", id_, glob_regex(glob))
