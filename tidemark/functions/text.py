"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tidemark.functions.paths import normalise
from tidemark.functions.urls import decode_uri
from tidemark.model import NAMESPACE


def strip(s: Column) -> Column:
    """Without white space at either end, newlines included."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def ellipsis(s: Column, max_len: int = 60) -> Column:
    return F.when(
        F.length(s) > max_len, F.concat(F.substring(s, 1, max_len - 3), F.lit("..."))
    ).otherwise(s)


def filename_str(s: Column) -> Column:
    """File-name friendly text: no control characters, banned ones become spaces."""
    return strip(F.regexp_replace(F.regexp_replace(s, r"\p{C}", ""), r'[\\/:*?"<>|]', " "))


def filename_inst(ts: Column) -> Column:
    """ISO instant with dots for colons; fraction digits only when there are any."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH.mm.ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"(?:\.000000|(?<=\.\d{3})000)$", ""), F.lit("Z"))


def unix_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


# The patterns of the next three functions are the grammar of tags and links.
def hashtags(md: Column) -> Column:
    """Lower-cased ``#tags`` that hold at least one letter."""
    found = F.regexp_extract_all(md, F.lit(r"(?<=#)([\p{IsAlphabetic}\d\-_/]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda t: t.rlike(r"\p{IsAlphabetic}")), F.lower)


def wikilinks(md: Column) -> Column:
    """Targets of ``[[links]]`` without anchor and alias."""
    found = F.regexp_extract_all(md, F.lit(r"(?<=\[\[)([^\[\]]+)(?=\]\])"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_extract(t, "^([^#|]*)", 1))


def mdlinks(md: Column, folder: Column) -> Column:
    """Targets of ``[text](url)`` seen from ``folder``, both relative to the mount."""
    found = F.regexp_extract_all(md, F.lit(r"\[[^\[]+\]\(([^)]+)\)"), F.lit(1))
    base = F.when(folder == "", folder).otherwise(F.concat(folder, F.lit("/")))
    return F.transform(found, lambda u: normalise(F.concat(base, decode_uri(u))))


def unwrap_codeblock(s: Column, lang: str) -> Column:
    """Content of a fenced block that is all there is in ``s``, else null."""
    return F.regexp_substr(
        strip(s), F.lit(f"(?s)(?<=\\A```{re.escape(lang)}\\n).*(?=\\n```\\z)")
    )


def wrap_codeblock(s: Column, lang: str) -> Column:
    return F.concat(F.lit(f"```{lang}\n"), strip(s), F.lit("\n```\n\n"))


def out_name(id_: Column, kind: str = "query", ext: str = "edn", namespace: str = NAMESPACE) -> Column:
    """``foo.query.<ns>.edn`` → ``foo.query-out.<ns>.edn``; null for other ids."""
    tail = f".{namespace}.{ext}"
    regex = f".*/([^/]*){re.escape(kind + tail)}$"
    return F.when(
        id_.rlike("^" + regex), F.concat(F.regexp_extract(id_, regex, 1), F.lit(f"{kind}-out{tail}"))
    )


def front_matter(md: Column) -> Column:
    """YAML text between the leading ``---`` fences, empty when there is none."""
    return F.regexp_extract(md, r"(?s)\A---\n(.*?)\n---\n", 1)


def html_text(html: Column) -> Column:
    """Readable text of HTML: scripts, styles, comments and tags removed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                       ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(out, "[ \t]+", " "))
