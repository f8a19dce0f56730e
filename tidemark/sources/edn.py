"""EDN text as VARIANT documents.

Parsing is a small per-row helper inside Arrow batches; everything around it is
Spark. Keywords keep their colon as values and lose it as keys, symbols and lists
are kept as their printed form, sets become sorted arrays, instants ISO strings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_TOKEN = re.compile(
    r"""[\s,]*(?:;[^\n]*[\s,]*)*
        (?P<t>\#\{|\#_|\#"(?:\\.|[^"\\])*"|\#\#-?\w+|\#:[\w.*+!?$%&=<>-]+|\#[A-Za-z][\w./-]*|[\[\](){}]|"(?:\\.|[^"\\])*"|\\(?:newline|space|tab|return|formfeed|backspace|u[0-9A-Fa-f]{4}|.)
        |[^\s,\[\](){}";]+)""",
    re.X | re.S,
)
_INT = re.compile(r"[+-]?\d+N?$")
_FLOAT = re.compile(r"[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?M?$")
# Character and string escapes.
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r", "formfeed": "\f", "backspace": "\b"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "b": "\b", '"': '"', "\\": "\\"}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.S)
_CLOSE = {"[": "]", "(": ")", "{": "}", "#{": "}"}


class EdnError(ValueError):
    pass


def _character(name: str) -> str | None:
    """What ``uXXXX`` names."""
    return chr(int(name[1:], 16)) if len(name) == 5 and name[0] == "u" else None


def _in_namespace(value, namespace: str):
    """A map whose keys without a namespace get one; ``_/`` asks for none."""
    if not isinstance(value, dict):
        raise EdnError("a namespace needs a map")
    return {k[2:] if k.startswith("_/") else k if "/" in k else f"{namespace}/{k}": v for k, v in value.items()}


def _atom(t: str):
    if t[0] == '"':
        return _ESCAPE.sub(lambda m: _character(m[1]) or _ESCAPES.get(m[1], m[1]), t[1:-1])
    if t[0] == "\\":
        return _character(t[1:]) or _CHARS.get(t[1:], t[1:])
    if t in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[t]
    if _INT.match(t):
        return int(t.rstrip("N"))
    if _FLOAT.match(t):
        return float(t.rstrip("M"))
    return t


def _key(k) -> str:
    if isinstance(k, str):
        return k[1:] if k.startswith(":") else k
    return json.dumps(k)


def _read(text: str, pos: int, closing: str | None = None):
    """Value at ``pos`` and where it ends; ``closing`` itself ends a collection."""
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            raise EdnError("unexpected end")
        t, start, pos = m["t"], m.start("t"), m.end()
        if t == "#_":
            _, pos = _read(text, pos)
            continue
        if t in ("]", ")", "}"):
            if t != closing:
                raise EdnError(f"unexpected {t}")
            return _END, pos
        if t not in _CLOSE:
            if t.startswith("#:"):
                value, pos = _read(text, pos)
                return _in_namespace(value, t[2:]), pos
            # symbolic numbers and patterns have no JSON form: they stay as printed
            if t.startswith(("##", '#"')):
                return t, pos
            if t[0] == "#" and len(t) > 1:
                return _read(text, pos)
            return _atom(t), pos
        items = []
        while True:
            x, pos = _read(text, pos, _CLOSE[t])
            if x is _END:
                break
            items.append(x)
        if t == "[":
            return items, pos
        if t == "(":
            return text[start:pos], pos
        if t == "#{":
            unique = {json.dumps(x, sort_keys=True): x for x in items}
            return [unique[k] for k in sorted(unique)], pos
        if len(items) % 2:
            raise EdnError("odd number of forms in a map")
        return {_key(k): v for k, v in zip(items[::2], items[1::2])}, pos


_END = object()


def parse(text: str):
    """The first EDN value of a text."""
    return _read(text, 0)[0]


def to_json(text: str | None) -> str | None:
    """JSON of the first EDN value; null when the text is not EDN."""
    if text is None:
        return None
    try:
        return json.dumps(parse(text), ensure_ascii=False)
    except (EdnError, RecursionError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def edn_to_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(to_json)


def parse_edn(text: Column) -> Column:
    return F.try_parse_json(edn_to_json(text))


def edn_reader(files: DataFrame) -> DataFrame:
    return files.select("id", parse_edn(F.col("text")).alias("doc"))
