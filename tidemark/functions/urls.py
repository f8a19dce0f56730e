"""URL encoding and parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encode_url(s: Column) -> Column:
    return F.url_encode(s)


def decode_url(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), s)


def encode_uri(s: Column) -> Column:
    return F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def decode_uri(s: Column) -> Column:
    return decode_url(s)


def add_params(url: Column, params: Column) -> Column:
    """``url?k=v&k=v`` from ``array<struct<key, values: array<string>>>``; each value repeats its key."""
    pairs = F.flatten(F.transform(
        params,
        lambda p: F.transform(
            p["values"], lambda v: F.concat(encode_uri(p["key"]), F.lit("="), encode_uri(v))),
    ))
    return F.concat(url, F.lit("?"), F.array_join(pairs, "&"))


def query_params(url: Column) -> Column:
    """``array<struct<key, values>>`` of a URL's query string, in order."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.transform(
        F.filter(F.split(query, "&"), lambda kv: kv != ""),
        lambda kv: F.struct(
            decode_url(F.substring_index(kv, "=", 1)).alias("key"),
            F.array(decode_url(F.regexp_replace(kv, "^[^=]*=?", ""))).alias("values")),
    )
