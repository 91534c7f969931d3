"""Packages, lookups, comparisons and typed JSON."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import values
from papyra.operators import compare
from papyra.sources import lookup, packages

JSON = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", "a", "b"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c d"]), x, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(JSON, JSON)
def test_differences_are_symmetric(a, b):
    there, back = list(compare.differences_of(a, b)), list(compare.differences_of(b, a))
    mirror = {"missing": "extra", "extra": "missing"}
    flip = sorted((p, mirror.get(k, k), y, x) for p, k, x, y in back if k != "duplicate")
    same = lambda rows: sorted(rows, key=str)
    assert same(r for r in there if r[1] != "duplicate") == same(flip)
    assert (not there) == (compare._text(a) == compare._text(b) or a == b and compare._kind(a) == compare._kind(b))
    assert list(compare.differences_of(a, a)) == []


def test_differences(spark):
    rows = [(1, '{"n": 1, "l": ["x", "y"], "o": {"k": null}}', '{"n": 1.0, "l": ["x", "x"], "o": {"k": 0}}'), (2, None, "[]"), (3, None, None), (4, "{", "{}"), (5, '{"a": null, "b": [1]}', '{"a": 3, "c": 4, "b": [1]}'), (6, "[" * 3000 + "]" * 3000, "[]")]
    pairs = spark.createDataFrame(rows, "id int, expected string, actual string")
    found = compare.differences(pairs, "id", "expected", "actual")
    got = {(r.id, r.path, r.kind, r.expected, r.actual) for r in found.where("id < 5").collect()}
    assert got == {(1, "$.l", "duplicate", None, '"x"'), (1, "$.l[1]", "value", '"y"', '"x"'), (1, "$.o.k", "type", "null", "0"), (2, "$", "extra", None, "[]"), (4, "$", "unreadable", "{", "{}")}
    assert {r.path for r in found.where("id = 5").collect()} == {"$.a", "$.c"} and found.where("id = 6").count() == 1
    assert compare.differences(pairs.where("id = 5"), "id", "expected", "actual", lenient=True).count() == 0
    outcome = {r.id: (r.failures, r.passed) for r in compare.passed(pairs, found, "id").collect()}
    assert outcome[3] == (0, True) and outcome[1] == (3, False)


def zips(folder):
    return {n: hashlib.sha256(open(os.path.join(folder, n), "rb").read()).hexdigest() for n in sorted(os.listdir(folder))}


def entries(spark, n=6):
    bodies = spark.createDataFrame([(f"p{k}", f"See <!-- papyra-asset:Fig A -->\n<!-- papyra-asset:gone -->\nend {k}") for k in range(n)], "package string, body string")
    assets = spark.createDataFrame([(f"p{k}", a, j, s, bytes([k, j]) * 1000) for k in range(n) for j, (a, s) in enumerate([("Fig A", ".png"), ("fig-a", ".png"), ("Fig A", ".png"), ("Ünï", None)])] + [("none", "x", 1, ".png", b"x")], "package string, asset string, place long, suffix string, content binary")
    return packages.package_entries(bodies, assets, "papyra")


def test_packages_have_the_same_bytes_however_rows_lie(spark, tmp_path):
    rows = entries(spark)
    found = []
    for k, many in enumerate((1, 3, 7)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(many))
        packages.write_packages(rows.repartition(many), f"file://{tmp_path}/out{k}")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append(zips(tmp_path / f"out{k}"))
    assert found[0] == found[1] == found[2] and list(found[0]) == [f"p{k}.zip" for k in range(6)]
    with zipfile.ZipFile(tmp_path / "out0" / "p1.zip") as z:
        assert z.namelist() == ["p1.md", "p1.assets/fig-a-2.png", "p1.assets/fig-a-3.png", "p1.assets/fig-a.png", "p1.assets/n"]
        assert z.read("p1.md").decode() == "See ![Fig A](p1.assets/fig-a.png)\n![Fig A](p1.assets/fig-a-3.png)\nend 1"
        assert z.read("p1.assets/fig-a-3.png") == bytes([1, 2]) * 1000 and z.testzip() is None


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = entries(spark).select("package", "place", "path", "content")
    packages.write_packages(rows, path)
    before = zips(tmp_path / "out")
    for name, entry in (("../x", "a"), ("", "a"), ("p9", "../a"), ("p0", "p0.md")):
        bad = rows.unionByName(spark.createDataFrame([(name, 5, entry, b"z")], rows.schema))
        with pytest.raises(Exception, match="refused"):
            packages.write_packages(bad, path)
        assert zips(tmp_path / "out") == before
    packages.write_packages(rows.where("package = 'p1' AND place = 0"), path)
    after = zips(tmp_path / "out")
    assert after["p1.zip"] != before["p1.zip"] and {k: v for k, v in after.items() if k != "p1.zip"} == {k: v for k, v in before.items() if k != "p1.zip"}
    packages.write_packages(rows.where("false"), path)
    assert zips(tmp_path / "out") == after


def test_attempts_of_a_task_leave_one_package(tmp_path):
    """A task that ran twice, or broke off, shows only what the commit names."""
    writer = packages._Writer(f"file://{tmp_path}/out")
    rows = [{"package": "a", "path": "x", "content": b"1"}, {"package": "a", "path": "y", "content": None}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))

    def broken():
        yield rows[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert lost.found[0][1] != kept.found[0][1]
    writer.commit([kept, None])
    assert os.listdir(tmp_path / "out") == ["a.zip"]


def test_lookup(spark):
    names = ["fig", "fig.", "a.b/c", "x.png", "x%2.png", "a+b.png", "..", "data:image/png,x", "//host/x.png", "/r/one/x.png", "/r/x.png", None, "?q", "sub/./x.png", "x.png"]
    refs = spark.createDataFrame([(1, n, "clash") for n in names] + [(2, "fig", "clash")], "id int, reference string, papyra_name string").drop("papyra_name")
    there = ["/r/two/fig.jpg", "/r/two/fig.png", "/r/one/fig.gif", "/r/one/a.b/c.eps", "/r/two/x.png", "/r/one/x.png", "/r/one/x%2.png", "/r/two/a+b.png", "/r/one/sub/x.png", "/r/one/fig."]
    listing = spark.createDataFrame([(1, p) for p in there] + [(1, there[0])], "id int, path string")
    got = lookup.resolved(refs, listing, "id", "reference", ["/r/one", "/r/two/"]).collect()
    assert len(got) == len(names) + 1
    by = {r.reference: (r.path, r.status) for r in got if r.id == 1}
    assert by["fig"] == ("/r/one/fig.gif", "found") and by["a.b/c"] == ("/r/one/a.b/c.eps", "found") and by["x.png"] == ("/r/one/x.png", "found")
    assert by["x%2.png"] == ("/r/one/x%2.png", "found") and by["a+b.png"] == ("/r/two/a+b.png", "found") and by["sub/./x.png"] == ("/r/one/sub/x.png", "found")
    assert by["/r/one/x.png"] == ("/r/one/x.png", "found") and by["/r/x.png"] == (None, "refused") and by[".."] == (None, "refused")
    assert by["data:image/png,x"][1] == by["//host/x.png"][1] == "remote" and by[None][1] == by["?q"][1] == "empty"
    assert [r.status for r in got if r.id == 2] == ["missing"]
    files = spark.createDataFrame([(1, "b/source.zip"), (1, "b/source.tar"), (2, "source.zip"), (3, "other.tar")], "id int, path string")
    assert {(r.id, r.path) for r in lookup.source_archives(files, "id").collect()} == {(1, "b/source.tar"), (2, "source.zip")}


def test_typed_json(spark):
    rows = [('{"n": 1, "o": {"x": [1, 2.5, null, "s"]}, "t": "1", "f": false}', '{"t": 2, "z": {"y": true}}'), (None, '{"a": 1}'), ("[1]", None), ("bad", "bad")]
    table = spark.createDataFrame(rows, "old string, new string")
    got = [r[0] for r in table.select(F.to_json(values.merged(F.col("old"), F.col("new")))).collect()]
    assert got == ['{"n":1,"o":{"x":[1,2.5,null,"s"]},"f":false,"t":2,"z":{"y":true}}', '{"a":1}', "{}", "{}"]
    replies = [('{"citations": [{"title": " A ", "url": 7, "arxiv": "1", "n": 1.5, "o": {"x": [1]}}, 3, {"text": "t", "title": " "}]}',), ('{"citations": [], "external_refs": [{"doi": "d"}]}',), ('{"citations": "x"}',), (None,), ("bad",)]
    found = [r[0] for r in spark.createDataFrame(replies, "reply string").select(values.external_refs(F.col("reply"))).collect()]
    assert [tuple(x) for x in found[0]] == [("A", None, None, "1", "", '{"n":1.5,"o":{"x":[1]}}'), (None, None, None, None, "t", "{}")]
    assert [x.doi for x in found[1]] == ["d"] and found[2:] == [[], [], []]
    low = F.array(F.lit("the"))
    kept = [r[0] for r in spark.createDataFrame([('{"k": ["The", "net"], "n": 1}',), ('{"n": 1}',), ("[1]",)], "p string").select(values.without_low(F.col("p"), "k", low)).collect()]
    assert kept == ['{"n":1,"k":["net"]}', '{"n": 1}', None]


def test_file_names(spark):
    """Numbered names that are another asset's own are passed over."""
    rows = [("a", "Fig", 1, ".png"), ("a", "fig", 2, ".png"), ("a", "fig 2", 3, ".png"), ("a", "", 4, None), ("a", "--", 5, None), ("b", "fig", 1, ".png"), ("b", "FIG", 2, ".png"), ("b", "fig", 3, ".pdf")]
    assets = spark.createDataFrame(rows, "package string, asset string, place long, suffix string")
    got = {(r.package, r.place): r.file for r in packages.file_names(assets).collect()}
    assert got == {("a", 1): "fig.png", ("a", 2): "fig-2.png", ("a", 3): "fig-2-2.png", ("a", 4): "asset", ("a", 5): "asset-2", ("b", 1): "fig.png", ("b", 2): "fig-2.png", ("b", 3): "fig.pdf"}
