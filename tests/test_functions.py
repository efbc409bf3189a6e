import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinsight.functions import paths as P
from twinsight.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("canFlattenTJump", ["canflattentjump", "flatten", "jump"]),
        ("isSetup()", ["issetup"]),
        ("foo/bar.", ["foo/bar.", "foo", "bar"]),
        ("unimplemented.", ["unimplemented."]),
        ("v1.2.3", ["v1.2.3"]),
        ("1.2.3", ["1.2.3"]),
        ("12abc", ["abc"]),
        ("fix_100_id", ["fix_100_id", "fix"]),
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("```go\nX", []),
        ("[link](http://x.y/z) https://a.b/c", ["link"]),
        ("café", ["caf"]),
        ("constructor __proto__", ["constructor", "__proto__"]),
        ("seen seen", ["seen", "seen"]),
        ("<!-- hidden\nwords -->shown", ["shown"]),
        ("https://a.b/c after", ["after"]),
        ("a" * 41, []),
        (None, []),
        ("", []),
    ],
)
def test_tokenize(spark, text, want):
    assert one(spark, text, T.tokenize) == want


@pytest.mark.parametrize("title,want", [("fix(api): Crash on Start ", "crash on start"), ("feat: A: b", "a: b"), ("No prefix", "no prefix"), ("docs: Wide", "wide")])
def test_norm_title(spark, title, want):
    assert one(spark, title, T.norm_title) == want


def test_counted(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "i int, t array<string>").select("i", F.array_sort("t").alias("s")).select("i", T.counted(F.col("s")).alias("c"))
    assert {r["i"]: [tuple(x) for x in r["c"]] for r in rows.collect()} == {1: [("a", 1), ("b", 2)], 2: []}


def test_ago(spark):
    now = dt.datetime(2024, 1, 10)
    for minutes, want in ((0, "just now"), (5, "5m ago"), (90, "2h ago"), (3 * 1440, "3d ago"), (None, "never")):
        then = None if minutes is None else now - dt.timedelta(minutes=minutes)
        assert one(spark, then, lambda x: T.ago(x, F.lit(now)), "timestamp") == want


def test_small_text_functions(spark):
    assert one(spark, '<a href="x">&', T.html_escape) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, "1.2.3.4, proxy/" + "x" * 80, T.caller_id) == ("1.2.3.4, proxy/" + "x" * 80)[:64].replace(",", "_").replace(" ", "_").replace("/", "_")
    assert one(spark, " a/x.go \n\nb/y.go\nz", T.clean_paths) == ["x.go", "y.go", "z"]
    assert one(spark, "😀" * 3, lambda x: F.substring(x, 1, 2)) == "😀😀"


@pytest.mark.parametrize(
    "path,noise,component,integration",
    [
        ("tool/internal/ast/x.go", False, "tool/ast", None),
        ("tool/cmd/a.go", False, "tool/cmd", None),
        (".github/x", False, "ci", None),
        (".github/workflows/a.yml", True, "ci", None),
        ("demo/a", False, "demo", None),
        ("schemas/a", False, "semconv", None),
        ("LICENSE", False, None, None),
        ("a/go.mod", True, None, None),
        ("Makefile", True, None, None),
        ("x/Makefile", False, None, None),
        ("tool/data/any-bundle.tgz", True, "tool/data", None),
        ("pkg/testdata/golden/a", True, "pkg/runtime", None),
        ("instrumentation/github.com/linode/linodego/hook.go", False, "instrumentation", "linode"),
        ("instrumentation/net/http/h.go", False, "instrumentation", "net"),
    ],
)
def test_paths(spark, path, noise, component, integration):
    assert one(spark, path, P.is_noise) == noise
    assert one(spark, path, P.component) == component
    assert one(spark, path, P.integration) == integration


def test_targets(spark):
    assert one(spark, "instrumentation/github.com/acme/v2/hook.go", P.targets_of) == ["github", "acme"]
    assert one(spark, "instrumentation/net/http/h.go", P.targets_of) == ["net", "http"]
    assert one(spark, "docs/a", P.targets_of) == []
