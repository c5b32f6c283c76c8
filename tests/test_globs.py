"""Ignore rules: a table made by hand, and git itself where it is installed."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import globs


def excluded(spark, rules, files):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, p string")
    flag = globs.matches_any(F.col("p"), globs.clean_patterns(rules))
    return {r.p for r in df.select("p", flag.alias("x")).collect() if r.x}


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.log", ["a.log", "d/a.log", "x.log/y"], ["a.logx", "log"]),
        ("build", ["build", "d/build", "build/x/y", "d/build/x"], ["builds", "d/xbuild"]),
        ("build/", ["build/x", "d/build/x"], ["build", "d/build"]),
        ("/build", ["build", "build/x"], ["d/build"]),
        ("a/b", ["a/b", "a/b/c"], ["d/a/b", "a/bc"]),
        ("a/*", ["a/x", "a/x/y"], ["a", "d/a/x"]),
        ("a/**", ["a/x", "a/x/y"], ["a", "d/a/x"]),
        ("**/t", ["t", "d/t", "d/e/t/x"], ["tt"]),
        ("p/**/t", ["p/t", "p/x/t", "p/x/y/t/z"], ["d/p/t", "p/xt"]),
        ("?.c", ["a.c", "d/b.c"], ["ab.c", ".c"]),
        ("[ab].c", ["a.c", "d/b.c"], ["c.c"]),
        ("[!ab].c", ["c.c"], ["a.c", "d/b.c"]),
        (".env.*", [".env.local", "d/.env.x"], [".env", "xenv.y"]),
        ("x+y(1)", ["x+y(1)"], ["xxy1"]),
    ],
)
def test_one_pattern(spark, pattern, yes, no):
    assert excluded(spark, [pattern], yes + no) == set(yes)


def test_last_rule_wins(spark):
    files = ["keep.log", "a.log"]
    assert excluded(spark, ["*.log", "!keep.log"], files) == {"a.log"}
    assert excluded(spark, ["!keep.log", "*.log"], files) == {"keep.log", "a.log"}
    assert excluded(spark, ["*.log", "!keep.log", "keep*"], files) == {"keep.log", "a.log"}
    assert excluded(spark, ["", "# *.log", "  a.log  "], files) == {"a.log"}
    assert excluded(spark, [], files) == set()


def test_reason_takes_the_first_set_and_sets_are_independent(spark):
    files = ["a.log", "x/node_modules/y.js", "b.vue", "c.py"]
    df = spark.createDataFrame([(f,) for f in files], "p string")
    reason = globs.exclusion_reason(F.col("p"), ["b.*", "!a.log"], ["*.vue", "*.log", "!c.py"])
    assert {r.p: r.r for r in df.select("p", reason.alias("r")).collect()} == {
        "a.log": "default",
        "x/node_modules/y.js": "default",
        "b.vue": "gitignore",
        "c.py": None,
    }


def test_comma_separated(spark):
    assert globs.split_patterns("*.log, somedir/*,") == ["*.log", "somedir/*"]
    assert globs.split_patterns(None) == []


RULE_SETS = [
    ["*.log"], ["build"], ["build/"], ["/build"], ["a/b"], ["a/*"], ["a/**"], ["**/t"],
    ["p/**/t"], ["?.c"], ["[ab].c"], ["[!ab].c"], ["*.log", "!keep.log"], ["!keep.log", "*.log"],
    ["/*.c"], ["d/*.log"], ["**/a/b"], ["*"], ["keep.*"], [r"\!x"], ["[a-c].c", "!b.c"],
]
TREE = [
    "a.log", "keep.log", "d/a.log", "d/keep.log", "build/x", "d/build/y", "a/b/c", "a/x.c",
    "d/a/b/c", "t/u", "d/t", "p/t", "p/q/t", "p/q/r/t/z", "a.c", "b.c", "c.c", "ab.c", "d/b.c",
    "!x", "buildx", "d/e/f/g.txt",
]


@pytest.mark.skipif(shutil.which("git") is None, reason="git is not installed")
def test_same_as_git(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name in TREE:
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    for rules in RULE_SETS:
        (tmp_path / ".gitignore").write_text("\n".join(rules) + "\n")
        found = subprocess.run(
            ["git", "-C", str(tmp_path), "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin"],
            input="\n".join(TREE), capture_output=True, text=True,
        ).stdout.splitlines()
        assert excluded(spark, rules, TREE) == set(found), rules
