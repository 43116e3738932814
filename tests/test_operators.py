"""Operators on small fixtures with known results."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import paths as P
from lodeline.functions.identity import BASES, PRIME, commit_id, node_id
from lodeline.functions.scoring import band, round2, score_sets, surprise
from lodeline.operators import graph as G
from lodeline.operators import history as H
from lodeline.operators import ranking as R
from lodeline.operators import spatial as S
from lodeline.operators import validate as V
from lodeline.operators.resolve import CONFIG, MODULES, PACKAGES, ROOTS, link_edges, package_name, resolve
from lodeline.operators.scan import mask, scan
from lodeline.session import cut
from lodeline.operators.skew import salted_lookup
from lodeline.sources import documents, gitlog, manifests, tree


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("base,rest,want", [("a/b", "../c", "a/c"), ("a", "./b/./c", "a/b/c"), ("", "x", "x"), ("a", "../../b", None), ("a/b", "..", "a")])
def test_join_path(spark, base, rest, want):
    assert one(spark, P.join_path("b", "r"), b=base, r=rest) == want


def test_path_functions(spark):
    assert one(spark, P.clean_path("p"), p="././a/b") == "a/b"
    assert one(spark, P.name_tokens("p"), p="src/readHTTPBody_v2.test.ts") == ["read", "httpbody", "v2", "test"]
    assert one(spark, P.dir_prefixes("p"), p="a/b/c.ts") == ["a", "a/b"] and one(spark, P.dir_prefixes("p"), p="c.ts") == []
    assert [one(spark, P.extension("p"), p=x) for x in ("a/b.d.TS", "a.b/c", ".gitignore", "x.")] == ["ts", "", "", ""]
    assert one(spark, P.slug("p"), p="--A b/c!") == "a-b-c" and one(spark, P.slug("p"), p="!") == "root"


def test_node_ids(spark):
    def fnv(text, h):
        for b in text.encode("utf-16-le"):
            h = ((h ^ b) * PRIME) & 0xFFFFFFFF
        return f"{h:08x}"

    for p in ("src/a.ts", "é/ß.go", "", "漢字"):
        assert one(spark, node_id("p"), p=p) == "n:" + "".join(fnv(p, b) for b in BASES)[:12]
    assert one(spark, commit_id("p"), p="0123456789abcdef") == "c:0123456789ab"


def test_scalars(spark):
    assert [one(spark, G.layer(F.col("n")), n=n) for n in (0, 1, 2, 3, 4, 7, 8, 15, 16, 255, 256)] == [0, 1, 2, 2, 3, 3, 4, 4, 5, 8, 9]
    assert [one(spark, round2(F.col("x")), x=x) for x in (1.005, -2.5, 2.675, -0.005)] == [1.0, -2.5, 2.68, 0.0]


@pytest.mark.parametrize("picked,truth,want", [("abyz", "abcd", 0.5), ("aaa", "a", 1.0), ("", "a", 0.0), ("", "", 1.0), ("x", "a", 0.0), ("abcdefghijklmnopqrst", "abcd", 1 / 3)])
def test_scores(spark, picked, truth, want):
    df = spark.createDataFrame([(list(picked), list(truth))], "p array<string>, t array<string>")
    assert df.select(score_sets(F.col("p"), F.col("t"))["score"]).first()[0] == pytest.approx(want)
    assert df.select(surprise(F.col("t"), F.col("t"))).first()[0] == 0.0


def test_bands(spark):
    assert [one(spark, band(F.col("s")), s=s) for s in (0.95, 0.78, 0.6, 0.5, 0.49)] == ["S", "A", "B", "C", "-"]


def test_top_k_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 6), i) for g in range(4) for i in range(rng.choice((0, 1, 5, 40)))]
    df = spark.createDataFrame(rows, "g int, v int, i int")
    for k in (1, 3, 50):
        got = sorted((r["g"], r["i"]) for r in R.top_per_group(df, ["g"], [F.desc("v"), "i"], k).collect())
        assert got == sorted((g, i) for g in range(4) for _, i in sorted((-v, i) for h, v, i in rows if h == g)[:k])


def test_spread_and_quotas(spark):
    for n in (1, 3, 9, 10, 23, 100):
        df = spark.createDataFrame([(0, i) for i in range(n)], "g int, i int")
        for k in (1, 2, 5, 9):
            want = set(range(n)) if n <= k else {0} if k == 1 else {int(j * (n - 1) / (k - 1) + 0.5) for j in range(k)}
            assert {r["i"] for r in R.even_spread(df.withColumnRenamed("i", "j"), ["g"], ["j"], k).withColumnRenamed("j", "i").collect()} == want, (n, k)
    q = R.quotas(spark.createDataFrame([(0, "a", 5), (0, "b", 3), (0, "c", 2)], "g int, k string, w int"), ["g"], "w", "k", F.lit(7))
    assert {r["k"]: r["quota"] for r in q.collect()} == {"a": 4, "b": 2, "c": 1}


def test_select_mix(spark):
    rows = [(1, s, i + 1, v) for s, vs in (("x", "abcd"), ("y", "abef"), ("z", "g")) for i, v in enumerate(vs)]
    got = R.select_mix(spark.createDataFrame(rows, "b int, strategy string, place int, item string"), ["b"], "item", ["x", "y", "z"], [2, 2, 1], 5).collect()
    assert {(r["item"], r["strategy"]) for r in got} == {("a", "x"), ("b", "x"), ("e", "y"), ("f", "y"), ("g", "z")}


def test_salted_lookup_is_a_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 20}", i) for i in range(9000)], "k string, i int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    a = salted_lookup(left, right, ["k"], "n", ["i"])
    assert sorted(map(tuple, a.select("k", "i", "n", "m").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "i", "n", "m").collect()))


# --- graphs


def edges(spark, pairs, repo=1):
    return spark.createDataFrame([(repo, a, b, 1) for a, b in pairs], "repo_id long, src string, dst string, weight long")


def test_reach_in_cycles_and_chains(spark):
    got = {(r["start"], r["node"]): r["distance"] for r in G.reach(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2}
    seeds = spark.createDataFrame([(1, "a")], "repo_id long, start string")
    assert G.reach(edges(spark, [(f"{i:02}", f"{i + 1:02}") for i in range(30)] + [("a", "00")]), seeds, 5).count() == 5
    assert G.reach(edges(spark, [("a", "b")]).limit(0)).count() == 0
    deep = G.reach(edges(spark, [(f"{i:02}", f"{i + 1:02}") for i in range(20)]), spark.createDataFrame([(1, "00")], "repo_id long, start string"))
    assert {r["node"]: r["distance"] for r in deep.collect()} == {f"{i:02}": i for i in range(1, 21)}


def test_repositories_do_not_meet(spark):
    e = edges(spark, [("a", "b")]).unionByName(edges(spark, [("b", "c")], 2))
    assert sorted((r["repo_id"], r["node"], r["part"]) for r in G.connected(e).collect()) == [(1, "a", "a"), (1, "b", "a"), (2, "b", "b"), (2, "c", "b")]
    assert G.reach(e).count() == 2


def test_strong_parts_twins_and_marks(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "c"), ("e", "c"), ("c", "f")])
    assert sorted((r["node"], r["part"]) for r in G.strongly_connected(e).collect()) == [("a", "a"), ("b", "a")]
    assert {r["node"] for r in G.twins(G.reach(e)).collect()} == {"d", "e"}
    marked = spark.createDataFrame([(1, "c")], "repo_id long, node string")
    assert {r["node"] for r in G.spread_mark(e, marked).collect()} == set("abcde")


def test_communities_of_two_cliques(spark):
    one_ = [(a, b) for a in "abcde" for b in "abcde" if a < b]
    e = edges(spark, one_ + [(a.upper(), b.upper()) for a, b in one_] + [("a", "A")])
    labels = G.communities(e)
    parts = collections.defaultdict(set)
    for r in labels.collect():
        parts[r["label"]].add(r["node"])
    assert sorted(map(sorted, parts.values())) == [list("ABCDE"), list("abcde")]
    assert G.modularity(e, labels).first()["modularity"] > 0.4
    assert {r["rand"] for r in G.rand_index(labels, labels).collect()} == {1.0}
    lone = labels.withColumn("label", F.when(F.col("node") == "a", "a!").otherwise(F.col("label")))
    assert G.absorb_small(e, lone).select("label").distinct().count() == 2


# --- history


def test_rename_origins(spark):
    ev = [(1, "1", "a", "b"), (1, "2", "b", "c"), (1, "3", "x", "b"), (1, "4", "c", "d"), (1, "5", "d", "d"), (2, "1", "q", "r"), (2, "2", "q", "s")]
    got = {(r["repo_id"], r["path"]): (r["origin"], r["hops"], r["contested"]) for r in H.rename_origins(spark.createDataFrame(ev, "repo_id long, seq string, from_path string, to_path string")).collect()}
    assert got == {(1, "b"): ("x", 1, False), (1, "c"): ("a", 2, True), (1, "d"): ("a", 3, True), (2, "r"): ("q", 1, True), (2, "s"): ("q", 1, True)}


def test_floor_where_the_cap_bites(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 5), (1, "a", "c", 4), (1, "b", "c", 3), (2, "a", "b", 9)], "repo_id long, a string, b string, n long")
    lim = spark.createDataFrame([(1, 2, 2), (2, 2, 2)], "repo_id long, min_co_change_count int, max_co_change_pairs int")
    assert {r["repo_id"]: (r["cap_bit"], r["floor"], r["kept"]) for r in H.floors(pairs, lim).collect()} == {1: (True, 5, 2), 2: (False, 2, 1)}


# --- sources


def test_git_log(spark, tmp_path):
    u, n, r = gitlog.UNIT, gitlog.NUL, gitlog.RECORD
    text = f"aa{u}2026-01-05{u}Ann{u}first{n}\nM{n}a.ts{n}R100{n}b.ts{n}c.ts{n}C75{n}a.ts{n}d.ts{n}{r}bb{u}2026-02-07{u}Bob{u}sub|ject{r}short{r}"
    (tmp_path / "log").write_text(text)
    got = {x["sha"]: x for x in gitlog.parse_log(gitlog.read_log(spark, str(tmp_path / "log"))).collect()}
    assert set(got) == {"aa", "bb"}
    assert got["aa"]["files"] == ["a.ts", "c.ts", "d.ts"] and [tuple(x) for x in got["aa"]["renames"]] == [("b.ts", "c.ts")]
    assert str(got["aa"]["commit_date"]) == "2026-01-05" and got["bb"]["files"] == [] and got["bb"]["subject"] == "sub|ject"


@pytest.mark.parametrize(
    "lines,path,want",
    [
        (["node_modules/"], "a/node_modules/b.js", True), (["node_modules/"], "a/node_modules", False), (["*.snap"], "x/y.snap", True), (["*.snap", "!keep.snap"], "x/keep.snap", False),
        (["/dist"], "dist/a.js", True), (["/dist"], "src/dist/a.js", False), (["docs/*.md"], "docs/a.md", True), (["docs/*.md"], "docs/x/a.md", False), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True),
        (["**/gen"], "p/gen/a", True), (["f?o.[ch]"], "x/foo.c", True), (["f?o.[!ch]"], "x/foo.c", False), (["# c", "", "\\#x"], "#x", True), (["b/**"], "b/c/d", True),
    ],
)
def test_ignore_rules(spark, lines, path, want):
    paths = spark.createDataFrame([(path,)], "path string")
    assert (tree.ignored(paths, tree.rules_of(spark, lines)).count() == 1) is want


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("let a = 1\nlet b")
    (tmp_path / "b.json").write_bytes(b"{\0}")
    (tmp_path / "c.rs").write_text("fn main() {}\n")
    t = tree.read_tree(spark, str(tmp_path))
    assert {r["path"] for r in t.collect()} == {"src/a.ts", "b.json", "c.rs"}
    assert {r["path"]: r["reason"] for r in tree.classify(t, tree.rules_of(spark, ["src/"])).collect()} == {"src/a.ts": "ignored", "b.json": "binary", "c.rs": "unsupported"}
    assert {r["path"]: r["n"] for r in t.select("path", tree.line_count("text").alias("n")).collect()} == {"src/a.ts": 2, "b.json": None, "c.rs": 1}


def test_manifests(spark):
    files = spark.createDataFrame(
        [
            ("tsconfig.json", '{ // base\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"],},}, }'),
            ("pkg/tsconfig.json", '{"extends": "../tsconfig", "compilerOptions": {"baseUrl": "lib" /* own */}}'),
            ("pkg/x/tsconfig.json", '{"extends": "../tsconfig.json"}'),
            ("lone/tsconfig.json", "no json"),
        ],
        "path string, text string",
    )
    got = {r["path"]: (r["base_url"], list(r["paths"]) if r["paths"] else None) for r in manifests.tsconfig_chain(files).collect()}
    assert got == {"tsconfig.json": ("src", ["@/*"]), "pkg/tsconfig.json": ("lib", ["@/*"]), "pkg/x/tsconfig.json": ("lib", ["@/*"]), "lone/tsconfig.json": (None, None)}
    near = manifests.nearest_manifest(spark.createDataFrame([("pkg/x/y/a.ts",), ("z/b.ts",)], "path string"), files.select("path"))
    assert {r["path"]: r["manifest"] for r in near.collect()} == {"pkg/x/y/a.ts": "pkg/x/tsconfig.json", "z/b.ts": "tsconfig.json"}
    go = spark.createDataFrame([("go.mod", 'module example.com/m // note\n\nrequire (\n\ta.b/c v1.2.3 // indirect\n)\nrequire d.e/f v0.1.0\nreplace a.b/c => ../c\n')], "path string, text string")
    assert sorted((r["kind"], r["name"], r["version"], r["target"]) for r in manifests.go_modules(go).collect()) == [
        ("module", "example.com/m", None, None), ("replace", "a.b/c", None, "../c"), ("require", "a.b/c", "v1.2.3", None), ("require", "d.e/f", "v0.1.0", None),
    ]
    py = spark.createDataFrame([("requirements-dev.txt", "Foo_Bar>=1\n# c\n-r x\n"), ("pyproject.toml", '[project]\ndependencies = ["a.b~=1", \'c\']\n[tool.poetry.dependencies]\npython = "3"\nd = "1"\n')], "path string, text string")
    assert {r["name"] for r in manifests.python_requirements(py).collect()} == {"foo-bar", "a-b", "c", "d"}


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", -0.0), (1, None, 1.5)], "id int, a string, z double")
    assert [json.loads(r["json"]) for r in documents.canonical(df, ["id"]).collect()] == [{"a": None, "id": 1, "z": 1.5}, {"a": "b", "id": 2, "z": 0.0}]
    documents.write_canonical(df, ["id"], str(tmp_path / "out"))
    assert documents.read_strict(spark, str(tmp_path / "out"), "a string, id int, z double").count() == 2
    with pytest.raises(Exception, match="not finite"):
        documents.canonical(df.withColumn("z", F.lit(float("nan"))), ["id"]).collect()
    (tmp_path / "t").write_text('{"verb":"v","subject":"s","graded":2,"passed_on":1}\n{"verb":"v","subject":"t","graded":1,"passed_on":3}\nnope\n')
    assert [r["subject"] for r in documents.read_tally(spark, str(tmp_path / "t")).collect()] == ["s"]
    (tmp_path / "p").write_text('{"version":1,"verb":"v","subject":"s","done":["b","a","a"]}\n{"version":2,"verb":"v","subject":"t","proved":["x"],"shown":["y"]}\n')
    assert sorted((r["subject"], tuple(r["proved"]), tuple(r["shown"])) for r in documents.read_progress(spark, str(tmp_path / "p")).collect()) == [("s", ("a", "b"), ()), ("t", ("x",), ("y",))]


# --- imports


def test_mask():
    text = "a // 'x'\n\"b // c\" /* d */ `e`"
    masked, table = mask(text, "ts")
    assert len(masked) == len(text) and "//" not in masked and list(table.values()) == ["b // c", "e"]


def test_scan_awkward_texts():
    imports = lambda t, lang: scan(t, lang)[0]
    assert imports("const u = /\\/\\//.test(s); import c from './c';", "ts") == [("import", "./c")]
    assert imports("const r = a / b / c; import y from './b'; if (x) /re'/.exec(y); z = i++ / 2; import c from './c' // '", "ts") == [("import", "./b"), ("import", "./c")]
    assert imports("f(`x ${ require('./t') } y ${`n ${import('./n')}`} // import 'no'`); import z from './z'", "ts") == [("require", "./t"), ("dynamic", "./n"), ("import", "./z")]
    assert imports("import(foo); require(`./${x}`); require(join('a'))", "ts") == [("computed", "")] * 3
    assert imports("a = 'open\nimport d from './d'", "js") == [("import", "./d")]
    assert imports("from x import \\\n  a, b\nx=1; import sys\nif True: import os\ndef f(): from . import (\n q as r, # c\n s,\n)\nd = {'a': 1}\nfrom ..p.m import *\n", "py") == [
        ("from", "x:a"), ("from", "x:b"), ("import", "sys"), ("import", "os"), ("from", ".:q"), ("from", ".:s"), ("from", "..p.m:*"),
    ]
    assert imports('s = "import no"; import yes  # import no\n"""\nimport no\n"""\n', "py") == [("import", "yes")]
    assert scan("export * from './all'", "ts") == ([("reexport", "./all")], ["*"])
    go = "package a\nconst (\n\tA = iota\n\tB\n\tc = f(D{\n\t\tE: 1,\n\t})\n)\nvar F, G = 1, 2\ntype (\n\tH struct {\n\t\tI int\n\t}\n\tJ int\n)\nfunc (r *T) K() {}\n"
    assert scan(go, "go") == ([], ["A", "B", "F", "G", "H", "J", "K"])
    for lang in ("ts", "py", "go"):
        assert scan("", lang) == ([], [])
        for text in ("`${", "/", "a = /[", "'''", "(((", "import", "from . import", "const ("):
            assert len(mask(text, lang)[0]) == len(text) and scan(text, lang)


def test_scan():
    refs, names = scan("import a, { b } from './x.js';\nimport 'y';\nexport * from \"z\";\nimport type { T } from 't';\nconst q = require('r'); // import 'no'\nconst s = `import 'no'`; await import('dyn');\nexport const c = 1; export default function f() {}\nexport { g as h };", "ts")
    assert refs == [("import", "./x.js"), ("import", "y"), ("reexport", "z"), ("type", "t"), ("require", "r"), ("dynamic", "dyn")] and names == ["*", "c", "default", "f", "h"]
    refs, names = scan('package p\nimport "fmt"\nimport (\n\tx "a/b"\n\t// "no"\n)\nfunc F() {}\nfunc (t T) M() {}\nvar v = "import"\n', "go")
    assert refs == [("import", "fmt"), ("import", "a/b")] and names == ["F", "M"]
    refs, names = scan("import os, a.b as c\nfrom ..x import (y,\n  z as w)\n'''\nimport no\n'''\ndef f(): pass\nclass _H: pass\nV = 1\nm = import_module('q')\n", "py")
    assert refs == [("import", "os"), ("import", "a.b"), ("from", "..x:y"), ("from", "..x:z"), ("dynamic", "q")] and names == ["V", "f", "m"]


def test_resolve(spark):
    paths = spark.createDataFrame([(1, p) for p in (
        "src/a.ts", "src/b.tsx", "src/d/index.ts", "src/e.js", "src/e.ts", "src/util/x.ts", "pkg/m.py", "pkg/n/__init__.py", "pkg/n/o.py", "app/s/t.py", "lib/s/t.py", "ns/p/q.py",
        "libs/k/src/index.ts", "libs/k/src/core.ts", "libs/k/core.ts", "libs/j/one.ts", "libs/j/src/two.ts", "libs/j/three.ts", "libs/j/src/three.ts", "main.go", "in/deep/d.go", "in/deep/d2.go", "moved/v.go",
    )], "repo_id long, path string")
    configs = spark.createDataFrame([
        (1, "", "src", [("@app/", True, ["gone/", "src/"]), ("whole", False, ["src/a.ts"])], ["left-pad", "@s/p", "requests"], ["#in/*"]), (1, "libs/k", None, None, ["zod"], None),
    ], CONFIG)
    packages = spark.createDataFrame([(1, "@s/k", "libs/k", {".": "./dist/index.js", "./c": "./src/core.ts", "./x/*": "./dist/*.js"}), (1, "jj", "libs/j", {})], PACKAGES)
    modules = spark.createDataFrame([(1, "a.b/root", "", ["x.y/need"], {"o.p/old": "./moved"}), (1, "a.b/root/in", "in", [], {})], MODULES)
    roots = spark.createDataFrame([(1, ""), (1, "app"), (1, "lib")], ROOTS)
    disk = spark.createDataFrame([(1, "src/look.css"), (1, "src/a.ts")], "repo_id long, path string")
    refs = [
        ("src/a.ts", "ts", "import", "./b.js", "internal", "src/b.tsx", "certain"), ("src/a.ts", "ts", "import", "./d", "internal", "src/d/index.ts", "certain"), ("src/a.ts", "ts", "import", ".", "unresolved", None, None),
        ("src/a.ts", "ts", "import", "./e.js", "internal", "src/e.js", "probable"), ("src/a.ts", "ts", "import", "../zz", "unresolved", None, None), ("src/a.ts", "ts", "import", "../../out", "unresolved", None, None),
        ("src/a.ts", "ts", "import", "node:fs", "external", None, None), ("src/a.ts", "ts", "import", "https://x.y/z.js", "external", None, None), ("src/a.ts", "ts", "import", "/abs/p", "unresolved", None, None),
        ("src/a.ts", "ts", "import", "@s/p/q", "external", None, None), ("src/a.ts", "ts", "import", "undeclared", "unresolved", None, None), ("src/a.ts", "ts", "import", "fs/promises", "external", None, None),
        ("src/a.ts", "ts", "import", "@app/util/x", "internal", "src/util/x.ts", "certain"), ("src/a.ts", "ts", "import", "@app/none", "unresolved", None, None), ("src/a.ts", "ts", "import", "whole", "internal", "src/a.ts", "certain"),
        ("src/a.ts", "ts", "import", "util/x", "internal", "src/util/x.ts", "certain"), ("src/a.ts", "ts", "import", "#in/z", "external", None, None), ("src/a.ts", "ts", "import", "#other", "unresolved", None, None),
        ("src/a.ts", "ts", "import", "./look.css", "offMap", "src/look.css", None), ("src/a.ts", "ts", "computed", "", "unresolved", None, None),
        ("libs/k/core.ts", "ts", "import", "zod", "external", None, None), ("libs/k/core.ts", "ts", "import", "left-pad", "unresolved", None, None),
        # a package of the repository: declared and there; declared, built, its source mirror; never its own decoy; not declared
        ("src/a.ts", "ts", "import", "@s/k/c", "internal", "libs/k/src/core.ts", "certain"), ("src/a.ts", "ts", "import", "@s/k", "internal", "libs/k/src/index.ts", "certain"),
        ("src/a.ts", "ts", "import", "@s/k/x/core", "unresolved", None, None), ("src/a.ts", "ts", "import", "jj/one", "internal", "libs/j/one.ts", "certain"), ("src/a.ts", "ts", "import", "jj/two", "internal", "libs/j/src/two.ts", "certain"),
        ("src/a.ts", "ts", "import", "jj/three", "internal", "libs/j/three.ts", "probable"), ("src/a.ts", "ts", "import", "jj/none", "unresolved", None, None),
        ("pkg/m.py", "py", "from", ".n:o", "internal", "pkg/n/__init__.py", "certain"), ("pkg/m.py", "py", "from", ".n:o", "internal", "pkg/n/o.py", "certain"), ("pkg/n/o.py", "py", "from", "..m:f", "internal", "pkg/m.py", "certain"),
        ("pkg/m.py", "py", "import", "json", "external", None, None), ("pkg/m.py", "py", "import", "numpy", "unresolved", None, None), ("pkg/m.py", "py", "import", "requests.api", "external", None, None),
        ("pkg/m.py", "py", "import", "s.t", "internal", "app/s/t.py", "probable"), ("pkg/m.py", "py", "import", "s.t", "internal", "lib/s/t.py", "probable"), ("pkg/m.py", "py", "from", "ns.p:q", "internal", "ns/p/q.py", "certain"),
        ("pkg/m.py", "py", "from", "ns.p:zz", "unresolved", None, None), ("pkg/m.py", "py", "from", "....far:x", "unresolved", None, None),
        ("main.go", "go", "import", "net/http", "external", None, None), ("main.go", "go", "import", "a.b/c", "unresolved", None, None), ("main.go", "go", "import", "x.y/need/sub", "external", None, None),
        ("main.go", "go", "import", "a.b/root/in/deep", "internal", "in/deep", "certain"), ("main.go", "go", "import", "a.b/root/none", "unresolved", None, None), ("in/deep/d.go", "go", "import", "a.b/root", "internal", ".", "certain"),
        ("main.go", "go", "import", "o.p/old", "internal", "moved", "certain"), ("main.go", "go", "import", "./x", "unresolved", None, None), ("in/deep/d.go", "go", "import", "x.y/need", "unresolved", None, None),
    ]
    frame = spark.createDataFrame([(1, *r[:4]) for r in {r[:4]: r for r in refs}.values()], "repo_id long, path string, lang string, kind string, specifier string")
    got = cut(resolve(frame, paths, configs, packages, modules, roots, disk))
    have = {(r["path"], r["specifier"], r["outcome"], r["target"], r["confidence"]) for r in got.collect()}
    want = {(r[0], *r[3:]) for r in refs}
    assert have == want, (sorted(map(str, have - want)), sorted(map(str, want - have)))
    assert {(r["src"], r["dst"], r["confidence"]) for r in link_edges(got).collect()} >= {("src/a.ts", "src/e.js", "probable"), ("pkg/n/o.py", "pkg/m.py", "certain"), (".", "in/deep", "certain"), ("in/deep", ".", "certain")}
    assert one(spark, package_name(F.col("s")), s="@s/p/q") == "@s/p" and one(spark, package_name(F.col("s")), s="p/q") == "p"
    bare = {r["specifier"]: r["outcome"] for r in resolve(frame, paths).where("specifier in ('net/http', 'a.b/root', '@s/p/q', 'fs/promises', 'json')").collect()}
    assert bare == {"net/http": "external", "a.b/root": "unresolved", "@s/p/q": "unresolved", "fs/promises": "external", "json": "external"}
    assert resolve(frame.limit(0), paths).count() == 0


# --- quality and geometry


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 0, ["x"], ["x", "y"]), (1, "a", 1, [], ["x"]), (2, None, 2, ["z"], ["x"])], "g int, k string, i int, truth array<string>, all array<string>")
    assert {(r["rule"], r["entity"]) for r in V.row_rules(df, F.col("i"), {"k": F.col("k").isNotNull()}).collect()} == {("k", "2")}
    assert V.unique(df, ["g", "k"], "u").count() == 1
    assert {r["entity"] for r in V.subset(df, F.col("i"), "truth", "all", "s").collect()} == {"1", "2"}
    assert V.ordered(df, ["g"], "i", ["k"], "o").count() == 1
    assert V.refers(df, ["g"], df.where("g = 1"), "r").first()["entity"] == "2"
    assert V.counts_match(spark.createDataFrame([(1, 2), (2, 5)], "g int, n int"), ["g"], "n", df, "c").first()["detail"] == "5<>1"


def test_geometry(spark):
    cam = {"x": 3.0, "y": -2.0, "zoom": 1.7, "angle": 0.6, "width": 800, "height": 600}
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    r = df.select(*[c.alias(n) for c, n in zip(S.to_world(*S.to_screen(F.col("x"), F.col("y"), cam), cam), "xy", strict=True)]).first()
    assert (r["x"], r["y"]) == pytest.approx((1, 2))
    rng = random.Random(3)
    pts = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(120)]
    got = {(r["a"], r["b"]) for r in S.within(spark.createDataFrame(pts, "k int, x double, y double"), "k", 1.0).collect()}
    assert got == {(a, b) for a, ax, ay in pts for b, bx, by in pts if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 1}
    white = df.select(S.contrast(*[F.lit(255)] * 3, *[F.lit(0)] * 3).alias("c")).first()["c"]
    assert white == pytest.approx(21)


# --- matching, wording, layout


def test_greedy_matching_is_the_one_by_one_rule(spark):
    from lodeline.operators.matching import greedy_matching

    rng = random.Random(5)
    cells = {(rng.randint(0, 6), rng.randint(0, 6)): rng.randint(1, 5) for _ in range(30)}
    left, right, want = set(), set(), set()
    for (a, b), n in sorted(cells.items(), key=lambda kv: (-kv[1], kv[0])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b, n))
    df = spark.createDataFrame([(1, a, b, n) for (a, b), n in cells.items()], "g int, a int, b int, n int")
    assert {(r["a"], r["b"], r["n"]) for r in greedy_matching(df, ["g"], "a", "b", "n").collect()} == want


def test_votes_and_claims(spark):
    from lodeline.operators.matching import claim_origins, go_targets, majority_origin, package_facts

    m = spark.createDataFrame([(1, "p", "a"), (1, "p", "a"), (1, "p", "b"), (1, "q", "a"), (1, "q", "b")], "repo_id long, package string, origin_dir string")
    assert {r["package"]: r["origin"] for r in majority_origin(m).collect()} == {"p": "a", "q": "q"}
    asked = spark.createDataFrame([(1, "k1", "o"), (1, "k2", "o"), (1, "k3", "live"), (1, "live", "live")], "repo_id long, key string, origin string")
    live = spark.createDataFrame([(1, "live")], "repo_id long, key string")
    assert {r["key"]: r["origin"] for r in claim_origins(asked, live).collect()} == {"k1": "o", "k2": "k2", "k3": "k3", "live": "live"}
    mods = spark.createDataFrame([(1, "e.com/m", ""), (1, "e.com/m/sub", "sub")], "repo_id long, module string, directory string")
    refs = spark.createDataFrame([(1, "e.com/m/x/y"), (1, "e.com/m/sub/z"), (1, "e.com/mm")], "repo_id long, specifier string")
    assert {r["specifier"]: (r["module"], r["directory"]) for r in go_targets(refs, mods).collect()} == {"e.com/m/x/y": ("e.com/m", "x/y"), "e.com/m/sub/z": ("e.com/m/sub", "sub/z")}
    man = spark.createDataFrame([("package.json", '{"name":"n","dependencies":{"b":"1","a":"2"},"devDependencies":{"a":"3"},"workspaces":["p/*"]}'), ("x/package.json", "nope")], "path string, text string")
    assert {r["path"]: (r["name"], r["dependencies"], r["workspaces"]) for r in package_facts(man).collect()} == {"package.json": ("n", ["a", "b"], ["p/*"]), "x/package.json": (None, [], [])}


def test_wording(spark):
    from lodeline.functions import wording as W

    assert one(spark, W.counted(F.col("n"), "file"), n=1) == "1 file" and one(spark, W.counted(F.col("n"), "entry", "entries"), n=3) == "3 entries"
    assert one(spark, W.short_label(F.col("s"), 9), s="abcdefghijkl") == "abcd…ijkl" and one(spark, W.short_label(F.col("s")), s="short") == "short"
    for name, pattern, target, want in (("./x/a", "./x/*", "./src/*.ts", "./src/a.ts"), ("./y", "./x/*", "./s/*", None), ("./x", "./x", "./z", "./z"), ("./a", "./a*a", "t*", None)):
        assert one(spark, W.pattern_target(F.col("n"), F.col("p"), F.col("t")), n=name, p=pattern, t=target) == want
    df = spark.createDataFrame([(["b", "a", "c"], {"b": "tree"}, ["file", "file"]), (["x"], {}, [])], "c array<string>, m map<string,string>, k array<string>")
    w = W.encode_witness(F.col("c"), F.col("m"))
    got = df.select(w.alias("w"), W.decode_witness(F.col("c"), w).alias("m"), W.noun_of(F.col("k")).alias("n")).collect()
    assert [(r["w"], r["m"], r["n"]) for r in got] == [("- tree -", {"b": "tree"}, "file"), ("-", {}, "place")]


def test_layout_keeps_labels_apart(spark):
    from lodeline.operators.layout import force_layout

    group = lambda k: [f"{k}{i}" for i in range(6)]
    e = edges(spark, [(a, b) for k in "ab" for a in group(k) for b in group(k) if a < b] + [("a0", "b0")])
    labels = spark.createDataFrame([(1, n, n[0]) for k in "ab" for n in group(k)], "repo_id long, node string, label string")
    at = force_layout(e, labels, 12)
    assert at.count() == 12 and at.agg(F.max(F.abs("x"))).first()[0] < 1000
    assert abs(at.agg(F.avg("x")).first()[0]) < 0.1
    assert S.spread_ratio(at, "label").first()["ratio"] < 1


def test_boards_hold_their_invariants(spark):
    from lodeline.plans.boards import assemble, folder_guess, hold_out

    truth = spark.createDataFrame([(1, "s", f"d/t{i}", i) for i in range(1, 5)], "repo_id long, subject string, member string, place int")
    wrong = spark.createDataFrame([(1, "s", f"d/w{i:02}", i, "tree") for i in range(1, 30)], "repo_id long, subject string, member string, place int, strategy string")
    b = folder_guess(assemble(truth, wrong)).first()
    assert len(b["truth"]) == 4 and set(b["truth"]) < set(b["candidates"]) and len(b["candidates"]) == 19 == len(b["witness"].split())
    assert [c in b["truth"] for c in b["candidates"]] == [w == "-" for w in b["witness"].split()]
    assert assemble(truth, wrong.where("place <= 2")).count() == 0
    boards = spark.createDataFrame([(1, "k", f"s{i}") for i in range(40)], "repo_id long, kind string, subject string")
    facts = boards.withColumn("relation", F.lit("r")).withColumn("one", F.lit("x")).withColumn("other", F.lit("y"))
    assert hold_out(boards, facts, facts.limit(0), 4).count() == 0
    own = facts.withColumn("one", F.col("subject"))
    assert 0 < hold_out(boards, own, own.limit(0), 4).count() < 40


def test_split_lookup_is_a_join(spark, monkeypatch):
    from lodeline.operators import skew

    left = spark.createDataFrame([(1, "hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)] + [(None, "hot", -1), (1, None, -2)], "g int, k string, v int")
    right = spark.createDataFrame([(1, "hot", "H"), (1, "k3", "T"), (1, "none", "N"), (2, "hot", "O")], "g int, k string, w string")
    expect = sorted(tuple(r) for r in left.join(right, ["g", "k"]).collect())
    assert sorted(tuple(r) for r in skew.split_lookup(left, right, ["g", "k"]).collect()) == expect
    monkeypatch.setattr(skew, "MANY", 10)
    split = skew.split_lookup(left, right, ["g", "k"])
    assert sorted(tuple(r) for r in split.collect()) == expect
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan
    assert skew.split_lookup(left.limit(0), right, ["g", "k"]).count() == 0
