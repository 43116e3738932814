"""Provenance, leakage, mixture and stuffing on small made-up texts."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodeline.llm import leakage, provenance, stuffing
from lodeline.llm.mixture import _U, Mixture, _thresholds, count_tokens

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha", "ki", "lo", "mu", "ne", "pi", "ro") for b in ("dal", "mit", "ros", "ten", "vop", "zuk", "lin", "gar")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- provenance


def code(rng, name, lines=24):
    return "".join(f"export function {rng.choice(WORDS)}{name}{i}x({rng.choice(WORDS)}) {{ return {rng.choice(WORDS)} + {rng.randint(1, 999)}; }}\n" for i in range(lines)).replace("x(", "Q(")


def judged(path, text):
    return provenance.judge(path, text, provenance.Notices())[0]


def test_notices_in_comments_only():
    body = "const alpha = beta(gamma);\n" * 5
    assert judged("a/b.ts", "// Code generated by x. DO NOT EDIT.\n" + body) == "generated"
    assert judged("a/b.py", body + "\n# Automatisch erzeugt aus x. Nicht bearbeiten.\n") == "generated"
    assert judged("a/b.ts", "// Licensed to the team\n// Copied from libx release 1.2\n" + body) == "vendored"
    assert judged("a/b.js", "{{#each x}}\n// Code generated by x. DO NOT EDIT.\n" + body) == "generated"
    assert judged("a/b.go", "package a\n" + body + "\n// Generated by the x compiler.\n:wq\n") == "generated"
    assert judged("a/b.ts", body + 'const banner = "Code generated by x. DO NOT EDIT.";\n') == ""
    assert judged("a/b.ts", "// unlike the generated stubs, kept by hand; do not edit lightly\n" + body) == ""
    assert judged("node_modules/x/a.ts", body) == ""
    assert judged("a.min.js", "") == ""


LICENCE = "".join(f"// {line}\n" for line in ["Copyright 2021 The Acme Authors.", *(f"Permission is granted under condition {i} of this text." for i in range(25))])


@pytest.mark.parametrize(
    "notice",
    [
        "// Code generated by protoc. DO NOT EDIT. TODO(x): regen", "// This file was automatically generated by x from y.idl.", "/* eslint-disable */\n// @generated by relay", "// Autogenerated on every build. Do not modify by hand.",
        "/*\n * AUTO-GENERATED FILE - any changes will be lost.\n */", "// Hand edits are overwritten.", "// <auto-generated />", "// fichier produit par x, ne pas modifier", "// Please don't edit this file directly!", "// Archivo generado automáticamente. No editar.",
        "// Diese Datei wurde automatisch erstellt.", "// Machine written from a.tbl, please leave it alone.", "// generated by x 1.2", "// File generated from schema.graphql", LICENCE + "//\n// Code generated by x. DO NOT EDIT.",
        "import a from './a';\nimport {\n  b,\n} from './b';\n\n// Generated by the x compiler. Source: y.idl",
    ],
)
def test_what_is_a_notice_of_generation(notice):
    body = "export const alpha = beta(gamma);\n" * 5
    assert judged("a/b.ts", notice + "\n" + body) == "generated"
    last = notice.rsplit("\n", 1)[-1]
    assert judged("a/b.ts", body + "\n" + last + "\n") == ("generated" if last.startswith("//") else "")


@pytest.mark.parametrize(
    "comment",
    [
        "// The caller must not modify the slice that is returned; do not modify the slice that is returned", "// The output is generated from templates.", "// This module writes files that are generated from templates", "// unlike the generated stubs, this wrapper is written and kept by hand",
        "// TODO: do not edit the table by hand once x can write it", "// Generates code for the parser", "// kept by hand; do not edit lightly", "// adapted from the old parser", "// Tests for the generated client. Changes to the schema are lost on restart.", "// built from parts", "// Imported from the other package lazily", LICENCE,
        "// Copyright The Acme Authors and contributors", "// Licensed under the Meadow Permissive License 2.", "// Copyright (c) the project team. All rights reserved.", "// see upstream: it is slow", "// automatic retries", "// never change the order",
    ],
)
def test_what_is_no_notice(comment):
    assert judged("a/b.ts", comment + "\n" + "export const alpha = beta(gamma);\n" * 5) == ""


def test_notices_of_origin():
    body = "const alpha = beta(gamma);\n" * 5
    for n in ("Imported from upstream libx@1.2; local patches below.", "Upstream: https://code.libx.example/", "This file is derived from https://x.example/a.js", "Vendored from libx v2", "Ported from libx (release 3)"):
        assert judged("a/b.ts", f"// {n}\n" + body) == "vendored"
    read = provenance.Notices().read
    assert read(["// Copyright (c) 2019-2021, Ann Lee and contributors", "x"]) == ("", "ann lee", True)
    assert read(["// libx - v1.2.3 - all rights held by Ann Lee\r", "x"]) == ("", "ann lee", True)
    assert read(["# SPDX-License-Identifier: X", "# Copyright the project team", "x"]) == ("", None, True)
    assert read(["x", "// Copyright Ann Lee", "y"]) == ("", None, False)


def test_minified_suffix_lowers_the_bars():
    text = "var a=1,b=a+2,c=b*a;function d(e,f){return e+f*a}d(a,b);d(b,c);" + "x=d(a,c);" * 3
    assert judged("lib/a.min.js", text) == judged("lib/a-min.js", text) == judged("lib/a.3f2a9c1d.js", text) == "minified"
    assert judged("lib/a.js", text) == judged("lib/admin.js", text) == judged("lib/min.js", text) == ""
    assert judged("lib/a.min.js", "export function total(items) {\n  return items.length;\n}\n") == ""


def test_foreign_holders(spark):
    lib = {i: code(random.Random(40 + i), f"L{i}") for i in range(4)}
    own = lambda i: code(random.Random(100 + i), f"Own{i}")
    team, ann = "// Copyright (c) Acme Corp\n", "// Copyright (c) Ann Lee and contributors\n"
    rows = [(repo * 100 + i, repo, f"src/f{i}.ts", team + own(repo * 100 + i)) for repo in (1, 2) for i in range(4)]
    rows += [(150, 1, "src/a.ts", ann + lib[0]), (250, 2, "src/b.ts", ann + lib[1]), (300, 3, "src/c.ts", "// Copyright (c) Bob Ray\n" + lib[2]), (350, 3, "src/d.ts", lib[3])]
    df = spark.createDataFrame(rows, "id long, repo long, path string, text string")
    # Acme holds most files of two repositories, Ann few of two, Bob one of one
    assert {tuple(r) for r in provenance.not_handwritten(df, "id", "repo", "path", "text").collect()} == {(150, "vendored"), (250, "vendored")}


def test_walk_excludes_are_evidence(spark):
    lib = code(random.Random(50), "Lib")
    rows = [(1, 1, "libs/a.ts", lib), (2, 2, "stuff/a.ts", lib.replace("return", "return 0 +", 2)), (3, 3, "src/z.ts", code(random.Random(51), "Z")), (4, 1, "libs/own.ts", code(random.Random(52), "Y"))]
    df = spark.createDataFrame(rows, "id long, repo long, path string, text string")
    options = spark.createDataFrame([(0, ["dist/"]), (1, ["libs/", None, "[bad"]), (2, ["stuff/*.ts"]), (3, None)], "repo long, excludes array<string>")
    assert {r["file"] for r in provenance.not_handwritten(df, "id", "repo", "path", "text", options).collect()} == {1, 2}
    assert provenance.not_handwritten(df, "id", "repo", "path", "text").count() == 0
    assert provenance.not_handwritten(df, "id", "repo", "path", "text", options.limit(0)).count() == 0


def test_recall_of_the_bands():
    """Share of copies found by similarity of their line pairs: the signature's estimate and the bands together."""
    rng = np.random.default_rng(9)
    a = np.random.default_rng(7).integers(1, 2**63, provenance.HASHES, dtype=np.uint64) | np.uint64(1)
    recall = {}
    for alike in (0.5, 0.6, 0.7, 0.8, 0.9):
        hits = 0
        for _ in range(400):
            both = round(60 * 2 * alike / (1 + alike))
            words = [f"line number {x} of this text" for x in rng.integers(0, 1 << 40, 120 - both)]
            sets = [set(words[:60]), set(words[60 - both :])]
            sigs = [((np.array([xxhash.xxh64_intdigest(p) for p in s], np.uint64)[:, None] * a) >> np.uint64(32)).min(0) for s in sets]
            same = sigs[0] == sigs[1]
            bands = any(same[k * provenance.ROWS : (k + 1) * provenance.ROWS].all() for k in range(provenance.BANDS))
            hits += bands and same.sum() >= provenance.ALIKE * provenance.HASHES
        recall[alike] = hits / 400
    assert recall[0.5] >= 0.4 and recall[0.6] >= 0.85 and min(recall[x] for x in (0.7, 0.8, 0.9)) >= 0.97, recall


def test_shape():
    assert judged("a.py", "".join(f"_T[{i}] = ({i * 7 % 5}, 3)\n" for i in range(30))) == "generated"
    assert judged("a.ts", "".join(f"export function getName{i}(m) {{\n  return m.f[{i}];\n}}\n" for i in range(20))) == "generated"
    assert judged("a.js", "".join(f"var a{chr(97 + i % 26)}=function(b){{return b<<{i}}};" for i in range(60))) == "minified"
    assert judged("a.ts", "export const x = [\n" + "  12345, 67890, 11111,\n" * 40 + "];\n") == "data"
    assert judged("a.ts", "export const x = ['a', 'b', 'c'];\nexport function f(y) { return x.includes(y); }\n") == ""


def test_copies_across_repositories(spark):
    rng = random.Random(4)
    lib = code(rng, "Lib")
    changed = lib.replace("return", "return 0 +", 2)
    own = [code(rng, f"Own{i}") for i in range(12)]
    rows = [(1, 1, "vendor/lib/a.ts", lib), (1, 1, "vendor/lib/a.ts", lib), (2, 2, "src/util/a.ts", changed), (3, 3, "third_party/lib/b.ts", lib), (4, 4, "vendor/mine.ts", own[0]), (5, None, "x.ts", own[1]), (6, 1, None, own[2]), (7, 2, "e.ts", ""), (8, 2, "n.ts", None)]
    rows += [(10 + i, i % 3, f"src/f{i}.ts", t) for i, t in enumerate(own[3:])]
    df = spark.createDataFrame(rows, "sig long, why long, path string, files string")
    got = {r["file"]: r["why"] for r in provenance.not_handwritten(df, "sig", "why", "path", "files").collect()}
    assert got == {1: "vendored", 2: "vendored", 3: "vendored"}
    assert provenance.not_handwritten(df.limit(0), "sig", "why", "path", "files").count() == 0


def test_a_hot_copy_keeps_all_its_rows(spark):
    lib = code(random.Random(5), "Hot")
    df = spark.createDataFrame([(i, i % 7, f"vendor/h{i}.ts" if i % 2 else f"src/h{i}.ts", lib) for i in range(4000)], "id long, repo long, path string, text string")
    assert provenance.not_handwritten(df, "id", "repo", "path", "text").count() == 4000


def test_every_anchor_of_a_bucket_is_met(spark, monkeypatch):
    """Signatures of which some share a band with many that are not alike, the smallest and the largest repository's among them, against brute force."""
    rng = np.random.default_rng(3)
    fresh = lambda: rng.integers(0, 1 << 32, provenance.HASHES, dtype=np.uint64).astype(np.uint32)
    base, rows = fresh(), []
    for i in range(provenance.BANDS):
        for repo in (1, 9):
            s = fresh()
            s[2 * i : 2 * i + 2] = base[2 * i : 2 * i + 2]
            rows.append((repo, f"vendor/{repo}-{i}.ts", "", True, s))
    noticed, linked = base.copy(), base.copy()
    noticed[[1, 8, 20]] += 1
    linked[[2, 9, 21, 30]] += 1
    rows += [(4, "src/copy.ts", "", False, base), (5, "lib/a.ts", "vendored", True, noticed), (6, "lib/b.ts", "", False, linked), (4, "src/own.ts", "", False, fresh())]
    for _ in range(40):
        s, k = base.copy(), rng.integers(8, 24)
        s[rng.permutation(provenance.HASHES)[:k]] += rng.integers(1, 99, k).astype(np.uint32)
        rows.append((int(rng.integers(2, 9)), "x.ts", "", bool(rng.random() < 0.3), s))
    schema = "file long, repo long, path string, why string, anchor boolean, holder string, licensed boolean, sig binary"
    table = spark.createDataFrame([(i, r, p, w, a, None, False, bytearray(s.tobytes())) for i, (r, p, w, a, s) in enumerate(rows)], schema)
    monkeypatch.setattr(provenance, "evidence", lambda *a: table)
    monkeypatch.setattr(provenance, "BLOCK", 3, raising=False)
    band = lambda x, y: any((x[2 * b : 2 * b + 2] == y[2 * b : 2 * b + 2]).all() for b in range(provenance.BANDS))
    pairs = [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if y[3] and x[0] != y[0] and (x[4] == y[4]).sum() >= 16 and band(x[4], y[4])]
    known = {i for i, x in enumerate(rows) if x[2]} | {i for i, j in pairs if rows[i][2] or rows[j][2] or rows[i][3] and rows[j][3]}
    want = known | {i for i, j in pairs if j in known}
    got = {r["file"] for r in provenance.not_handwritten(table, "file", "repo", "path", "sig").collect()}
    assert got == want and 2 * provenance.BANDS in got


# --- leakage


def test_words():
    text = "<p>The&nbsp;<b>Qui</b>ck br\u200bown,\n> over-\n> taken fox\\nsaid \\u0041BC &amp;amp; __it__ `x_y`.</p>"
    assert leakage.words(text) == "the quick brown overtaken fox said abc it x y".split()
    assert leakage.words(None) == [] == leakage.words(" \n—")


def naive(own, text):
    grams = {tuple(own[i : i + leakage.RUN]) for i in range(len(own) - leakage.RUN + 1)}
    return any(tuple(text[i : i + leakage.RUN]) in grams for i in range(len(text) - leakage.RUN + 1))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_passage(own, text):
    """By the definition: some 30 to 59 own words in a row have four in five in order within twice their length of text."""
    for size in range(leakage.PASSAGE, min(leakage.LONGEST, len(own)) + 1):
        for a in range(len(own) - size + 1):
            part = own[a : a + size]
            for s in range(max(1, len(text) - 2 * size + 1)):
                window = text[s : s + 2 * size]
                if 5 * sum(w in window for w in part) >= 4 * size and 5 * longest_common(part, window) >= 4 * size:
                    return True
    return False


def test_runs_equal_naive_search():
    rng = random.Random(6)
    own = [prose(rng, rng.randint(20, 60)).split() for i in range(30)] + [["solo"], ["two", "words"]]
    search = leakage.WuManber(own)
    texts = []
    for _ in range(300):
        item = rng.randrange(30)
        n = rng.randint(10, 16)
        a = rng.randint(0, max(0, len(own[item]) - n))
        texts.append(prose(rng, rng.randint(0, 30)).split() + own[item][a : a + n] + prose(rng, 20).split())
    texts += [[], ["solo"], own[3], own[3][:12], own[3][:13]]
    runs = {(k, i) for k, t in enumerate(texts) for i, w in enumerate(own) if naive(w, t)}
    got = set(search.leaks(texts))
    assert runs <= got
    assert all(brute_passage(own[i], texts[k]) for k, i in got - runs)
    assert {(0, i) for i, w in enumerate(own) if naive(w, texts[7])} <= set(search.leaks([texts[7]]))
    assert search.leaks([]) == search.leaks([[]]) == search.leaks([["a"], ["b"]]) == []


def damaged(rng, own, size, lost, added):
    """A passage of ``size`` own words of which ``lost`` are dropped or changed, the first and the last not spared, with words added in places."""
    a = rng.randint(0, len(own) - size)
    out = list(own[a : a + size])
    for k in rng.sample(range(size), lost):
        out[k] = None if rng.random() < 0.5 else f"other{rng.randint(0, 99)}"
    for k in sorted(rng.sample(range(size), added), reverse=True):
        out[k] = [out[k], *(f"added{rng.randint(0, 99)}" for _ in range(rng.randint(1, 3)))]
    return [w for x in out for w in (x if isinstance(x, list) else [x]) if w is not None]


def test_damaged_passages_equal_brute_force():
    rng = random.Random(7)
    found = 0
    for round_ in range(60):
        own = prose(rng, rng.choice([30, 34, 41, 60])).split() if round_ % 3 else [f"w{i}" for i in range(60)]
        text = prose(rng, rng.randint(0, 9)).split() + damaged(rng, own, rng.randint(28, len(own)), rng.randint(4, 8), rng.choice([0, 0, 1])) + prose(rng, rng.randint(0, 9)).split()
        expect = brute_passage(own, text)
        number = {w: i + 1 for i, w in enumerate(dict.fromkeys([*own, *text]))}
        assert leakage.passage([number[w] for w in own], [number[w] for w in text]) == expect
        search = leakage.WuManber([own])
        if expect or naive(own, text):
            found += 1
            assert search.leaks([text]) == [(0, 0)], (own, text)
            # whatever is put around a passage, it stays found
            for more in (own[len(own) // 2 :], own[:11], prose(rng, 300).split()):
                assert search.leaks([text + more]) == search.leaks([more + text]) == search.leaks([more + text + more]) == [(0, 0)]
        else:
            assert search.leaks([text]) == []
    assert 15 < found < 55


def test_six_of_thirty_lost_at_any_place():
    own = [f"w{i}" for i in range(30)]
    rng = random.Random(11)
    search = leakage.WuManber([own])
    for lost in [range(6), range(24, 30), (0, 1, 2, 27, 28, 29), (0, 29, 5, 10, 15, 20), (0, 6, 12, 18, 24, 29), *(rng.sample(range(30), 6) for _ in range(200))]:
        text = [w for i, w in enumerate(own) if i not in lost]
        assert search.leaks([text]) == [(0, 0)]
        assert search.leaks([[w if i not in lost else "x" for i, w in enumerate(own)]]) == [(0, 0)]
    short = [w for i, w in enumerate(own) if i % 4]
    assert search.leaks([short]) == []  # 22 of 30
    assert leakage.WuManber([own[:29]]).leaks([own[:6] + own[7:15] + own[16:29]]) == [(0, 0)]  # the run of 13
    assert leakage.WuManber([own[:29]]).leaks([own[:6] + own[7:15] + own[16:26]]) == []  # shorter than a passage


def test_order_counts():
    rng = random.Random(7)
    own = [f"{w}{i}" for i, w in enumerate(prose(rng, 60).split())]
    search = leakage.WuManber([own])
    assert search.leaks([[w for i, w in enumerate(own) if i % 4 < 2]]) == []
    shuffled = [own[i : i + 9] for i in range(0, 60, 9)]
    assert search.leaks([[w for s in reversed(shuffled) for w in s]]) == []


def test_search_tables_stay_small():
    """About fifty bytes a word: a block of two million words stays far under a gigabyte."""
    rng = np.random.default_rng(5)
    own = [[f"t{x}" for x in rng.zipf(1.3, 100) % 200_000] for _ in range(2000)]
    search = leakage.WuManber(own)
    size = sum(x.nbytes for x in (search.text, search.begin, search.item_of, search.at, search.keys, search.shift))
    assert size / 200_000 < 50


def test_own_texts(spark):
    stock = "Pick one of these."
    items = [(1, f" {stock} Alpha beta gamma? Do not guess.  "), (1, f" {stock} Alpha beta gamma? Do not guess.  "), (2, f"{stock} Delta!\nDo not guess."), (3, None), (4, " "), (5, "again"), (6, f"{stock} Do not guess."), (None, "x"), (7, "Own opening. Epsilon. Do not guess."), (8, stock)]
    got = {r["item"]: r["own"] for r in leakage.own_texts(spark.createDataFrame(items, "own long, prompt string"), "own", "prompt").collect()}
    assert got == {1: ["alpha", "beta", "gamma"], 2: ["delta"], 5: ["again"], 7: ["own", "opening", "epsilon"]}


def test_leaks_on_frames(spark, monkeypatch):
    rng = random.Random(8)
    stock = "Pick one of these."
    bodies = [prose(rng, 40) for _ in range(3)]
    items = [(i, f" {stock} {body}. Do not guess.  ") for i, body in enumerate(bodies)] + [(9, None), (10, ""), (0, "zz again")]
    df = spark.createDataFrame(items, "item long, prompt string")
    body = bodies[1].split()
    docs = spark.createDataFrame([(1, "x " + " ".join(body).upper(), 0), (2, stock + " Do not guess.", 0), (3, None, 0), (4, "", 0), (5, "y " * 20000 + " ".join(body[:13]), 0)], "doc long, text string, prompt int")
    assert sorted(tuple(r) for r in leakage.leaks(docs, "doc", "text", df, "item", "prompt").collect()) == [(1, 1), (5, 1)]
    assert leakage.leaks(docs, "doc", "text", df.limit(0), "item", "prompt").count() == 0
    assert leakage.leaks(docs.limit(0), "doc", "text", df, "item", "prompt").count() == 0
    # many blocks, one scan of the documents
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 50)
    many = leakage.leaks(docs, "doc", "text", df, "item", "prompt")
    assert sorted(tuple(r) for r in many.collect()) == [(1, 1), (5, 1)]
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


# --- mixture


def test_thresholds_are_the_distribution():
    t = _thresholds(1.5, 3)
    assert t.tolist() == pytest.approx([0.22313, 0.55783, 0.80885], abs=1e-5)
    assert _thresholds(float("inf"), 2).tolist() == [-1.0, -1.0] and _thresholds(0.0, 2).tolist() == [2.0, 2.0]


def test_mixture_meets_its_shares(spark):
    rng = random.Random(9)
    sized = [(i, rng.choice(["a"] * 8 + ["b"] * 2 + [None]), rng.randint(1, 400)) for i in range(6000)] + [(90000, "tiny", 50), (90001, "other", 70)]
    targets = spark.createDataFrame([("a", "A", 0.5, 1), ("b", "B", 0.3, 3), ("tiny", "T", 0.15, 4), ("none", "N", 0.05, None)], "source string, source_name string, target_share double, max_repeats int")
    m = Mixture(spark.createDataFrame(sized, "id long, source string, tokens long"), "id", "source", targets)
    budget = sum(t for _, _, t in sized)
    rep = {r["source_name"]: r for r in m.report().collect()}
    assert rep["A"]["budget_share"] == pytest.approx(0.5, abs=0.002) and rep["B"]["budget_share"] == pytest.approx(0.3, abs=0.002)
    assert (rep["T"]["tokens_used"], rep["T"]["repeats"]) == (200, 4.0) and rep["N"]["tokens_used"] == 0
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1, abs=1e-5)
    rows = m.documents().collect()
    assert max(r["copy"] for r in rows if r["source"] == "a") == 1 and max(r["copy"] for r in rows) <= 4
    for name, key in (("A", "a"), ("B", "b"), ("T", "tiny")):
        assert sum(r["tokens"] for r in rows if r["source"] == key) == rep[name]["tokens_used"]
    assert abs(rep["A"]["tokens_used"] - 0.5 * budget) <= 400 and {r["source"] for r in rows} == {"a", "b", "tiny"}
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    again = Mixture(spark.createDataFrame(sized[::-1], "id long, source string, tokens long").repartition(7), "id", "source", targets)
    assert [tuple(r) for r in again.documents().collect()] == [tuple(r) for r in rows]


def test_a_rate_of_one_in_a_million_draws_single_documents(spark):
    n = 10**7
    docs = spark.range(n).select("id", F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("source"), F.lit(1).cast("long").alias("tokens"))
    targets = spark.createDataFrame([("large", "L", 1e-6, 1), ("small", "S", 7.3e-7, 5)], "source string, source_name string, target_share double, max_repeats int")
    m = Mixture(docs, "id", "source", targets)
    assert {r["source_name"]: r["tokens_used"] for r in m.report().collect()} == {"L": 10, "S": 7}
    assert m.documents().count() == 17


@pytest.mark.parametrize("share,cap", [(0.02, 1), (0.3, 1), (0.9, 2), (0.999, 4), (0.97, 1)])
def test_the_nearest_draw_is_found(spark, share, cap):
    """As near as whole documents allow: no other mean draws nearer, by trying the draws of every document."""
    rng = random.Random(int(share * 1000))
    sized = [(i, "a" if i < 40 else "b", rng.choice([1, 5, 300, 4000])) for i in range(400)]
    df = spark.createDataFrame(sized, "id long, source string, tokens long")
    budget = sum(t for *_, t in sized)
    targets = spark.createDataFrame([("a", "A", share, cap), ("b", "B", 1 - share, cap)], "source string, source_name string, target_share double, max_repeats int")
    m = Mixture(df, "id", "source", targets)
    used = {r["source_name"]: r["tokens_used"] for r in m.report().collect()}
    u = {r["id"]: r["u"] for r in m.sized.selectExpr("id", f"{_U} as u").collect()}
    levels = [_thresholds(x, cap) for x in [*np.geomspace(1e-4, 60, 3000), float("inf")]]
    for key, name, target in (("a", "A", share * budget), ("b", "B", (1 - share) * budget)):
        v, t = np.array([u[i] for i, k, _ in sized if k == key]), np.array([t for _, k, t in sized if k == key])
        best = min(abs((np.searchsorted(x, v) * t).sum() - target) for x in levels)
        assert abs(used[name] - target) <= best + 1e-6


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", "A", 1.0, 1)], "source string, source_name string, target_share double, max_repeats int")
    m = Mixture(spark.createDataFrame([], "id long, source string, tokens long"), "id", "source", targets)
    assert m.documents().count() == 0 and m.report().first()["tokens_used"] == 0


def test_token_counts(spark):
    from pathlib import Path

    file = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
    if not file.exists():
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "Hello world", "s"), (2, None, "s"), (3, "", None), (4, "<|endoftext|>", "t")], "id long, text string, tokens string")
    assert [(r["id"], r["tokens"]) for r in count_tokens(df.drop("tokens"), "id", "text", str(file)).orderBy("id").collect()] == [(1, 2), (2, 0), (3, 0), (4, 7)]


# --- stuffing

SPAM = [
    "\n".join(f"code map tool {m} near {t}" for m in ("cheap", "best", "free", "top 10", "") for t in ("Lufi", "Tinhal", "Velbra Bay")),
    ", ".join(f"{m} graph viewer online {n}" for m in ("buy", "free", "new", "") for n in ("2031", "discount", "pro", "")),
    "Looking for a graph viewer? This graph viewer is the graph viewer you want, a true graph viewer. Graph viewer fans love graph viewer, and graph viewer beats any other graph viewer. Get your graph viewer today because graph viewer prices and graph viewer offers change. Our graph viewer is the graph viewer that graph viewer users call the best graph viewer. " * 2,
    "\n".join(f"- [{a} {b}](https://{a}{b}.example/tag/{b})" for a in ("late", "dense", "quiet") for b in ("hub", "map", "road", "sink")),
    "#" + " #".join(f"{a}{b}" for a in ("late", "dense", "quiet") for b in ("hub", "map", "road", "sink")),
    "The map shows what is read.\n\nTags: " + ", ".join(f"{a}-{b}" for a in ("late", "dense", "quiet", "flat") for b in ("hub", "map", "road", "sink")),
]
FINE = [
    "A graph viewer reads a repository and draws what it finds. Nobody agreed on what a graph viewer should show when a name cannot be resolved. The first graph viewer we wrote had no layout at all. Two of us tried to replace it and gave up. Whether you need a graph viewer depends on how large the team is.",
    "Files changed:\n" + "\n".join(f"M\tsrc/{a}/{b}_{a}.ts" for a in ("late", "dense") for b in ("hub", "map", "road", "sink")),
    "| symbol | module | calls |\n| --- | --- | --- |\n" + "\n".join(f"| read{a} | api | {i} |" for i, a in enumerate(("Hub", "Map", "Road", "Sink"))),
    "Pinned:\n" + "\n".join(f"late-{b}@1.{i}.0" for i, b in enumerate(("hub", "map", "road", "sink", "arch", "edge"))),
    "\n".join(f"- [{b} notes](https://{b}.example/x) It says why the {b} is kept apart from the rest and what it costs." for b in ("hub", "map", "road", "sink", "arch")),
    "```\nlet a = 1;\n```\nfix: one thing in the parser", "", "...", "hub",
]


def test_stuffed_share():
    assert all(stuffing.stuffed_share(t) > stuffing.SHARE for t in SPAM), [stuffing.stuffed_share(t) for t in SPAM]
    assert all(stuffing.stuffed_share(t) <= stuffing.SHARE for t in FINE), [stuffing.stuffed_share(t) for t in FINE]


def test_stuffed(spark):
    rng = random.Random(10)
    normal = [". ".join(prose(rng, 9).capitalize() for _ in range(rng.randint(3, 12))) + "." for _ in range(200)]
    rows = [(i, t, "en", 0) for i, t in enumerate(SPAM + FINE + normal)] + [(900, None, "en", 0), (901, SPAM[0] * 40, None, 0)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, size int")
    got = {r["id"] for r in stuffing.stuffed(df, "id", "text", "lang").collect()}
    assert got == {*range(len(SPAM)), 901}
    assert stuffing.stuffed(df.limit(0), "id", "text", "lang").count() == 0
    assert stuffing.measure(df, "id", "text", "lang").count() == len(rows)


def test_verdict_needs_both_tests():
    v = stuffing.verdict
    assert v(0.7, 0.1, 0.7, 0.1) is True and v(0.4, 1.2, 0.7, 0.2) is True
    assert v(0.9, 1.0, 0.9, 1.0) is False and v(0.76, 0.66, 0.76, 0.66) is False and v(0.7, 0.5, 0.7, 0.5) is None
    # one test alone: the text is read
    assert v(0.7, 1.0, 0.7, 1.0) is None and v(0.4, 1.0, 0.4, 0.9) is None and v(1.0, 0.1, 1.0, 0.1) is None and v(0.4, 1.0, 0.9, 0.1) is None
    assert v(stuffing.REDUNDANT, stuffing.HARDLY, 9, 9) is True and v(stuffing.EXTREME, 9, stuffing.REDUNDANT, stuffing.FEW) is True


def test_each_test_decides(spark):
    """Prose that recurs is redundant with ordinary density, a version list has few sentences only: either test alone would take them."""
    rng = random.Random(12)
    normal = [". ".join(prose(rng, 9).capitalize() for _ in range(rng.randint(2, 12))) + "." for _ in range(300)]
    versions = "\n".join(f"{rng.choice(WORDS)}-{rng.choice(WORDS)}@{i}.{rng.randint(0, 9)}.0" for i in range(40))
    keywords = " ".join(rng.choice(["best code map", "code map", "free code map", "code map online"]) for _ in range(60))
    paths = "\n".join(f"src/{a}/{a}_{b}.ts" for a in ("late", "dense") for b in ("hub", "map", "road", "sink"))
    texts = {1000: (prose(rng, 9).capitalize() + ". ") * 12, 1001: versions, 1002: keywords, 1003: SPAM[2], 1004: paths}
    df = spark.createDataFrame([(i, t, "en") for i, t in [*enumerate(normal), *texts.items()]], "id long, text string, lang string")
    m = {r["id"]: r for r in stuffing.measure(df, "id", "text", "lang").where("id >= 1000").collect()}
    assert m[1000]["norm"] <= stuffing.EXTREME and m[1000]["density"] > stuffing.FEW
    assert m[1001]["norm"] > stuffing.REDUNDANT and m[1001]["density"] <= stuffing.FEW
    assert m[1002]["norm"] <= stuffing.REDUNDANT and m[1002]["density"] <= stuffing.FEW
    assert m[1003]["norm"] <= stuffing.EXTREME and m[1003]["density"] > stuffing.FEW
    assert m[1004]["norm"] <= stuffing.REDUNDANT and m[1004]["density"] <= stuffing.FEW
    assert {i: r["stuffed_by"] for i, r in m.items() if i != 1003} == {1000: None, 1001: None, 1002: "measures", 1004: None} and m[1003]["stuffed_by"]


def test_fresh_sentences():
    assert stuffing.fresh("One two three four. Five six seven eight.") == ("One two three four. Five six seven eight.", 0.25)
    assert stuffing.fresh("One two three four. One two three four. Four three two one.") == ("One two three four. Four three two one.", 1 / 12)
    assert stuffing.fresh("") == ("", 0) and stuffing.sentence_ends("a b ... . c") == 0
    assert stuffing.sentence_ends('A b. "C d!" E?') == 3 / 5


def test_long_keywords_beside_many_function_words():
    text = "If he or she has it then we do not. You can be at my side as they were on it for us. "
    words = ["infrastructure", "refrigeration", "telecommunication", "transportation", "electrification", "photolithography", "thermodynamics", "crystallography"]
    text += "\n" + ", ".join(w + s for s in ("", "s", "ist", "al", "er") for w in words)
    assert stuffing.stuffed_share(text) > stuffing.SHARE
