"""Valid and invalid texts of every language; the operator on awkward rows."""

import pytest

from lodeline.llm.validity import fault, judged, rates

VALID = {
    "ts": [
        "", "// only a comment", "#!/usr/bin/env node\nlet a = 1\n", "\ufeffconst a: number = 1;",
        "export function f<T extends { a: number }>(x: readonly [T, string?], ...r: number[]): x is [T] { return true; }",
        "abstract class A<T> extends B<T> implements C, D.E { private readonly x: T[] = []; constructor(protected y = 1, public z?: string) { super(); } abstract m(a: T): void; get v(): T { return this.x[0]!; } static { } [k: string]: unknown; declare w: T; }",
        "type M<T> = { readonly [K in keyof T as `x${string & K}`]?: T[K] extends (infer U)[] ? U : never };\ntype F = new (...a: any[]) => object; type G = typeof import('./x').y;",
        "enum E { A = 1, B = 'x'.length, 'c-d' }\ndeclare module 'm' { export const q: unique symbol; }\nnamespace N.O { let a = <number>b; }",
        "const f = async <T,>(a: T): Promise<Map<string, T[]>> => { await g<T>(a); for await (const x of y) { } return new Map<string, T[]>(); };",
        "const a = b as const satisfies C;\nlet c = d ? (e) : (f): g => h;\nlet x = a < b, y = c > d;\nlet z = a >> b >>> c;\na >>= 1; b >>>= 2; if (a >= b) c()",
        "function f(this: Window, a?: number): asserts a is number;\nfunction f(): void {}\nexport type { A } from './a'; import type B, { type C as D } from './b';\nimport x = require('x'); export = x;",
        "label: for (const [a, { b = 1, ...c }] of d) { if (!a) continue label; }\nconst r = /[/\\]]+/giu.test(s) ? `a${`b${c}`}d` : x / y / z;",
        "let o = { get a() { return 1 }, set a(v) { }, async *g() { yield* h() }, [k]: 1, 'q': 2, 3: 4, async, get, if: 1, ...r };",
        "({ a = 1, b: { c } } = d);\n[x, y] = [y, x];\nconst f = ({ a = 1 }, [b]) => a;\nvar v = a?.b?.[c]?.(d) ?? e;\nx = a ? b : c ? d : e",
        "// <<<<<<< HEAD\nconst s = `\n=======\n`;\n/*\n>>>>>>> x\n*/",
    ],
    "tsx": [
        "const A = <T,>(p: P<T>) => <div {...p} a-b=\"x\" on={() => <i>{p.x}</i>}>text &amp; {/* c */}<B.C/> {list.map((x) => <li key={x}>{x}</li>)}</div>;",
        "export default () => (<>\n  it's <b>fine</b>\n</>);", "const x = a < b && c > d;",
    ],
    "mjs": ["export * as ns from './x';\nimport d, * as n from 'y';\nconst x = await f();\nexport default class { #p = 1; static async *#m() {} has(o) { return #p in o; } }", "let a\n++b\nvar c = function* () { yield\n1 }"],
    "jsx": ["const a = cond ? <A b='c' /> : <></>;\nfunction f() { return <p>{`t${1}`}</p> }"],
    "cjs": ["'use strict'\nconst x = require('x');\nmodule.exports = { x };\nreturn;", "var await = 1; with (a) { b }", "let x = 010;"],
    "go": [
        "package main", "\ufeffpackage a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\nfunc (r *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[K{}.a]; ok && (T{1} == v) {\n\t\treturn\n\t}\n\tfor i := range xs { go func() { ch <- i }() }\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\treturn a[1:2:3], nil\n}",
        "package p\ntype S[T any, U ~int | ~string] struct {\n\tE\n\t*F\n\tp.G\n\ta, b int `json:\"a\"`\n\tf func(int) (string, error)\n}\ntype I interface {\n\tM(x int) error\n\t~int | string\n}\nconst (\n\tA = iota\n\tB\n)\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nvar y = [...]struct{ a int }{{1}, {a: 2}}\nvar r = `\n<<<<<<< HEAD\n`",
    ],
    "py": ["", "x = f\"{a['b']!r:>{w}}\"\nmatch x:\n    case {'a': [1, *_]}: pass\n", "# <<<<<<<\ns = '''\n=======\n'''\n", "\ufeff#!/usr/bin/python\ndef f(a, /, b, *, c: int = 1) -> None: ...\n", "async def f():\n\tasync with a as b, c: await d\n"],
}
INVALID = {
    "ts": ["const a = ;", "let a = 'x", "let a = `x${b", "f(1, 2", "}", "function f( {", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "const a = “x”;", "if (a) { b(&#39;x&#39;) }", "1 | import x", "export const a = 1;\n:wq\n", "interface A { b c }", "return 1;", "class A { m( { } }", "let x = <b>hi</b>;", "const a = {a: 1,, b: 2}", "package x\n\nimport (", "def f():\n    pass", "{% if x %}\nlet a = 1", "const x = 08.5;", "a = b c"],
    "tsx": ["const a = <div><b></div>;", "const a = <div>{x</div>;", "const a = <div>a > b</div>;", "const a = <div>\n=======\n</div>;", "const f = <T>(x: T) => x;"],
    "mjs": ["let a: number = 1;", "interface A {}", "const a = b as C;", "const x = <A/>;", "with (a) {}", "function f() { await x; }", "enum A { B }", "return", "new Map<string, number>()", "({ a = 1 })", "const a;"],
    "cjs": ["import a from 'b'", "export const a = 1", "await x"],
    "go": ["", "// only a comment", "package", "package a\nfunc f() {", "package a\nx := 1", "package a\nvar s = \"a", "package a\nfunc f() { if x { } else y }", "package a\n<<<<<<< HEAD\n", "package a\nfunc f() { a b }", "   1 package a", "package a\nvar x = 'ab'"],
    "py": ["def f(:\n  pass", "x = 'a", "if x:\n", "a = (1", "print 'x'", "<<<<<<< HEAD\nx = 1\n", "\tx = 1\n  y = 2", "x = ‘a’", "let a = 1;", "   1 import x"],
}


@pytest.mark.parametrize("dialect,text", [(d, t) for d, ts in VALID.items() for t in ts])
def test_valid(dialect, text):
    assert fault(text, dialect) is None


@pytest.mark.parametrize("dialect,text", [(d, t) for d, ts in INVALID.items() for t in ts])
def test_invalid(dialect, text):
    assert fault(text, dialect) is not None


def test_line_ends_do_not_matter():
    for dialect, texts in VALID.items():
        for t in texts:
            assert fault(t.replace("\n", "\r\n"), dialect) is None, t


def test_long_and_deep_texts():
    assert fault("let a = 1;\n" * 20000, "ts") is None
    assert fault("x = 1\n" * 50000, "py") is None
    fault("(" * 3000 + ")" * 3000, "ts")
    assert fault("[" * 5000, "go") == "delimiter"


DEEP = 10_000


def nested(before, opens, inner, closes, after=""):
    return before + opens * DEEP + inner + closes * DEEP + after


@pytest.mark.parametrize(
    "dialect,before,opens,inner,closes,after,wrong",
    [
        ("ts", "x = ", "(", "1", ")", ";", "1 1"), ("mjs", "x = ", "[", "1", "]", ";", "1 1"), ("ts", "x = ", "{a: ", "1", "}", ";", "1 1"), ("cjs", "x = ", "f(", "1", ")", ";", "1 1"),
        ("ts", "", "if (a) {", "b();", "}", "", "b c"), ("ts", "x = ", "(a) => {", "1", "}", ";", "1 1"), ("ts", "type A = ", "(", "B", ")", ";", "B C"), ("ts", "x = ", "`${", "1", "}`", ";", "1 1"),
        ("tsx", "x = ", "<a>", "t", "</a>", ";", "}"), ("jsx", "x = ", "<a>{", "t", "}</a>", ";", "t t"), ("mjs", "x = ", "! ", "1", "", ";", ""), ("ts", "x = ", "a ? b : ", "1", "", ";", ""), ("ts", "x = ", "a => ", "1", "", ";", ""),
        ("go", "package a\nvar x = ", "(", "1", ")", "\n", "1 1"), ("go", "package a\nvar x = T", "{", "1", "}", "\n", "1 1"), ("go", "package a\nfunc f() {", "if a {", "b()", "}", "}\n", "b c"), ("go", "package a\nvar x = ", "- ", "1", "", "\n", ""),
        ("py", "x = ", "(", "1", ")", "\n", "1 1"), ("py", "x = ", "[", "1, 2", "]", "\n", "1 2"), ("py", "x = ", "f(", "a=1", ")", "\n", "a=1, 2"), ("py", "x = ", "{1: ", "2", "}", "\n", "2 2"), ("py", "", "(", "x", ")", " = 1\n", "x + 1"), ("py", "x = ", "not ", "1", "", "\n", ""),
        ("py", "x = ", "[(f(-", "1", "))]", "\n", "1 1"), ("py", "x = a", "[", "b", "]", "\n", "b c"), ("py", "", "if a: pass\nel", "if b: pass", "", "\n", "if b pass"),
    ],
)
def test_ten_thousand_deep(dialect, before, opens, inner, closes, after, wrong):
    assert fault(nested(before, opens, inner, closes, after), dialect) is None
    assert fault(nested(before, opens, wrong, closes, after), dialect) is not None
    if closes:
        assert fault(nested(before, opens, inner, closes, " + ") if after != " = 1\n" else nested(before, opens, inner, closes, " = "), dialect) is not None or not closes.endswith((")", "]"))


def test_deeper_than_any_compiler_is_a_fault():
    n = 100_001
    for dialect, head in (("ts", "x = "), ("go", "package a\nvar x = "), ("py", "x = ")):
        assert fault(head + "(" * n + "1" + ")" * n + "\n", dialect) == "delimiter"


def test_operator(spark):
    data = [
        (1, 1, "a.ts", "let a = 1", 0), (1, 1, "a.ts", "let a = 1", 0), (2, 1, "b.TS", "let a = ", 0), (3, 1, "c.json", "{", 0), (4, 2, "d.py", None, 0), (None, 2, "e.py", "x = (", 0),
        (5, 2, None, "x", 0), (6, None, "f.go", "", 0), (7, 2, "g.pyi", "", 0),
    ]
    df = spark.createDataFrame(data, "id long, repo long, path string, fault string, ext int")
    got = {r["file"]: r["fault"] for r in judged(df, "id", "repo", "path", "fault").collect()}
    assert got == {1: None, 2: "end", 6: "end", 7: None}
    dropped = spark.createDataFrame([(90, 2, "x/y.min.py"), (90, 2, "x/y.min.py"), (91, 3, "z.tsx"), (92, 3, "z.rs")], "id long, repo long, path string")
    r = {(x["repo"], x["language"]): (x["judged"], x["invalid"], x["never_read"], x["invalid_share"]) for x in rates(df, dropped, "id", "repo", "path", "fault").collect()}
    assert r == {(1, "typescript"): (2, 1, 0, 0.5), (2, "python"): (1, 0, 1, 0.0), (3, "typescript"): (0, 0, 1, None), (None, "go"): (1, 1, 0, 1.0)}
    assert judged(df.limit(0), "id", "repo", "path", "fault").count() == 0
