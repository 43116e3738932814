"""Imports and exported names of source texts.

A mask blanks comments and literals without moving anything, keeping a table of the literals; patterns run over the mask, so
nothing inside a comment or a string is taken for code. In scripts a slash opens a regular expression where a value may begin, and the
code in a template's holes stays code. Python is read by logical lines and statements, so continued lines and several statements on a line
are seen. Texts go through Arrow batches, a batch at a time, and no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.languages import language
from lodeline.session import spread

_ES = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<tick>`)|(?P<slash>/)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<name>[\w$]+)|(?P<other>\+\+|--|[^\s\w$])",
    re.DOTALL,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words that a value follows, so that a slash after them opens a regular expression.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
#: Parentheses after these words hold a condition, and a statement may begin behind them.
_CONDITION = frozenset("if while for with".split())
_GO = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|`[^`]*`", re.DOTALL)
_PY = re.compile(r"#[^\n]*|\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.DOTALL)
_SOLID = re.compile(r"[^\n]")


def _mask_es(text: str) -> tuple[str, dict[int, str]]:
    literals: dict[int, str] = {}
    out: list[str] = []
    at, n = 0, len(text)
    stack: list[tuple[str, bool]] = []  # open brackets; with a parenthesis, whether it holds a condition
    last, value = "", False  # the last word or sign, and whether a value ends with it

    def literal(end: int) -> None:
        nonlocal at
        body = _SOLID.sub(" ", text[at:end])
        out.append('"' + body[1:-1] + '"' if end - at > 1 else '"')
        at = end

    def template(end: int) -> int:
        """From inside a template to its end or its next hole."""
        nonlocal at
        stop = _TEMPLATE.match(text, end).end()
        if text.startswith("${", stop):
            out.append(_SOLID.sub(" ", text[at : stop + 1]) + "{")
            stack.append(("`", False))
            at = stop + 2
        else:
            out.append(_SOLID.sub(" ", text[at:stop]) + ('"' if stop < n else ""))
            at = min(n, stop + 1)
        return at

    while at < n:
        m = _ES.search(text, at)
        if m is None:
            break
        out.append(text[at : m.start()])
        at, kind, token = m.start(), m.lastgroup, m[0]
        if kind == "skip":
            out.append(_SOLID.sub(" ", token))
            at = m.end()
            continue
        if kind == "text":
            closed = len(token) > 1 and token[-1] == token[0]
            literals[at] = token[1:-1] if closed else ""
            literal(m.end())
            last, value = '"', True
        elif kind == "tick":
            stop = _TEMPLATE.match(text, at + 1).end()
            if stop < n and text[stop] == "`":
                literals[at] = text[at + 1 : stop]
                literal(stop + 1)
                last, value = '"', True
            else:
                out.append(" ")
                at += 1
                template(at)
                last, value = "{", False
        elif kind == "slash":
            r = None if value else _REGEX.match(text, at)
            if r:
                out.append(" " * len(r[0]))
                at = r.end()
                last, value = '"', True
            else:
                out.append("/")
                at += 1
                last, value = "/", False
        else:
            out.append(token)
            at = m.end()
            if kind == "open":
                stack.append((token, last in _CONDITION))
                value = False
            elif kind == "close":
                opened, condition = stack.pop() if stack else (token, False)
                if opened == "`" and token == "}":
                    template(at)
                    value = not stack or stack[-1][0] != "`"
                else:
                    # a block's end lets a statement begin; an object's is a value, but a regular expression hardly follows either
                    value = token == "]" or token == ")" and not condition
            elif kind == "name":
                value = token not in _BEFORE_VALUE or last == "."
            elif token not in ("++", "--"):
                value = False
            last = token
    out.append(text[at:])
    return "".join(out), literals


def mask(text: str, lang: str) -> tuple[str, dict[int, str]]:
    """The text with comments and literals blanked (line breaks stay, quotes become ``"``), and each literal by its place."""
    if lang not in ("py", "go"):
        return _mask_es(text)
    literals: dict[int, str] = {}

    def blank(m: re.Match) -> str:
        t = m[0]
        body = _SOLID.sub(" ", t)
        if t[0] in "\"'`":
            quote = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
            literals[m.start()] = t[quote:-quote] if len(t) >= 2 * quote else ""
            return '"' + body[1:-1] + '"' if len(t) > 1 else '"'
        return body

    return {"py": _PY, "go": _GO}[lang].sub(blank, text), literals


_STEP = re.compile(r"[(\[{]|[)\]}]|\\\r?\n|\n|;|:")
_COMPOUND = re.compile(r"\s*(?:if|elif|else|try|except|finally|for|while|with|class|def|async|match|case)\b")


def statements(masked: str) -> Iterator[tuple[int, str]]:
    """Python's simple statements with their places: logical lines, cut at semicolons and behind the colon of a compound statement's head."""
    depth, begin, parts = 0, 0, []
    at = 0

    def done(end: int) -> tuple[int, str]:
        return begin, "".join([*parts, masked[at:end]])

    for m in _STEP.finditer(masked):
        x = m[0]
        if x in "([{":
            depth += 1
        elif x in ")]}":
            depth = max(0, depth - 1)
        elif x[0] == "\\":
            parts.append(masked[at : m.start()] + " ")
            at = m.end()
        elif not depth and (x in "\n;" or x == ":" and _COMPOUND.match("".join([*parts, masked[at : m.start()]]))):
            yield done(m.start())
            begin = at = m.end()
            parts = []
    yield done(len(masked))


_ES_FROM = re.compile(r"(?<![\w$.])(import|export)(\s+type)?\b(?!\s*[(.=])([\w\s{},*$]*?)\bfrom\s*\"")
_ES_BARE = re.compile(r"(?<![\w$.])import\s*\"")
_ES_CALL = re.compile(r"(?<![\w$.])(import|require)\s*\(\s*(\"[^\"]*\"\s*[,)])?")
_ES_EXPORT = re.compile(r"(?<![\w$.])export\s+(?:declare\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum|namespace)\s+([\w$]+)")
_ES_LIST = re.compile(r"(?<![\w$.])export\s*(?:type\s*)?\{([^}]*)\}")
_GO_BLOCK = re.compile(r"^import\s*\(([^)]*)\)", re.MULTILINE)
_GO_ONE = re.compile(r"^import\s+(?:[\w.]+\s+)?\"", re.MULTILINE)
_GO_EXPORT = re.compile(r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Z]\w*)", re.MULTILINE)
_GO_NAMES = re.compile(r"^(?:var|const)\s+((?:\w+\s*,\s*)*\w+)", re.MULTILINE)
_GO_GROUP = re.compile(r"^(?:var|const|type)\s*\(", re.MULTILINE)
_GO_MEMBER = re.compile(r"\s*((?:\w+\s*,\s*)*\w+)")
_PY_FROM = re.compile(r"\s*from\s*(\.*(?:\s*\.)*)\s*([\w.]*)\s*\bimport\b\s*\(?([^)]*)\)?\s*$")
_PY_IMPORT = re.compile(r"\s*import\s+(.*)$", re.DOTALL)
_PY_MODULE = re.compile(r"(?<![\w])(?:importlib\.)?import_module\s*\(\s*\"[^\"]*\"")
_PY_EXPORT = re.compile(r"^(?:async\s+def|def|class)\s+([^\W\d_]\w*)|^([^\W\d_]\w*)\s*(?::[^=\n]+)?=(?!=)", re.MULTILINE)


def _go_grouped(masked: str) -> Iterator[str]:
    """Exported names of grouped declarations: those that begin a line of the group itself."""
    for m in _GO_GROUP.finditer(masked):
        depth, at, fresh = 1, m.end(), True
        while at < len(masked) and depth:
            x = masked[at]
            if fresh and depth == 1 and (member := _GO_MEMBER.match(masked, at)) and x not in ")\n":
                yield from (n for n in re.findall(r"\w+", member[1]) if n[0].isupper())
                at, fresh = member.end(), False
                continue
            depth += (x in "([{") - (x in ")]}")
            fresh = x in "\n;" or fresh and x.isspace()
            at += 1


def scan(text: str, lang: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Imports as ``(kind, specifier)`` in order of appearance, and the sorted exported names.

    A computed import has the kind ``computed`` and an empty specifier; ``export * from`` adds the name ``*``.
    """
    masked, literal = mask(text, lang)
    found: list[tuple[int, str, str]] = []
    names: set[str] = set()
    if lang == "py":
        for at, statement in statements(masked):
            m = _PY_FROM.match(statement)
            if m:
                items = [x.split(" as ")[0].strip() for x in " ".join(m[3].split()).split(",")]
                dots = "".join(m[1].split())
                found += [(at, "from", f"{dots}{m[2]}:{x}") for x in items if x]
                continue
            m = _PY_IMPORT.match(statement)
            if m:
                found += [(at, "import", x) for x in ("".join(y.split(" as ")[0].split()) for y in " ".join(m[1].split()).split(",")) if x]
        for m in _PY_MODULE.finditer(masked):
            found.append((m.start(), "dynamic", literal.get(masked.index('"', m.start()), "")))
        names |= {a or b for a, b in _PY_EXPORT.findall(masked)}
    elif lang == "go":
        for m in _GO_BLOCK.finditer(masked):
            found += [(k, "import", v) for k, v in literal.items() if m.start() < k < m.end()]
        found += [(m.end() - 1, "import", literal.get(m.end() - 1, "")) for m in _GO_ONE.finditer(masked)]
        names |= set(_GO_EXPORT.findall(masked)) | {x for m in _GO_NAMES.findall(masked) for x in re.findall(r"\w+", m) if x[0].isupper()}
        names |= set(_go_grouped(masked))
    else:
        for m in _ES_FROM.finditer(masked):
            kind = "type" if m[2] else "reexport" if m[1] == "export" else "import"
            found.append((m.start(), kind, literal.get(m.end() - 1, "")))
            if m[1] == "export" and m[3].strip() == "*":
                names.add("*")
        found += [(m.start(), "import", literal.get(m.end() - 1, "")) for m in _ES_BARE.finditer(masked)]
        for m in _ES_CALL.finditer(masked):
            kind = "require" if m[1] == "require" else "dynamic"
            # what is computed cannot be known, and is kept as such
            found.append((m.start(), kind if m[2] else "computed", literal.get(masked.index('"', m.start()), "") if m[2] else ""))
        names |= set(_ES_EXPORT.findall(masked))
        for body in _ES_LIST.findall(masked):
            names |= {x.split(" as ")[-1].strip().removeprefix("type ") for x in body.split(",") if x.strip()}
        if re.search(r"(?<![\w$.])export\s+default\b", masked):
            names.add("default")
    return [(k, s) for _, k, s in sorted(found, key=lambda f: f[0])], sorted(names)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        refs, names = [], []
        for text, lang in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            r, n = scan(text, lang)
            refs.append([{"kind": k, "specifier": s} for k, s in r])
            names.append(n)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("specifier", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(refs, kind), pa.array(names, pa.list_(pa.string()))], ["repo_id", "path", "lang", "refs", "names"])


def scan_files(files: DataFrame, text: str = "source_text") -> DataFrame:
    """``repo_id, path, lang, refs, names`` of the files that can be scanned; null texts and other languages are left out."""
    rows = files.select("repo_id", "path", text, language("path").alias("lang")).where(F.col(text).isNotNull() & F.col("lang").isin("ts", "js", "go", "py"))
    return spread(rows).mapInArrow(_run, "repo_id long, path string, lang string, refs array<struct<kind:string,specifier:string>>, names array<string>")
