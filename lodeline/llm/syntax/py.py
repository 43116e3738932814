"""Lexer of Python with a stack of open brackets; the running interpreter's parser confirms."""

from __future__ import annotations

import ast
import re
import warnings

from lodeline.llm.syntax.base import CLOSES, CONFLICT, NESTED, Fault

_TOKEN = re.compile(
    r"(?P<comment>#[^\r\n]*)"
    r"|(?P<long>(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''))"
    r"|(?P<str>(?:\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<bad>[\"'])",
    re.DOTALL,
)


def lex(text: str) -> str:
    """What the lexer holds against a text: literal, delimiter, conflict or ''."""
    stack: list[str] = []
    marks = [m.start() for m in CONFLICT.finditer(text)] if CONFLICT.search(text) else []
    quoted: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            stack.append(m[0])
        elif kind == "close":
            if not stack or stack.pop() != CLOSES[m[0]]:
                return "delimiter"
        elif kind == "bad":
            return "literal"
        elif kind == "long" and marks:
            quoted.append(m.span())
    if any(not any(a < k < b for a, b in quoted) for k in marks):
        return "conflict"
    return "delimiter" if stack else ""


_PIECE = re.compile(
    r"(?P<skip>#[^\r\n]*|(?P<prefix>\b[a-zA-Z]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'))|(?P<open>[(\[{])|(?P<close>[)\]}])",
    re.DOTALL,
)
#: The interpreter follows some two hundred brackets; inner ones beyond this depth are judged by themselves.
SHALLOW = 40
_OPERAND = re.compile(r"(?:[\w)\]}\"']|^)\s*$")
_KEYWORD = re.compile(r"\b(?:and|or|not|in|is|if|else|lambda|await|yield|return|for|from|async|assert|del|raise|case|match|while|elif|with|as|import)\s*$")


def _group(before: str, inner: str, bracket: str) -> str:
    """A bracket's stand-in of the same kind, after its content has been judged."""
    operand = bool(_OPERAND.search(before)) and not _KEYWORD.search(before) and before.strip() != ""
    closed = {"(": ")", "[": "]", "{": "}"}[bracket]
    tree = _tree(f"{'_' if operand and bracket != '{' else ''}{bracket}{inner}{closed}", "eval").body
    if operand and bracket != "{":
        return f"{bracket}_{closed}"
    targets = (ast.Name, ast.Attribute, ast.Subscript, ast.Starred, ast.Tuple, ast.List)
    target = isinstance(tree, targets) and all(isinstance(x, targets) or isinstance(x, ast.expr_context) for x in ast.walk(tree) if not isinstance(x, ast.Constant))
    if bracket == "{":
        return "{_: _}" if isinstance(tree, (ast.Dict, ast.DictComp)) else "{_}"
    return f"{bracket}{'_' if target else '0'}{closed}"


def _shallow(text: str) -> str:
    """The text with brackets deeper than SHALLOW folded, innermost first; Fault where the content of one is wrong."""
    rows: list[list[str]] = [[]]
    opened: list[str] = []
    at = 0
    for m in _PIECE.finditer(text):
        if m["skip"] is not None:
            continue
        rows[-1].append(text[at : m.start()])
        at = m.end()
        if m["open"]:
            opened.append(m[0])
            if len(opened) > NESTED:
                raise Fault("delimiter")
            rows.append([])
            continue
        if not opened:
            raise Fault("delimiter")
        inner, bracket = "".join(rows.pop()), opened.pop()
        before = rows[-1]
        if len(opened) >= SHALLOW:
            before.append(_group("".join(before[-2:]), inner, bracket))
        else:
            before.append(f"{bracket}{inner}{m[0]}")
    rows[-1].append(text[at:])
    if opened:
        raise Fault("delimiter")
    return _branches(_CHAIN.sub(lambda m: m[1] or m[2], "".join(rows[0])))


_LINE = re.compile(r"([ \t]*)(\w+)?")


def _branches(text: str) -> str:
    """The text with every ``elif`` that follows an ``if`` of its depth begun anew as an ``if``: the parser nests long chains."""
    before: list[tuple[str, str]] = []  # of the open depths, the indent and the word that began the last statement
    out = []
    for line in text.split("\n"):
        m = _LINE.match(line)
        indent, word = m[1], m[2] or ""
        if word:
            while before and len(before[-1][0]) > len(indent):
                before.pop()
            if word == "elif" and before and before[-1] in ((indent, "if"), (indent, "elif")):
                line = indent + line[len(indent) + 2 :]
            if before and before[-1][0] == indent:
                before.pop()
            before.append((indent, word))
        out.append(line)
    return "\n".join(out)


#: Chains of one prefix operator, as long as they like to be, say what one of them says.
_CHAIN = re.compile(r"\b(not[ \t]+)(?:not[ \t]+)+|([-+~][ \t]*)(?:[-+~][ \t]*)+")


def _tree(text: str, mode: str = "exec") -> ast.AST:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text, mode=mode)
        except RecursionError:  # only the tree of a text that parses can be too deep
            return ast.Pass()


def check(text: str) -> None:
    """Raise Fault unless ``text`` is a valid file.

    The lexer's fault is final when the interpreter's parser agrees (a nested quote in a formatted string may mislead the
    lexer); a text that passes the lexer still has to parse. The interpreter gives up where brackets are nested some two hundred deep
    and where its own stack ends; there the brackets are judged from the inside out (``_shallow``). A text that is too deep
    for it otherwise (thousands of nested conditional expressions) is held against the lexer alone.
    """
    if text.startswith("﻿"):
        text = text[1:]
    why = lex(text)
    try:
        _tree(text)
        return
    except MemoryError:
        pass
    except SyntaxError as e:
        if "too many nested parentheses" not in str(e):
            raise Fault(why or "grammar") from None
    except ValueError:
        raise Fault(why or "grammar") from None
    if why:
        raise Fault(why)
    try:
        _tree(_shallow(text))
    except (SyntaxError, ValueError):
        raise Fault("grammar") from None
    except MemoryError:
        return
