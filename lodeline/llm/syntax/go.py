"""Lexer and grammar of Go.

The lexer keeps a stack of open delimiters and puts in the semicolons the language adds at line ends. Names and literals lose
their text; top-level declarations of one shape are parsed once in a worker (the memory is bounded and changes no verdict).
"""

from __future__ import annotations

import re
from functools import lru_cache

from lodeline.llm.syntax.base import CLOSES, CONFLICT, NESTED, Fault, deep

KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
TOKEN = re.compile(
    r"[ \t\r]*(?:(?P<nl>\n+)"
    r"|(?P<comment>//[^\n]*|/\*.*?\*/)"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|`[^`]*`)"
    r"|(?P<rune>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<punct>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.])"
    r"|(?P<eof>\Z))",
    re.DOTALL,
)
_ENDS_LINE = frozenset("ID NUM STR break continue fallthrough return ++ -- ) ] }".split())
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())


def check(text: str) -> None:
    """Raise Fault unless ``text`` is a valid file."""
    if text.startswith("﻿"):
        text = text[1:]
    first = True
    with deep():
        for piece in _pieces(_tokens(text)):
            why = (_verdict if len(piece) <= REMEMBERED else _parse)(piece, first)
            if why:
                raise Fault(why)
            first = False
    if first:
        raise Fault("end")


def _tokens(text: str) -> list[str]:
    conflict = {m.start() for m in CONFLICT.finditer(text)} if CONFLICT.search(text) else ()
    out: list[str] = []
    stack: list[str] = []
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        if m is None:
            c = text[at:].lstrip(" \t\r")[:1]
            raise Fault("literal" if c and c in "\"'`" else "character")
        kind = m.lastgroup
        if kind == "eof":
            break
        token = m[kind]
        at = m.end()
        if kind == "nl" or kind == "comment":
            if out and (kind == "nl" or "\n" in token) and out[-1] in _ENDS_LINE:
                out.append(";")
            continue
        if conflict and m.start(kind) in conflict:
            raise Fault("conflict")
        if kind == "name":
            if token not in KEYWORDS:
                token = "ID"
        elif kind == "num":
            if text[at : at + 1].isalnum() or text[at : at + 1] == "_":
                raise Fault("character")
            token = "NUM"
        elif kind == "str":
            token = "STR"
        elif kind == "rune":
            token = "NUM"
        elif token in "([{":
            stack.append(token)
            if len(stack) > NESTED:
                raise Fault("delimiter")
        elif token in CLOSES:
            if not stack or stack.pop() != CLOSES[token]:
                raise Fault("delimiter")
        elif token == "/" and text.startswith("/*", at - 1):
            raise Fault("literal")
        out.append(token)
    if stack:
        raise Fault("delimiter")
    if out and out[-1] in _ENDS_LINE:
        out.append(";")
    return out


def _pieces(tokens: list[str]):
    """The package clause and each top-level declaration, with the semicolon that ends it."""
    piece: list[str] = []
    depth = 0
    for t in tokens:
        piece.append(t)
        if t in ("(", "[", "{"):
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
        elif t == ";" and not depth:
            yield tuple(piece)
            piece = []
    if piece:
        yield tuple(piece)


#: Longer pieces are not remembered, so the memory of a worker stays within a few tens of megabytes.
REMEMBERED = 1000


def _parse(piece: tuple[str, ...], first: bool) -> str:
    p = _Parser(piece)
    try:
        if first:
            p.need("package")
            p.need("ID")
        else:
            p.top()
        p.end()
    except Fault as f:
        return f.args[0]
    return ""


_verdict = lru_cache(maxsize=1 << 14)(_parse)


class _Parser:
    def __init__(self, piece: tuple[str, ...]):
        self.t = [*piece, "EOF", "EOF", "EOF"]
        self.i = 0
        self.level = 0  # below 0 a brace opens a block, not a composite literal

    def fail(self) -> None:
        raise Fault("end" if self.t[self.i] == "EOF" else "grammar")

    def eat(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if self.t[self.i] != x:
            self.fail()
        self.i += 1

    def end(self) -> None:
        self.need(";")
        if self.t[self.i] != "EOF":
            self.fail()

    def attempt(self, f):  # noqa: ANN001, ANN201
        at, level = self.i, self.level
        try:
            f()
            return True
        except Fault:
            self.i, self.level = at, level
            return False

    # --- declarations
    def top(self) -> None:
        x = self.t[self.i]
        if x == ";":
            return
        if x == "import":
            self.group(self.import_spec)
        elif x == "func":
            self.func_decl()
        else:
            self.declaration()

    def declaration(self) -> None:
        x = self.t[self.i]
        if x == "const":
            self.group(self.const_spec)
        elif x == "var":
            self.group(self.var_spec)
        elif x == "type":
            self.group(self.type_spec)
        else:
            self.fail()

    def group(self, spec) -> None:  # noqa: ANN001
        self.i += 1
        if not self.eat("("):
            spec()
            return
        while not self.eat(")"):
            spec()
            if self.t[self.i] != ")":
                self.need(";")

    def import_spec(self) -> None:
        if self.t[self.i] in ("ID", "."):
            self.i += 1
        self.need("STR")

    def names(self) -> None:
        self.need("ID")
        while self.eat(","):
            self.need("ID")

    def const_spec(self) -> None:
        self.names()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.eat("="):
            self.expressions()
            return
        self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("ID")
        if self.t[self.i] == "[" and self.t[self.i + 1] == "ID" and self.t[self.i + 2] != "]":
            self.attempt(self.type_parameters)
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if self.eat(","):
                if self.eat("]"):
                    return
                continue
            self.need("]")
            return

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def func_decl(self) -> None:
        self.need("func")
        if self.t[self.i] == "(":
            self.parameters()
        self.need("ID")
        if self.t[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.t[self.i] == "{":
            self.body()

    def signature(self) -> None:
        self.parameters()
        x = self.t[self.i]
        if x == "(":
            self.parameters()
        elif x in ("ID", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        """Types alone or names with types, a last one variadic."""
        self.need("(")
        while not self.eat(")"):
            if self.eat("..."):
                self.type()
            else:
                self.type()
                if self.t[self.i] not in (",", ")"):
                    if self.t[self.i - 1] != "ID":
                        self.fail()
                    self.eat("...")
                    self.type()
            if self.t[self.i] != ")":
                self.need(",")

    # --- types
    def type(self) -> None:
        x = self.t[self.i]
        if x == "ID":
            self.i += 1
            if self.eat("."):
                self.need("ID")
            if self.t[self.i] == "[" and self.t[self.i + 1] != "]":
                self.attempt(self.type_arguments)
        elif x == "*":
            self.i += 1
            self.type()
        elif x == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif x == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.inside(self.expression)
                self.need("]")
            self.type()
        elif x == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif x == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif x == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif x == "func":
            self.i += 1
            self.signature()
        elif x == "struct":
            self.struct()
        elif x == "interface":
            self.interface()
        else:
            self.fail()

    def type_arguments(self) -> None:
        self.need("[")
        while True:
            self.type()
            if self.eat("]"):
                return
            self.need(",")
            if self.eat("]"):
                return

    def struct(self) -> None:
        self.need("struct")
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "*":
                self.type()
            elif self.t[self.i] == "ID" and self.t[self.i + 1] in (";", "}", ".", "STR"):
                self.type()
            else:
                self.names()
                self.type()
            self.eat("STR")
            if self.t[self.i] != "}":
                self.need(";")

    def interface(self) -> None:
        self.need("interface")
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "ID" and self.t[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            if self.t[self.i] != "}":
                self.need(";")

    # --- statements
    def inside(self, f) -> None:  # noqa: ANN001
        keep, self.level = self.level, 0
        f()
        self.level = keep

    def body(self) -> None:
        keep, self.level = self.level, 0
        self.block()
        self.level = keep

    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.need("}")

    def statements(self, *ends: str) -> None:
        while self.t[self.i] not in ends:
            if self.t[self.i] == "EOF":
                self.fail()
            self.statement()
            if self.t[self.i] not in ends:
                self.need(";")

    def statement(self) -> None:
        x = self.t[self.i]
        if x in ("const", "var", "type"):
            self.declaration()
        elif x == "{":
            self.block()
        elif x == ";" or x == "}":
            return
        elif x == "if":
            self.if_()
        elif x == "for":
            self.for_()
        elif x == "switch":
            self.switch()
        elif x == "select":
            self.select()
        elif x in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.t[self.i - 1] != ")":
                self.fail()
        elif x == "return":
            self.i += 1
            if self.t[self.i] not in (";", "}"):
                self.expressions()
        elif x in ("break", "continue"):
            self.i += 1
            self.eat("ID")
        elif x == "goto":
            self.i += 1
            self.need("ID")
        elif x == "fallthrough":
            self.i += 1
        elif x == "ID" and self.t[self.i + 1] == ":":
            self.i += 2
            if self.t[self.i] not in ("}", "case", "default"):
                self.statement()
        else:
            self.simple()

    def simple(self, ranging: bool = False) -> bool:
        """A simple statement; whether it is a range clause."""
        if ranging and self.eat("range"):
            self.expression()
            return True
        count = self.expressions()
        x = self.t[self.i]
        if x == ":=" or x in _ASSIGN:
            self.i += 1
            if ranging and x in (":=", "=") and self.eat("range"):
                self.expression()
                return True
            self.expressions()
        elif x in ("++", "--"):
            if count > 1:
                self.fail()
            self.i += 1
        elif x == "<-":
            self.i += 1
            self.expression()
        elif count > 1:
            self.fail()
        return False

    def header(self) -> None:
        """What stands between the keyword and the block of if and switch."""
        keep, self.level = self.level, -1
        if self.t[self.i] not in (";", "{"):
            self.simple()
        if self.eat(";") and self.t[self.i] != "{":
            self.simple()
        self.level = keep

    def if_(self) -> None:
        self.need("if")
        if self.t[self.i] == "{":
            self.fail()
        keep, self.level = self.level, -1
        if self.t[self.i] != ";":
            self.simple()
        if self.eat(";"):
            if self.t[self.i] == "{":
                self.fail()
            self.simple()
        self.level = keep
        self.block()
        if self.eat("else"):
            if self.t[self.i] == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")
        keep, self.level = self.level, -1
        if self.t[self.i] != "{":
            ranged = False
            if self.t[self.i] != ";":
                ranged = self.simple(ranging=True)
            if not ranged and self.eat(";"):
                if self.t[self.i] != ";":
                    self.simple()
                self.need(";")
                if self.t[self.i] != "{":
                    self.simple()
        self.level = keep
        self.block()

    def switch(self) -> None:
        self.need("switch")
        self.header()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.inside(self.case_list)
            else:
                self.need("default")
            self.need(":")
            self.statements("case", "default", "}")

    def case_list(self) -> None:
        while True:
            self.expression()
            if not self.eat(","):
                return

    def select(self) -> None:
        self.need("select")
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.inside(self.simple)
            else:
                self.need("default")
            self.need(":")
            self.statements("case", "default", "}")

    # --- expressions
    def expressions(self) -> int:
        n = 1
        self.expression()
        while self.eat(","):
            self.expression()
            n += 1
        return n

    def expression(self) -> None:
        self.unary()
        while self.t[self.i] in _BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        x = self.t[self.i]
        if x in ("+", "-", "!", "^", "*", "&", "~"):
            self.i += 1
            self.unary()
        elif x == "<-":
            self.i += 1
            if self.t[self.i] == "chan":
                self.i -= 1
                self.type()
                self.suffixes(True)
            else:
                self.unary()
        else:
            self.primary()

    def primary(self) -> None:
        x = self.t[self.i]
        typed = False
        if x == "ID":
            self.i += 1
            typed = True
        elif x in ("NUM", "STR"):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.inside(self.expression)
            self.need(")")
        elif x == "func":
            self.i += 1
            self.signature()
            if self.t[self.i] == "{":
                self.body()
        elif x in ("[", "map", "struct"):
            self.type()
            if self.t[self.i] not in ("{", "(", ")", ",", "]", ";", ":", "}"):
                self.fail()
            if self.t[self.i] == "{":
                self.literal()
        elif x in ("chan", "interface"):
            self.type()
        else:
            self.fail()
        self.suffixes(typed)

    def suffixes(self, typed: bool) -> None:
        while True:
            x = self.t[self.i]
            if x == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    typed = False
                else:
                    self.need("ID")
            elif x == "[":
                self.i += 1
                self.inside(self.index)
                self.need("]")
            elif x == "(":
                self.inside(self.arguments)
                typed = False
            elif x == "{" and typed and self.level >= 0:
                self.literal()
                typed = False
            else:
                return

    def index(self) -> None:
        """An index, a slice or type arguments."""
        if self.t[self.i] != ":":
            self.expression()
            while self.eat(","):
                if self.t[self.i] == "]":
                    return
                self.expression()
        colons = 0
        while self.eat(":"):
            colons += 1
            if self.t[self.i] not in (":", "]"):
                self.expression()
            elif colons == 2:
                self.fail()
        if colons > 2:
            self.fail()

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.expression()
            self.eat("...")
            if self.t[self.i] != ")":
                self.need(",")

    def literal(self) -> None:
        self.need("{")
        self.inside(self.elements)
        self.need("}")

    def elements(self) -> None:
        while self.t[self.i] != "}":
            self.element()
            if self.eat(":"):
                self.element()
            if self.t[self.i] != "}":
                self.need(",")

    def element(self) -> None:
        if self.t[self.i] == "{":
            self.literal()
        else:
            self.expression()
