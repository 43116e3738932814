"""Grammar of ECMAScript modules, CommonJS scripts and TypeScript over the lexer's normalised tokens.

A file is cut into top-level pieces where no statement can cross, and the verdict on a piece is remembered by its token
sequence: pieces of one shape are parsed once in a worker. The memory is bounded and changes no verdict.
"""

from __future__ import annotations

from functools import lru_cache

from lodeline.llm.syntax.base import NESTED, Fault, deep
from lodeline.llm.syntax.eslex import CONTEXTUAL, KEYWORDS, pieces

_NAMES = CONTEXTUAL | {"ID"}
_PROPERTY = _NAMES | KEYWORDS
_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** == != === !== < <= << & | ^ && || ?? instanceof in".split())
_UNARY = frozenset("delete void typeof + - ~ !".split())
_MODIFIERS = frozenset("public private protected readonly abstract override declare static accessor".split())
#: What may follow type arguments in an expression.
_AFTER_ARGUMENTS = frozenset("( TPL TH ) ] : ; , ? . ?. == === != !== && || ?? ^ | & } J] J, EOF".split())


def check(text: str, dialect: str) -> None:
    """Raise Fault unless ``text`` is a valid file; dialects: ts, tsx, mjs, jsx (modules), cjs."""
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!"):
        cut = min((k for k in (text.find("\n"), text.find("\r")) if k >= 0), default=len(text))
        text = text[cut:]
    ts = dialect in ("ts", "tsx")
    with deep():
        for piece in pieces(text, dialect in ("tsx", "jsx"), ts):
            why = (_verdict if len(piece) <= REMEMBERED else _parse)(piece, dialect)
            if why:
                raise Fault(why)


#: Longer pieces are not remembered, so the memory of a worker stays within a few tens of megabytes.
REMEMBERED = 1000


def _parse(piece: tuple[str, ...], dialect: str) -> str:
    try:
        _Parser(piece, dialect).program()
    except Fault as f:
        return f.args[0]
    return ""


_verdict = lru_cache(maxsize=1 << 14)(_parse)


class _Parser:
    def __init__(self, piece: tuple[str, ...], dialect: str):
        t: list[str] = []
        self.nl: list[bool] = []
        new = False
        for x in piece:
            if x == "\n":
                new = True
                continue
            t.append(x)
            self.nl.append(new)
            new = False
        t.append("EOF")
        self.nl.append(True)
        self.t, self.i = t, 0
        self.ts = dialect in ("ts", "tsx")
        self.tsx = dialect == "tsx"
        self.module = dialect != "cjs"
        self.in_async = self.module
        self.in_gen = False
        self.in_func = not self.module
        self.no_in = False
        self.ambient = False
        self.match: dict[int, int] = {}
        stack = []
        for k, x in enumerate(t):
            if x in ("(", "[", "{"):
                stack.append(k)
                if len(stack) > NESTED:
                    raise Fault("delimiter")
            elif x in (")", "]", "}") and stack:
                self.match[stack.pop()] = k

    # --- helpers
    def fail(self, why: str = "grammar") -> None:
        raise Fault("end" if self.t[self.i] == "EOF" else why)

    def eat(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if self.t[self.i] != x:
            self.fail()
        self.i += 1

    def name(self) -> str:
        x = self.t[self.i]
        if x not in _NAMES:
            self.fail()
        if x == "await" and self.in_async or x == "yield" and (self.in_gen or self.module):
            self.fail()
        self.i += 1
        return x

    def semicolon(self) -> None:
        if self.eat(";") or self.t[self.i] in ("}", "EOF") or self.nl[self.i]:
            return
        self.fail()

    def attempt(self, f):  # noqa: ANN001, ANN201
        """Run ``f``; where it fails, go back and return None."""
        at, keep = self.i, (self.in_async, self.in_gen, self.in_func, self.no_in)
        try:
            return f() or True
        except Fault:
            self.i = at
            self.in_async, self.in_gen, self.in_func, self.no_in = keep
            return None

    # --- statements
    def program(self) -> None:
        while self.t[self.i] != "EOF":
            self.statement(top=True)

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "EOF":
                self.fail("end")
            self.statement()

    def body(self, is_async: bool, gen: bool) -> None:
        keep = (self.in_async, self.in_gen, self.in_func, self.no_in)
        self.in_async, self.in_gen, self.in_func, self.no_in = is_async, gen, True, False
        self.block()
        self.in_async, self.in_gen, self.in_func, self.no_in = keep

    def statement(self, top: bool = False) -> None:
        t, i = self.t, self.i
        x, y = t[i], t[i + 1] if i + 1 < len(t) else "EOF"
        if x == "{":
            self.block()
        elif x == ";":
            self.i += 1
        elif x in ("var", "const", "let"):
            if x == "const" and y == "enum" and self.ts:
                self.i += 1
                self.enum()
                return
            if x == "let" and not self.module and y not in _NAMES and y not in ("[", "{"):
                self.expression_statement()
                return
            self.i += 1
            self.declarations(x)
            self.semicolon()
        elif x == "function":
            self.function()
        elif x == "async" and y == "function" and not self.nl[i + 1]:
            self.i += 1
            self.function(True)
        elif x == "class":
            self.klass()
        elif x == "@":
            self.decorators()
            if self.t[self.i] == "export":
                self.statement(top)
            else:
                self.eat("abstract")
                self.klass()
        elif x == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.eat("else"):
                self.statement()
        elif x == "for":
            self.for_()
        elif x == "while":
            self.i += 1
            self.paren()
            self.statement()
        elif x == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            self.eat(";")
        elif x == "return":
            if not self.in_func:
                self.fail()
            self.i += 1
            if self.t[self.i] not in (";", "}", "EOF") and not self.nl[self.i]:
                self.expression()
            self.semicolon()
        elif x in ("break", "continue"):
            self.i += 1
            if self.t[self.i] in _NAMES and not self.nl[self.i]:
                self.i += 1
            self.semicolon()
        elif x == "throw":
            self.i += 1
            if self.nl[self.i]:
                self.fail()
            self.expression()
            self.semicolon()
        elif x == "try":
            self.i += 1
            self.block()
            caught = self.eat("catch")
            if caught:
                if self.eat("("):
                    self.binding()
                    if self.ts and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                self.block()
            elif not caught:
                self.fail()
        elif x == "switch":
            self.switch()
        elif x == "with":
            if self.module:
                self.fail()
            self.i += 1
            self.paren()
            self.statement()
        elif x == "debugger":
            self.i += 1
            self.semicolon()
        elif x == "import" and y not in ("(", "."):
            if not top or not self.module:
                self.fail()
            self.import_()
        elif x == "export":
            if not top or not self.module:
                self.fail()
            self.export()
        elif x == "enum" and self.ts:
            self.enum()
        elif x in _NAMES and y == ":":
            self.i += 2
            self.statement()
        elif self.ts and self.ts_declaration(x, y):
            return
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def ts_declaration(self, x: str, y: str) -> bool:
        i = self.i
        new = self.nl[i + 1] if i + 1 < len(self.nl) else True
        if new:
            return False
        if x == "interface" and y in _NAMES:
            self.i += 1
            self.name()
            self.type_parameters()
            if self.eat("extends"):
                self.heritage()
            self.object_type()
            return True
        if x == "type" and y in _NAMES:
            self.i += 1
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if x in ("namespace", "module") and y in _NAMES | {"STR"} or x == "global" and y == "{":
            self.i += 1
            if x != "global" and not self.eat("STR"):
                self.name()
                while self.eat("."):
                    self.property_name()
            if self.t[self.i] == "{":
                self.need("{")
                while not self.eat("}"):
                    if self.t[self.i] == "EOF":
                        self.fail("end")
                    self.statement(top=True)
            else:
                self.semicolon()
            return True
        if x == "abstract" and y == "class":
            self.i += 1
            self.klass()
            return True
        if x == "declare" and (y in ("const", "let", "var", "function", "class", "enum", "async", "abstract", "namespace", "module", "global", "interface", "type", "import")):
            self.i += 1
            keep, self.ambient = self.ambient, True
            self.statement(top=True)
            self.ambient = keep
            return True
        return False

    def declarations(self, kind: str) -> None:
        while True:
            pattern = self.t[self.i] in ("{", "[")
            self.binding()
            if self.ts:
                if self.t[self.i] == "!" and self.t[self.i + 1] == ":":
                    self.i += 1
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif (kind == "const" or pattern) and not self.ambient and not (self.no_in and self.t[self.i] in ("of", "in")):
                self.fail()
            if not self.eat(","):
                return

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.value()
                if self.t[self.i] != "]":
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.name()
                else:
                    short = self.t[self.i] in _NAMES
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        self.fail()
                    if self.eat("="):
                        self.value()
                if self.t[self.i] != "}":
                    self.need(",")
        else:
            self.name()

    def value(self) -> None:
        """An assignment expression where ``in`` is an operator again."""
        keep, self.no_in = self.no_in, False
        self.assignment()
        self.no_in = keep

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.i += 1
        if self.t[self.i] == "await":
            if not self.in_async:
                self.fail()
            self.i += 1
        self.need("(")
        if self.eat(";"):
            pass
        else:
            keep, self.no_in = self.no_in, True
            x, y = self.t[self.i], self.t[self.i + 1]
            if x in ("var", "const", "let") and not (x == "let" and y in ("in", "of", ".")) or x == "using" and y in _NAMES and y != "of":
                self.i += 1
                self.declarations(x)
            else:
                self.expression()
            self.no_in = keep
            if self.eat("of"):
                self.assignment()
                self.need(")")
                self.statement()
                return
            if self.eat("in"):
                self.expression()
                self.need(")")
                self.statement()
                return
            self.need(";")
        if not self.eat(";"):
            self.expression()
            self.need(";")
        if not self.eat(")"):
            self.expression()
            self.need(")")
        self.statement()

    def switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.t[self.i] not in ("case", "default", "}"):
                if self.t[self.i] == "EOF":
                    self.fail("end")
                self.statement()

    def import_(self) -> None:
        self.i += 1
        if self.eat("STR"):
            self.attributes()
            self.semicolon()
            return
        if self.ts and self.t[self.i] == "type" and (self.t[self.i + 1] in ("{", "*") or self.t[self.i + 1] in _NAMES and (self.t[self.i + 1] != "from" or self.t[self.i + 2] == "from")):
            self.i += 1
        more = True
        if self.t[self.i] in _NAMES:
            self.i += 1
            if self.ts and self.eat("="):
                if self.t[self.i] == "require" and self.t[self.i + 1] == "(":
                    self.i += 2
                    self.need("STR")
                    self.need(")")
                else:
                    self.name()
                    while self.eat("."):
                        self.property_name()
                self.semicolon()
                return
            more = self.eat(",")
        if more:
            if self.eat("*"):
                self.need("as")
                self.name()
            else:
                self.specifiers(True)
        self.need("from")
        self.need("STR")
        self.attributes()
        self.semicolon()

    def attributes(self) -> None:
        if self.t[self.i] == "with" or self.t[self.i] == "ID" and self.t[self.i + 1] == "{":
            self.i += 1
            self.object()

    def specifiers(self, importing: bool) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.t[self.i] == "type" and self.t[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            first = self.t[self.i]
            if first != "STR" and first not in _PROPERTY:
                self.fail()
            self.i += 1
            if self.eat("as"):
                second = self.t[self.i]
                if importing and second not in _NAMES or second not in _PROPERTY and second != "STR":
                    self.fail()
                self.i += 1
            elif importing and first not in _NAMES:
                self.fail()
            if self.t[self.i] != "}":
                self.need(",")

    def export(self) -> None:
        self.i += 1
        x, y = self.t[self.i], self.t[self.i + 1] if self.i + 1 < len(self.t) else "EOF"
        if x == "default":
            self.i += 1
            x, y = self.t[self.i], self.t[self.i + 1] if self.i + 1 < len(self.t) else "EOF"
            if x == "function" or x == "async" and y == "function" and not self.nl[self.i + 1]:
                is_async = self.eat("async")
                self.function(is_async, named=False)
            elif x == "class" or x == "@":
                self.decorators()
                self.klass()
            elif self.ts and x == "abstract" and y == "class":
                self.i += 1
                self.klass()
            elif self.ts and x == "interface" and y in _NAMES:
                self.ts_declaration(x, y)
            else:
                self.assignment()
                self.semicolon()
        elif x == "*":
            self.i += 1
            if self.eat("as"):
                if not self.eat("STR"):
                    self.property_name()
            self.need("from")
            self.need("STR")
            self.attributes()
            self.semicolon()
        elif x == "{" or self.ts and x == "type" and y in ("{", "*"):
            if x == "type":
                self.i += 1
            if self.eat("*"):
                if self.eat("as"):
                    self.name()
                self.need("from")
                self.need("STR")
            else:
                self.specifiers(False)
                if self.eat("from"):
                    self.need("STR")
                    self.attributes()
            self.semicolon()
        elif self.ts and x == "=":
            self.i += 1
            self.expression()
            self.semicolon()
        elif self.ts and x == "as" and y == "namespace":
            self.i += 2
            self.name()
            self.semicolon()
        elif self.ts and x == "import":
            self.import_()
        elif x in ("var", "let", "const", "function", "class", "@") or x == "async" and y == "function":
            self.statement()
        elif self.ts and x == "enum":
            self.enum()
        elif not (self.ts and self.ts_declaration(x, y)):
            self.fail()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] in _PROPERTY or self.t[self.i] == "STR":
                self.i += 1
            elif self.eat("["):
                if not (self.eat("STR") or self.eat("TPL")):
                    self.fail()
                self.need("]")
            else:
                self.fail()
            if self.eat("="):
                self.value()
            if self.t[self.i] != "}":
                self.need(",")

    # --- functions and classes
    def function(self, is_async: bool = False, named: bool = True) -> None:
        self.need("function")
        gen = self.eat("*")
        if self.t[self.i] in _NAMES:
            self.i += 1
        elif named:
            self.fail()
        self.signature(is_async, gen)
        if self.ts and self.t[self.i] != "{":
            self.semicolon()
            return
        self.body(is_async, gen)

    def signature(self, is_async: bool, gen: bool) -> None:
        keep = (self.in_async, self.in_gen, self.no_in)
        self.in_async, self.in_gen, self.no_in = is_async, gen, False
        if self.ts:
            self.type_parameters()
        self.parameters()
        self.in_async, self.in_gen, self.no_in = keep
        if self.ts and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.decorators()
            if self.ts:
                while self.t[self.i] in _MODIFIERS and self.t[self.i + 1] in _NAMES | {"{", "["}:
                    self.i += 1
                if self.t[self.i] == "this":
                    self.i += 1
                    if self.eat(":"):
                        self.type()
                    if self.t[self.i] != ")":
                        self.need(",")
                    continue
            rest = self.eat("...")
            self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                if rest:
                    self.fail()
                self.value()
            if self.t[self.i] != ")":
                if rest:
                    self.fail()
                self.need(",")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.t[self.i] == "(":
                self.paren()
                continue
            self.name()
            while self.eat("."):
                self.property_name()
            if self.ts and self.t[self.i] == "<":
                self.type_arguments()
            if self.t[self.i] == "(":
                self.arguments()

    def heritage(self) -> None:
        while True:
            self.type_name()
            if not self.eat(","):
                return

    def klass(self) -> None:
        self.need("class")
        if self.t[self.i] in _NAMES and not (self.t[self.i] == "implements" and self.t[self.i + 1] in _NAMES):
            self.name()
        if self.ts:
            self.type_parameters()
        if self.eat("extends"):
            self.left_hand()
            if self.ts and self.t[self.i] == "<":
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.heritage()
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "EOF":
                self.fail("end")
            if not self.eat(";"):
                self.member()

    def property_name(self) -> None:
        x = self.t[self.i]
        if x in _PROPERTY or x in ("STR", "NUM", "#ID"):
            self.i += 1
        elif x == "[":
            self.i += 1
            self.value()
            self.need("]")
        else:
            self.fail()

    def member(self) -> None:
        self.decorators()
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",", "EOF")
        if self.t[self.i] == "static" and self.t[self.i + 1] == "{":
            self.i += 1
            keep = (self.in_async, self.in_gen, self.in_func)
            self.in_async, self.in_gen, self.in_func = False, False, False
            self.block()
            self.in_async, self.in_gen, self.in_func = keep
            return
        while self.t[self.i] in _MODIFIERS and self.t[self.i + 1] not in ends:
            if not self.ts and self.t[self.i] not in ("static", "accessor"):
                self.fail()
            self.i += 1
        if self.ts and self.t[self.i] == "[" and self.t[self.i + 1] in _NAMES and self.t[self.i + 2] == ":":
            self.i += 2
            self.need(":")
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            self.semicolon()
            return
        is_async = gen = accessor = False
        if self.t[self.i] == "async" and self.t[self.i + 1] not in ends and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.eat("*"):
            gen = True
        elif self.t[self.i] in ("get", "set") and self.t[self.i + 1] not in ends:
            self.i += 1
            accessor = True
        self.property_name()
        if self.ts:
            if self.t[self.i] in ("?", "!"):
                self.i += 1
        if self.t[self.i] == "(" or self.ts and self.t[self.i] == "<":
            self.signature(is_async, gen)
            if self.ts and self.t[self.i] != "{":
                self.semicolon()
                return
            self.body(is_async, gen)
            return
        if is_async or gen or accessor:
            self.fail()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            keep = (self.in_async, self.in_gen)
            self.in_async = self.in_gen = False
            self.value()
            self.in_async, self.in_gen = keep
        self.semicolon()

    # --- expressions
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def arrow_body(self, is_async: bool) -> None:
        self.need("=>")
        if self.t[self.i] == "{":
            self.body(is_async, False)
            return
        keep = (self.in_async, self.in_gen)
        self.in_async, self.in_gen = is_async, False
        self.assignment()
        self.in_async, self.in_gen = keep

    def arrow(self, is_async: bool, conditional: bool) -> bool:
        """An arrow function with parentheses, if one stands here."""
        def run() -> bool:
            if self.nl[self.i] and is_async:
                raise Fault("grammar")
            self.signature(is_async, False)
            if self.t[self.i] != "=>" or self.nl[self.i]:
                raise Fault("grammar")
            return True

        at = self.i
        if self.t[at] == "(":
            close = self.match.get(at)
            after = self.t[close + 1] if close is not None else ""
            if after == "=>":
                pass
            elif not (self.ts and after == ":"):
                return False
        elif not (self.ts and self.t[at] == "<"):
            return False
        typed = self.t[at] == "<" or self.t[self.match[at] + 1] == ":"
        if not typed:
            run()
            self.arrow_body(is_async)
            return True
        if self.attempt(run) is None:
            return False
        if conditional:
            def rest() -> bool:
                self.arrow_body(is_async)
                if self.t[self.i] != ":":
                    raise Fault("grammar")
                return True

            if self.attempt(rest) is None:
                self.i = at
                return False
            return True
        self.arrow_body(is_async)
        return True

    def assignment(self, conditional: bool = False) -> None:
        t, i = self.t, self.i
        x = t[i]
        if x in _NAMES:
            y = t[i + 1]
            if y == "=>" and not self.nl[i + 1]:
                self.name()
                self.arrow_body(False)
                return
            if x == "async" and not self.nl[i + 1]:
                if y in _NAMES and t[i + 2] == "=>":
                    self.i += 2
                    self.arrow_body(True)
                    return
                if y == "(" or y == "<":
                    self.i += 1
                    if self.arrow(True, conditional):
                        return
                    self.i = i
            if x == "yield" and self.in_gen:
                self.i += 1
                if self.nl[self.i] or self.t[self.i] in (")", "]", "}", ",", ";", ":", "EOF", "TM", "TT"):
                    return
                self.eat("*")
                self.assignment()
                return
        elif x == "(" or x == "<":
            if self.arrow(False, conditional):
                return
        kind, cover = self.binary()
        if self.t[self.i] == "?":
            self.i += 1
            if cover:
                self.fail()
            keep, self.no_in = self.no_in, False
            self.assignment(True)
            self.no_in = keep
            self.need(":")
            self.assignment(conditional)
            return
        y = self.t[self.i]
        if y in _ASSIGN:
            if kind == "pattern" and y != "=" or kind == "other":
                self.fail()
            self.i += 1
            self.assignment()
            return
        if y == ">" and self.t[self.i + 1].startswith("~"):
            k = self.i + 1
            while self.t[k] == "~>":
                k += 1
            if self.t[k] == "~=" and k > self.i + 1:
                if kind != "target":
                    self.fail()
                self.i = k + 1
                self.assignment()
                return
        if cover and self.t[self.i] not in ("of", "in"):
            self.fail()

    def binary(self) -> tuple[str, bool]:
        """Operands and operators; what kind of thing it is when it has no operator, and whether it holds ``{a = 1}``."""
        kind, cover = self.unary()
        mixed = set()
        while True:
            x = self.t[self.i]
            if x == ">":
                k = self.i + 1
                while self.t[k] == "~>":
                    k += 1
                if k - self.i > 3:
                    self.fail()
                if self.t[k] == "~=":
                    if k > self.i + 1:
                        return kind, cover
                    k += 1
                elif self.t[k].startswith("~"):
                    self.fail()
                self.i = k
            elif x in _BINARY:
                if x == "in" and self.no_in:
                    return kind, cover
                if x in ("??", "&&", "||"):
                    mixed.add("?" if x == "??" else "l")
                    if len(mixed) > 1:
                        self.fail()
                if x == "**" and kind == "unary":
                    self.fail()
                self.i += 1
            elif self.ts and x in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.eat("const"):
                    self.type()
                kind = "target" if kind == "target" else "other"
                continue
            else:
                return kind, cover
            if cover:
                self.fail()
            kind, cover = self.unary()
            if cover:
                self.fail()
            kind = "other" if kind != "unary" else "unary"

    def unary(self) -> tuple[str, bool]:
        x = self.t[self.i]
        if x in _UNARY:
            self.i += 1
            self.unary()
            return "unary", False
        if x in ("++", "--"):
            self.i += 1
            kind, _ = self.unary()
            if kind != "target":
                self.fail()
            return "other", False
        if x == "await" and (self.in_async or self.t[self.i + 1] in _NAMES and not self.nl[self.i + 1] and not self.ts and self.module):
            if not self.in_async:
                self.fail()
            self.i += 1
            self.unary()
            return "other", False
        if x == "<" and self.ts and not self.tsx:
            self.i += 1
            if not self.eat("const"):
                self.type()
            self.need(">")
            self.unary()
            return "other", False
        if x == "#ID" and self.t[self.i + 1] == "in":
            self.i += 1
            return "other", False
        kind, cover = self.left_hand()
        if self.t[self.i] in ("++", "--") and not self.nl[self.i]:
            if kind != "target":
                self.fail()
            self.i += 1
            return "other", False
        return kind, cover

    def left_hand(self) -> tuple[str, bool]:
        x = self.t[self.i]
        if x == "new":
            kind, cover = self.new(), False
        elif x == "import":
            self.i += 1
            if self.eat("."):
                if not self.module:
                    self.fail()
                self.property_name()
            else:
                self.arguments()
            kind, cover = "other", False
        elif x == "super":
            self.i += 1
            if self.t[self.i] not in (".", "[", "("):
                self.fail()
            kind, cover = "other", False
        else:
            kind, cover = self.primary()
        chain = False
        while True:
            x = self.t[self.i]
            if x == ".":
                self.i += 1
                self.member_name()
                kind = "other" if chain else "target"
            elif x == "?.":
                self.i += 1
                chain = True
                y = self.t[self.i]
                if y == "(":
                    self.arguments()
                elif y == "[":
                    self.index()
                elif self.ts and y == "<":
                    self.type_arguments()
                    self.arguments()
                else:
                    self.member_name()
                kind = "other"
            elif x == "[":
                self.index()
                kind = "other" if chain else "target"
            elif x == "(":
                self.arguments()
                kind = "other"
            elif x in ("TPL", "TH"):
                if chain:
                    self.fail()
                self.template()
                kind = "other"
            elif x == "!" and self.ts and not self.nl[self.i]:
                self.i += 1
            elif x == "<" and self.ts and self.attempt(self.call_arguments):
                kind = "other"
            else:
                return kind, cover
            if cover:
                self.fail()
            cover = False

    def call_arguments(self) -> bool:
        self.type_arguments()
        if self.t[self.i] not in _AFTER_ARGUMENTS and not self.nl[self.i]:
            raise Fault("grammar")
        return True

    def member_name(self) -> None:
        if self.t[self.i] not in _PROPERTY and self.t[self.i] != "#ID":
            self.fail()
        self.i += 1

    def index(self) -> None:
        keep, self.no_in = self.no_in, False
        self.need("[")
        self.expression()
        self.need("]")
        self.no_in = keep

    def new(self) -> str:
        self.i += 1
        if self.eat("."):
            self.need("target")
            return "other"
        if self.t[self.i] == "new":
            self.new()
        elif self.t[self.i] == "import":
            self.fail()
        else:
            self.primary()
        while True:
            if self.eat("."):
                self.member_name()
            elif self.t[self.i] == "[":
                self.index()
            elif self.t[self.i] in ("TPL", "TH"):
                self.template()
            elif self.ts and self.t[self.i] == "!":
                self.i += 1
            else:
                break
        if self.ts and self.t[self.i] == "<":
            self.attempt(self.call_arguments)
        if self.t[self.i] == "(":
            self.arguments()
        return "other"

    def arguments(self) -> None:
        keep, self.no_in = self.no_in, False
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if self.t[self.i] != ")":
                self.need(",")
        self.no_in = keep

    def template(self) -> None:
        if self.eat("TPL"):
            return
        keep, self.no_in = self.no_in, False
        self.need("TH")
        while True:
            self.expression()
            if self.eat("TT"):
                break
            self.need("TM")
        self.no_in = keep

    def primary(self) -> tuple[str, bool]:
        x = self.t[self.i]
        if x in _NAMES:
            if x == "async" and self.t[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True, named=False)
                return "other", False
            self.name()
            return "target", False
        if x in ("NUM", "STR", "RE", "this", "null", "true", "false"):
            self.i += 1
            return "other", False
        if x == "OLD":
            if self.module:
                self.fail()
            self.i += 1
            return "other", False
        if x in ("TPL", "TH"):
            self.template()
            return "other", False
        if x == "(":
            keep, self.no_in = self.no_in, False
            self.i += 1
            inner = self.t[self.i]
            end = self.match.get(self.i - 1, -1)
            self.expression()
            self.need(")")
            self.no_in = keep
            return ("target" if inner in _NAMES and end >= 0 else "other"), False
        if x == "[":
            return "pattern", self.array()
        if x == "{":
            return "pattern", self.object()
        if x == "function":
            self.function(False, named=False)
            return "other", False
        if x == "class" or x == "@":
            self.decorators()
            self.klass()
            return "other", False
        if x == "J[":
            self.i += 1
            while not self.eat("J]"):
                if self.eat("J,"):
                    if self.t[self.i] in ("J,", "J]"):
                        continue
                    self.eat("...")
                    self.expression()
                elif self.t[self.i] == "J[":
                    self.primary()
                else:
                    self.fail()
            return "other", False
        self.fail()
        return "other", False

    def array(self) -> bool:
        keep, self.no_in = self.no_in, False
        cover = False
        self.need("[")
        while not self.eat("]"):
            if self.eat(","):
                continue
            self.eat("...")
            cover |= self.maybe_cover()
            if self.t[self.i] != "]":
                self.need(",")
        self.no_in = keep
        return cover

    def maybe_cover(self) -> bool:
        """An assignment expression, or an object or array that only holds as a pattern."""
        if self.t[self.i] in ("{", "["):
            close = self.match.get(self.i)
            if close is not None and self.t[close + 1] in (",", "]", "}"):
                return self.object() if self.t[self.i] == "{" else self.array()
        self.assignment()
        return False

    def object(self) -> bool:
        keep, self.no_in = self.no_in, False
        cover = False
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                cover |= self.property()
            if self.t[self.i] != "}":
                self.need(",")
        self.no_in = keep
        return cover

    def property(self) -> bool:
        ends = ("(", ":", ",", "}", "=", "<")
        is_async = gen = accessor = False
        if self.t[self.i] == "async" and self.t[self.i + 1] not in ends and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.eat("*"):
            gen = True
        elif self.t[self.i] in ("get", "set") and self.t[self.i + 1] not in ends:
            self.i += 1
            accessor = True
        x = self.t[self.i]
        self.property_name()
        if x == "#ID":
            self.fail()
        if self.t[self.i] == "(" or self.ts and self.t[self.i] == "<":
            self.signature(is_async, gen)
            self.body(is_async, gen)
            return False
        if is_async or gen or accessor:
            self.fail()
        if self.eat(":"):
            return self.maybe_cover()
        if x not in _NAMES:
            self.fail()
        if self.eat("="):
            self.assignment()
            return True
        return False

    # --- types
    def type_parameters(self) -> None:
        if not self.eat("<"):
            return
        if self.t[self.i] == ">":
            self.fail()
        while not self.eat(">"):
            while self.t[self.i] in ("const", "in", "out") and self.t[self.i + 1] in _NAMES:
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if self.t[self.i] not in (">", "~>"):
                self.need(",")
            elif self.t[self.i] == "~>":
                self.t[self.i] = ">"

    def type_arguments(self) -> None:
        self.need("<")
        if self.t[self.i] == ">":
            self.fail()
        while True:
            self.type()
            if self.eat(">") or self.eat("~>"):
                return
            self.need(",")
            if self.t[self.i] in (">", "~>"):
                self.fail()

    def return_type(self) -> None:
        x, y = self.t[self.i], self.t[self.i + 1]
        if x == "asserts" and (y in _NAMES or y == "this") and not self.nl[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if (x in _NAMES or x == "this") and y == "is" and not self.nl[self.i + 1]:
            self.i += 2
        self.type()

    def function_type_here(self) -> bool:
        x = self.t[self.i]
        if x == "<" or x == "new":
            return True
        if x == "abstract" and self.t[self.i + 1] == "new":
            return True
        if x != "(":
            return False
        close = self.match.get(self.i)
        return close is not None and self.t[close + 1] == "=>"

    def type(self) -> None:
        if self.function_type_here():
            self.eat("abstract")
            self.eat("new")
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        self.union()
        if self.t[self.i] == "extends" and not self.nl[self.i] and not self.no_conditional:
            self.i += 1
            keep, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = keep
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    no_conditional = False

    def union(self) -> None:
        self.eat("|")
        self.intersection()
        while self.eat("|"):
            self.intersection()

    def intersection(self) -> None:
        self.eat("&")
        self.type_operator()
        while self.eat("&"):
            self.type_operator()

    def type_operator(self) -> None:
        if self.function_type_here():
            self.type()
            return
        x, y = self.t[self.i], self.t[self.i + 1]
        if x in ("keyof", "unique", "readonly") and y not in (",", ")", ">", "~>", ";", "=", "|", "&", "]", "}", "EOF") and not self.nl[self.i + 1]:
            self.i += 1
            self.type_operator()
            return
        if x == "infer" and y in _NAMES:
            self.i += 2
            if self.t[self.i] == "extends":
                def bound() -> bool:
                    self.i += 1
                    keep, self.no_conditional = self.no_conditional, True
                    self.type()
                    self.no_conditional = keep
                    if self.t[self.i] == "?":
                        raise Fault("grammar")
                    return True

                self.attempt(bound)
            return
        self.type_primary()
        while self.t[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def type_name(self) -> None:
        if self.t[self.i] == "this":
            self.i += 1
        else:
            if self.t[self.i] not in _NAMES:
                self.fail()
            self.i += 1
        while self.eat("."):
            self.property_name()
        if self.t[self.i] == "<" and not self.nl[self.i]:
            self.type_arguments()

    def type_primary(self) -> None:
        x = self.t[self.i]
        if x in ("NUM", "STR", "true", "false", "null", "void", "TPL"):
            self.i += 1
        elif x == "-":
            self.i += 1
            self.need("NUM")
        elif x == "TH":
            self.i += 1
            while True:
                self.type()
                if self.eat("TT"):
                    break
                self.need("TM")
        elif x == "typeof":
            self.i += 1
            if self.eat("import"):
                self.need("(")
                self.type()
                self.need(")")
                while self.eat("."):
                    self.property_name()
            else:
                self.type_name()
        elif x == "import":
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.eat("."):
                self.property_name()
            if self.t[self.i] == "<":
                self.type_arguments()
        elif x == "(":
            self.i += 1
            keep, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = keep
            self.need(")")
        elif x == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.t[self.i] in _PROPERTY and (self.t[self.i + 1] == ":" or self.t[self.i + 1] == "?" and self.t[self.i + 2] == ":"):
                    self.i += 1
                    self.eat("?")
                    self.i += 1
                keep, self.no_conditional = self.no_conditional, False
                self.type()
                self.no_conditional = keep
                self.eat("?")
                if self.t[self.i] != "]":
                    self.need(",")
        elif x == "{":
            self.object_type()
        else:
            self.type_name()

    def object_type(self) -> None:
        keep, self.no_conditional = self.no_conditional, False
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "EOF":
                self.fail("end")
            self.type_member()
            if not (self.eat(";") or self.eat(",")) and self.t[self.i] != "}" and not self.nl[self.i]:
                self.fail()
        self.no_conditional = keep

    def type_member(self) -> None:
        ends = ("(", ":", "?", ";", ",", "}", "<")
        if self.t[self.i] in ("+", "-") and self.t[self.i + 1] == "readonly":
            self.i += 1
        while self.t[self.i] in ("readonly", "public", "private", "protected", "static") and self.t[self.i + 1] not in ends:
            self.i += 1
        x = self.t[self.i]
        if x in ("(", "<") or x == "new" and self.t[self.i + 1] in ("(", "<"):
            self.eat("new")
            self.type_parameters()
            self.parameters()
            if self.eat(":"):
                self.return_type()
            return
        if x in ("get", "set") and self.t[self.i + 1] not in ends:
            self.i += 1
        if self.t[self.i] == "[" and self.t[self.i + 1] in _NAMES and self.t[self.i + 2] in (":", "in"):
            self.i += 2
            mapped = self.t[self.i] == "in"
            self.i += 1
            self.type()
            if mapped and self.eat("as"):
                self.type()
            self.need("]")
            if mapped:
                if self.t[self.i] in ("+", "-"):
                    self.i += 1
                self.eat("?")
            if self.eat(":"):
                self.type()
            elif not mapped:
                self.fail()
            return
        self.property_name()
        self.eat("?")
        if self.t[self.i] in ("(", "<"):
            self.type_parameters()
            self.parameters()
            if self.eat(":"):
                self.return_type()
        elif self.eat(":"):
            self.type()
