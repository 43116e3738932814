"""Lexer of JavaScript and TypeScript, with JSX where the extension allows it.

One pass with a pushdown stack of open delimiters, template literals and JSX elements. The stack also decides what a slash, a
less-than sign or a closing brace means at each place. Tokens are normalised: names, numbers, strings and regular
expressions lose their text, so that code of one shape gives one token sequence.
"""

from __future__ import annotations

import re

from lodeline.llm.syntax.base import CONFLICT, NESTED, Fault

KEYWORDS = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in
    instanceof new null return super switch this throw true try typeof var void while with""".split()
)
CONTEXTUAL = frozenset(
    """abstract accessor any as asserts assert async await bigint boolean constructor declare from get global implements infer interface is keyof let
    meta module namespace never number object of out override package private protected public readonly require satisfies set static string
    symbol target type undefined unique unknown using yield""".split()
)
KEPT = KEYWORDS | CONTEXTUAL

_NAME = r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
TOKEN = re.compile(
    r"[ \t\f\v\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]*(?:"
    rf"(?P<name>#?{_NAME})"
    r"|(?P<nl>[\r\n\u2028\u2029]+)"
    r"|(?P<punct>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=@]|\.(?!\d))"
    r"|(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*)n?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)"
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')"
    r"|(?P<comment>//[^\r\n\u2028\u2029]*|/\*.*?\*/)"
    r"|(?P<tpl>`(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{))"
    r"|(?P<slash>/=?)|(?P<eof>\Z))",
    re.DOTALL,
)
_REST = re.compile(r"\}(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{)", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/([A-Za-z]*)")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:-[\w$-]*)?(?:[.:][A-Za-z_$][\w$-]*)*")
_JSX_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.DOTALL)
_JSX_ATTR = re.compile(r"[A-Za-z_$][\w$:.-]*")
_JSX_STR = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|\bextends\b(?!\s*[=>/])|=(?!\s*[\"'{]))")
#: After these a value begins: a slash opens a regular expression, a less-than sign an element or type parameters.
_BEFORE_VALUE = frozenset(
    "( [ { } ; , < > + - * % & | ^ ! ~ ? : = => == != === !== <= << ** && || ?? += -= *= %= &= |= ^= <<= **= &&= ||= ??= / /= ... J[ J, TH TM return typeof instanceof in of new delete void throw case do else yield await default".split()
)


#: At one of these, on a new line after a whole statement and outside all delimiters, no statement can go on.
STARTS = frozenset("import export function class const let var interface type async enum declare abstract if for switch try return throw namespace".split())
_KEPT = {k: k for k in KEPT}
_NL, _COMMENT, _WORD, _NUM, _STR, _TPL, _PUNCT, _SLASH, _EOF = (TOKEN.groupindex[k] for k in ("nl", "comment", "name", "num", "str", "tpl", "punct", "slash", "eof"))
_PLAIN = frozenset("; , . : ? => + - * & | ! && || ?? ++ -- += -= ... === !== % ^ ~ @ ?. <= != **".split())


def pieces(text: str, jsx: bool, ts: bool) -> list[tuple[str, ...]]:
    """Normalised tokens of a file, cut into groups of whole statements.

    ``\n`` stands before a token that begins a line, and ``~`` in a token that is glued to the ``>`` before it: the grammar asks for both.
    """
    lexer = _Lexer(text, jsx, ts)
    lexer.code(0, False)
    if lexer.stack:
        raise Fault("delimiter" if lexer.stack[-1][0] != "T" else "literal")
    cuts = [0, *lexer.cuts, len(lexer.out)]
    return [tuple(lexer.out[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]


class _Lexer:
    def __init__(self, text: str, jsx: bool, ts: bool):
        self.text, self.jsx, self.ts = text, jsx, ts
        self.out: list[str] = []
        self.cuts: list[int] = []
        self.last = ""
        # what is open, and whether a value ends with it (or, for a parenthesis, whether a statement follows it)
        self.stack: list[tuple[str, bool]] = []
        self.ended = ""
        self.conflict = {m.start() for m in CONFLICT.finditer(text)} if CONFLICT.search(text) else set()

    def value_next(self) -> bool:
        """Whether a value begins here rather than an operator."""
        last = self.last
        if last == ")":
            return self.ended == "cond"
        if last == "}":
            return self.ended == "block"
        return not last or last in _BEFORE_VALUE

    def code(self, at: int, embedded: bool) -> int:
        """Lex code from ``at``; embedded code ends at the brace that closes it."""
        text, out, stack, conflict = self.text, self.out, self.stack, self.conflict
        append, kept = out.append, _KEPT.get
        floor = len(stack)
        line, glue = False, -1
        scan = TOKEN.scanner(text, at).match
        while True:
            m = scan()
            if m is None:
                c = text[at:].lstrip(" \t")[:1]
                raise Fault("literal" if c and c in "\"'`" else "character")
            kind = m.lastindex
            at = m.end()
            if kind == _NL:
                line = True
                continue
            if kind == _EOF:
                break
            token = m[kind]
            if kind == _COMMENT:
                if not line and ("\n" in token or "\r" in token):
                    line = True
                continue
            if conflict and m.start(kind) in conflict:
                raise Fault("conflict")
            jump = -1
            if kind == _WORD:
                token = kept(token) or ("#ID" if token[0] == "#" else "ID")
                if token != "ID" and (self.last == "." or self.last == "?.") and token != "#ID":
                    token = "ID"
            elif kind == _PUNCT:
                if token in _PLAIN:
                    pass
                elif token == "(":
                    last = self.last
                    stack.append(("(", last in ("if", "while", "for", "with") or (last == "await" and len(out) > 1 and out[-2] == "for")))
                elif token == "[":
                    stack.append(("[", False))
                elif token == "{":
                    last = self.last
                    stack.append(("{", last in _BEFORE_VALUE and last not in (";", "{", "}", "=>", "else", "do", ">", "default")))
                elif token == ")" or token == "]":
                    if len(stack) <= floor or stack[-1][0] != ("(" if token == ")" else "["):
                        raise Fault("delimiter")
                    self.ended = "cond" if stack.pop()[1] else "value"
                elif token == "}":
                    if len(stack) <= floor:
                        if embedded:
                            return at - 1
                        raise Fault("delimiter")
                    what, value = stack[-1]
                    if what == "T":
                        r = _REST.match(text, at - 1)
                        if r is None:
                            raise Fault("literal")
                        if r[0].endswith("${") and len(r[0]) > 2:
                            token = "TM"
                        elif r[0][-1] == "`":
                            stack.pop()
                            token = "TT"
                        else:
                            raise Fault("literal")
                        jump = r.end()
                    elif what != "{":
                        raise Fault("delimiter")
                    else:
                        stack.pop()
                        self.ended = "value" if value else "block"
                elif token == "<":
                    if self.jsx and self.value_next() and self.element_here(at - 1):
                        if line:
                            append("\n")
                            line = False
                        append("J[")
                        self.last = "J["
                        at = self.element(at - 1)
                        append("J]")
                        self.last = "J]"
                        scan = TOKEN.scanner(text, at).match
                        continue
                elif token == ">":
                    if glue == m.start(kind):
                        token = "~>"
                    glue = at
                elif token[0] == "=" and glue == m.start(kind):
                    token = "~" + token
            elif kind == _NUM:
                following = text[at : at + 1]
                if following.isalpha() or following in ("_", "$", "\\") and following:
                    raise Fault("character")
                token = "OLD" if len(token) > 1 and token[0] == "0" and token[1].isdigit() else "NUM"
            elif kind == _STR:
                token = "STR"
            elif kind == _TPL:
                if token.endswith("${") and len(token) > 1:
                    stack.append(("T", False))
                    if len(stack) > NESTED:
                        raise Fault("delimiter")
                    token = "TH"
                elif len(token) > 1 and token[-1] == "`":
                    token = "TPL"
                else:
                    raise Fault("literal")
            else:  # a slash
                begin = m.start(kind)
                if text.startswith("/*", begin):
                    raise Fault("literal")
                if self.value_next():
                    r = _REGEX.match(text, begin)
                    if r is None or len(set(r[1])) != len(r[1]) or not set(r[1]) <= set("dgimsuvy"):
                        raise Fault("literal")
                    token, jump = "RE", r.end()
            if line:
                if not stack and not embedded and token in STARTS and (self.last == "}" or self.last == ";"):
                    self.cuts.append(len(out))
                append("\n")
                line = False
            append(token)
            self.last = token if token != "~>" else ">"
            if jump >= 0:
                at = jump
                scan = TOKEN.scanner(text, at).match
        if embedded:
            raise Fault("end")
        return at

    def element_here(self, at: int) -> bool:
        after = self.text[at + 1 : at + 2]
        if self.ts and _TYPE_PARAMETERS.match(self.text, at):
            return False
        if self.ts and self.last in ("=", ":", "|", "&", "=>") and self.in_type():
            return False
        return bool(after) and (after.isalpha() or after in "_$>" or after.isspace())

    def in_type(self) -> bool:
        """Whether the statement at hand is a type alias."""
        k = len(self.out) - 1
        while k >= 0 and self.out[k] not in (";", "{", "}"):
            if self.out[k] == "type" and k + 1 < len(self.out) and self.out[k + 1] == "ID":
                return True
            k -= 1
        return False

    def space(self, at: int) -> int:
        return _JSX_SPACE.match(self.text, at).end()

    def element(self, at: int) -> int:
        """Lex the element that begins at ``at``; what its braces hold is lexed as code, set apart by ``J,``."""
        text = self.text
        self.stack.append(("<", False))
        if len(self.stack) > NESTED:
            raise Fault("delimiter")
        at = self.space(at + 1)
        name = ""
        if not text.startswith(">", at):
            m = _JSX_NAME.match(text, at)
            if m is None:
                raise Fault("grammar")
            name, at = m[0], m.end()
            if self.ts and text.startswith("<", at):
                depth = 0
                while at < len(text):
                    depth += (text[at] == "<") - (text[at] == ">")
                    at += 1
                    if not depth:
                        break
            while True:
                at = self.space(at)
                if text.startswith("/>", at):
                    self.stack.pop()
                    return at + 2
                if text.startswith(">", at):
                    break
                if text.startswith("{", at):
                    at = self.hole(at)
                    continue
                m = _JSX_ATTR.match(text, at)
                if m is None:
                    raise Fault("end" if at >= len(text) else "grammar")
                at = self.space(m.end())
                if text.startswith("=", at):
                    at = self.space(at + 1)
                    if text.startswith("{", at):
                        at = self.hole(at)
                    elif text.startswith("<", at):
                        at = self.element(at)
                    else:
                        m = _JSX_STR.match(text, at)
                        if m is None:
                            raise Fault("literal")
                        at = m.end()
        at += 1
        while True:
            m = _JSX_TEXT.match(text, at)
            if self.conflict and any(at <= c < m.end() for c in self.conflict):
                raise Fault("conflict")
            at = m.end()
            if text.startswith("{", at):
                at = self.hole(at)
            elif text.startswith("</", at):
                at = self.space(at + 2)
                m = _JSX_NAME.match(text, at)
                closing = m[0] if m else ""
                at = self.space(m.end() if m else at)
                if closing != name or not text.startswith(">", at):
                    raise Fault("delimiter")
                self.stack.pop()
                return at + 1
            elif text.startswith("<", at):
                if self.conflict and at in self.conflict:
                    raise Fault("conflict")
                at = self.element(at)
            elif at >= len(text):
                raise Fault("end")
            else:
                raise Fault("conflict" if self.conflict and at in self.conflict else "character")

    def hole(self, at: int) -> int:
        self.out.append("J,")
        self.last = "J,"
        return self.code(at + 1, True) + 1
