"""Facts out of TypeScript and JavaScript: a lexer, and one walk over its tokens with a stack of scopes.

The lexer knows a regular expression from a division by the token before, nests
template strings and JSX (what stands in their braces becomes tokens in brackets of
its own) and matches brackets. The walk follows statements, class bodies and expressions just far
enough to tell declarations, calls, types and control flow apart; types are
skipped. Each token is looked at a bounded number of times. Facts come in the
order of their places, an outer one before an inner one. Unbalanced or
unterminated text gives problems, and the walk goes on after them.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from tracewright.extract.sql_access import analyse

Row = tuple[str, int, dict]

# What registers routes, suites and cases, what makes and configures responses, whose they are.
METHODS = {"get", "post", "put", "patch", "delete", "del", "head", "options", "all"}
HOLDERS = {"app", "server", "router", "api", "route", "fastify", "express", "hono", "index"}
SUITES, CASES = {"describe", "suite", "context"}, {"it", "test"}
PRODUCERS = {"json", "jsonp", "send", "sendFile", "sendStatus", "download", "redirect", "write", "end"}
CONFIGURERS = {"status", "statusCode", "code", "set", "header", "setHeader", "type", "contentType", "location"}
RESPONDERS = {"reply", "res", "response", "ctx", "this"}
MADE = {"Response.json", "Response.redirect", "NextResponse.json", "NextResponse.redirect", "Response"}
MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor", "const"}
MOST_SAID = 120

_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
_LEX = re.compile(r"(?P<name>[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>\.?\d[\w.]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<punct>\.\.\.|=>|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|\*\*=?|\+\+|--|<<=?|<=|[+\-*/%&|^]=|.)", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}
#: Words after which an operand follows, and those that are no operand themselves.
BEFORE = {"return", "typeof", "case", "delete", "void", "throw", "new", "in", "of", "instanceof", "do", "else", "await", "yield", "extends", "default"}
PREFIX = {"await", "typeof", "void", "delete", "yield", "!", "~", "+", "-", "++", "--", "..."}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "&&=", "||=", "??=", "<<="}
BINARY = {"+", "-", "*", "/", "%", "**", "&", "|", "^", "&&", "||", "??", "==", "===", "!=", "!==", "<", "<=", "<<", ">", "instanceof", "in"} | ASSIGN
CLOSERS = {")": "(", "]": "[", "}": "{"}


def unescaped(text: str) -> str:
    def value(m):
        c = m[1]
        if c[0] in "ux" and len(c) > 1:
            n = int(c[1:].strip("{}"), 16)
            return chr(n) if n < 0xD800 or 0xDFFF < n < 0x110000 else "\ufffd"
        return _NAMED.get(c, c)

    return _ESCAPE.sub(value, text) if "\\" in text else text


class Tokens:
    """kind, text (of strings the value), start, end, whether a line ends before; ``close``: the place of each bracket's partner."""

    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx = source, jsx
        self.kind, self.text, self.start, self.end, self.fresh = [], [], [], [], []
        self.problems: list[tuple[int, str, str]] = []
        self.run(0, None)
        self.close = self.matched()

    def add(self, kind: str, text: str, a: int, b: int, fresh: bool = False) -> None:
        for list_, value in ((self.kind, kind), (self.text, text), (self.start, a), (self.end, b), (self.fresh, fresh)):
            list_.append(value)

    def operand(self) -> bool:
        """Whether an operand is to come, as the token before tells."""
        if not self.kind:
            return True
        kind, text = self.kind[-1], self.text[-1]
        if kind == "name":
            return text in BEFORE and not (len(self.text) > 1 and self.text[-2] in (".", "?."))
        return kind == "punct" and text not in (")", "]", "++", "--") and not (text == "!" and len(self.kind) > 1 and (self.kind[-2] == "name" or self.text[-2] in (")", "]")))

    def run(self, at: int, stop: str | None) -> int:
        """Tokens from ``at`` to the closing ``stop`` of an inserted expression, or to the end."""
        s, depth, heads, after = self.source, 0, [], False  # after: the head of a statement has just ended, so an operand may follow
        n, skip, lex = len(s), _SKIP.match, _LEX.match
        kinds, texts, starts, ends, lines = self.kind.append, self.text.append, self.start.append, self.end.append, self.fresh.append
        while True:
            fresh = False
            if at < n and ((c := s[at]) in " \n/" or c.isspace() or c == "#" and at == 0) and (m := skip(s, at)):
                gap, at = m[0], m.end()
                fresh = "\n" in gap
                if "/" in gap and gap.rfind("/*") > gap.rfind("*/"):
                    self.problems.append((m.start(), "TS1010", "'*/' expected"))
            if at >= n:
                return at
            c = s[at]
            if c == "`":
                at = self.template(at, fresh)
                continue
            if c == "/" and (self.operand() or after) and (m := _REGEX.match(s, at)):
                self.add("regex", m[0], at, m.end(), fresh)
                at = m.end()
                continue
            if c == "<" and self.jsx and self.operand() and re.match(r"<[A-Za-z_$>]", s[at : at + 2]) and not _GENERIC.match(s, at):
                at = self.element(at, fresh)
                continue
            m = lex(s, at)
            kind, text, after = m.lastgroup, m[0], False
            if kind == "name" and c != "@":
                kinds(kind)
                texts(text)
                starts(at)
                at = m.end()
                ends(at)
                lines(fresh)
                continue
            if kind == "string":
                if len(text) < 2 or text[-1] != text[0]:
                    self.problems.append((at, "TS1002", "unterminated string literal"))
                    text += text[0]
                self.add(kind, unescaped(text[1:-1]), at, m.end(), fresh)
            else:
                if kind == "punct":
                    if text in "({[":
                        heads.append(text == "(" and bool(self.kind) and self.text[-1] in ("if", "while", "for", "with"))
                        depth += 1
                    elif text in CLOSERS:
                        if stop == text and not depth:
                            return m.end()
                        depth = max(0, depth - 1)
                        after = heads.pop() if heads else False
                if text[0] == "@" and len(text) > 1:  # a decorator's name
                    self.add("punct", "@", at, at + 1, fresh)
                    self.add("name", text[1:], at + 1, m.end())
                else:
                    kinds(kind)
                    texts(text)
                    starts(at)
                    ends(m.end())
                    lines(fresh)
            at = m.end()

    def template(self, at: int, fresh: bool) -> int:
        """A template string: a string if nothing is inserted, else a list of what is."""
        begin, k, s, opened = at, at + 1, self.source, False
        while k < len(s) and s[k] != "`":
            if s[k] == "\\":
                k += 2
            elif s.startswith("${", k):
                if not opened:
                    self.add("template", "[", begin, begin + 1, fresh)
                    opened = True
                k = self.run(k + 2, "}")
                self.add("punct", ",", k - 1, k)
            else:
                k += 1
        if k >= len(s):
            self.problems.append((begin, "TS1160", "unterminated template literal"))
        end = min(k + 1, len(s))
        if opened:
            self.add("punct", "]", end - 1, end)
        else:
            self.add("string", unescaped(s[at + 1 : k]), at, end, fresh)
        return end

    def element(self, at: int, fresh: bool) -> int:
        """A JSX element: a list of the expressions in its attributes and children; text isn't code."""
        s, depth = self.source, 0
        self.add("template", "[", at, at + 1, fresh)
        tag = re.compile(r"<(/?)[\w$.:\-]*")
        while at < len(s):
            if m := tag.match(s, at):
                at, ends, alone = m.end(), bool(m[1]), False
                while at < len(s) and s[at] != ">":
                    if s[at] in "\"'":
                        at = s.find(s[at], at + 1) + 1 or len(s)
                    elif s[at] == "{":
                        at = self.run(at + 1, "}")
                        self.add("punct", ",", at - 1, at)
                    else:
                        alone = s[at] == "/"
                        at += 1
                at += 1
                depth += -1 if ends else 0 if alone else 1
                if depth <= 0:
                    break
            elif s[at] == "{":
                at = self.run(at + 1, "}")
                self.add("punct", ",", at - 1, at)
            else:
                at += 1
        at = min(at, len(s))
        self.add("punct", "]", max(at - 1, 0), at)
        return at

    def matched(self) -> dict[int, int]:
        out, open_ = {}, []
        for k, text in enumerate(self.text):
            if text in "()[]{}" and self.kind[k] in ("punct", "template"):
                if text in ("(", "[", "{"):
                    open_.append(k)
                elif text in CLOSERS:
                    if any(self.text[o] == CLOSERS[text] for o in open_[-40:]):
                        while self.text[open_[-1]] != CLOSERS[text]:
                            self.problems.append((self.start[open_[-1]], "TS1005", f"'{self.text[open_.pop()]}' is not closed"))
                        out[open_.pop()] = k
                    else:
                        self.problems.append((self.start[k], "TS1128", f"'{text}' closes nothing"))
        self.problems += [(self.start[k], "TS1005", f"'{self.text[k]}' is not closed") for k in open_]
        return out


@dataclass
class Shape:
    """What an expression is: kind, name (of what is called, made or named), its callee text, its first and last token, its call."""

    kind: str
    name: str | None
    callee: str | None
    first: int
    last: int
    call: dict | None = None
    response: dict | None = None
    status: int | None = None


class Walk:
    def __init__(self, source: str, path: str):
        self.t = Tokens(source, not path.endswith((".ts", ".mts", ".cts")))
        self.kind, self.text, self.close, self.n = self.t.kind, self.t.text, self.t.close, len(self.t.kind)
        self.language = "javascript" if self.t.jsx else "typescript"
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.i, self.scopes, self.asyncs, self.found = 0, [], [], []
        self.branch = 0  # inside the first part of a conditional, where (x): y => z is no typed arrow
        while self.i < self.n:
            self.step(self.statement, self.n)

    # Places and rows

    def at(self, k: int) -> int:
        return self.t.start[k] if k < self.n else len(self.t.source)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def said(self, a: int, b: int, most: int | None = MOST_SAID) -> str:
        """The text of the tokens from a to before b, on one line."""
        return re.sub(r"\s+", " ", self.t.source[self.at(a) : self.t.end[b - 1]] if b > a else "").strip()[:most]

    def emit(self, fact: str, a: int, b: int, fields: dict) -> None:
        self.found.append((self.at(a), -(self.t.end[min(b, self.n) - 1] if b else 0), len(self.found), fact, fields))

    def rows(self) -> Iterator[Row]:
        for a, _, _, fact, fields in sorted(self.found, key=lambda x: x[:3]):
            yield fact, self.line(a), fields
        for a, code, message in self.t.problems:
            yield "problem", self.line(a), {"code": code, "message": message}

    @property
    def scope(self) -> str | None:
        return self.scopes[-1] if self.scopes else None

    def entity(self, kind: str, name: str, a: int, b: int, **more) -> str:
        qualified = f"{self.scope}.{name}" if self.scope else name
        self.emit("entity", a, b, {"kind": kind, "name": name, "qualified": qualified, "end": self.line(self.t.end[b - 1] - 1), "language": self.language, **more})
        return qualified

    def inside(self, qualified: str | None, walk, *args, is_async: bool = False):
        """``walk`` with a scope around it."""
        if qualified is None:
            return walk(*args)
        self.scopes.append(qualified)
        self.asyncs.append(is_async)
        out = walk(*args)
        self.scopes.pop()
        self.asyncs.pop()
        return out

    # Tokens

    def is_(self, *texts: str) -> bool:
        return self.i < self.n and self.text[self.i] in texts and self.kind[self.i] in ("punct", "name")

    def ahead(self, k: int) -> str:
        return self.text[k] if k < self.n and self.kind[k] in ("punct", "name", "template") else ""

    def partner(self, k: int) -> int:
        return self.close.get(k, self.n)

    def step(self, walk, *args):
        """``walk`` that goes on by a token at least."""
        before = self.i
        out = walk(*args)
        self.i = max(self.i, before + 1)
        return out

    def upto(self, end: int, walk, *args) -> None:
        while self.i < end:
            if self.is_(",", ";"):
                self.i += 1
            else:
                self.step(walk, *args)
        self.i = min(end + 1, self.n)

    # Types, which are skipped

    def type_end(self, k: int) -> int:
        """The place after the type that begins at k."""
        while self.ahead(k) in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract", "new", "|", "&", "-", "...") and self.ahead(k + 1) not in (",", ")", ">", "="):
            k += 1
        if self.ahead(k) == "<":
            k = self.angle_end(k) or k + 1
        text = listed = self.ahead(k)
        if text in ("(", "[", "{"):
            k = self.partner(k) + 1
        elif k < self.n and (self.kind[k] in ("name", "string", "number")):
            k += 1
            while self.ahead(k) == "." and k + 1 < self.n:
                k += 2
            if self.ahead(k) == "(" and text == "import":
                k = self.partner(k) + 1
                while self.ahead(k) == ".":
                    k += 2
        else:
            return k
        while k < self.n:
            text = self.ahead(k)
            if text == "<" and (end := self.angle_end(k)):
                k = end
            elif text == "[" and not self.t.fresh[k]:
                k = self.partner(k) + 1
            elif text in ("|", "&", "is") or text == "=>" and listed == "(":
                return self.type_end(k + 1)
            elif text == "extends":
                k = self.type_end(k + 1)
                if self.ahead(k) != "?":
                    return k
                k = self.type_end(k + 1)
                return self.type_end(k + 1) if self.ahead(k) == ":" else k
            else:
                break
        return k

    def angle_end(self, k: int) -> int | None:
        """The place after the type arguments or parameters whose < is at k; None if they aren't any."""
        k += 1
        while k < self.n:
            before = k
            while self.ahead(k) in ("const", "in", "out"):
                k += 1
            k = self.type_end(k)
            if self.ahead(k) == "=":
                k = self.type_end(k + 1)
            if self.ahead(k) == ">":
                return k + 1
            if self.ahead(k) != "," or k == before:
                return None
            k += 1
            if self.ahead(k) == ">":
                return k + 1
        return None

    # Statements

    def statement(self, end: int) -> None:
        first, text = self.i, self.ahead(self.i)
        following = self.ahead(first + 1)
        if self.kind[first] != "name" and text not in ("{", ";", "@"):
            return self.expressions(end)
        if text == ";":
            self.i += 1
        elif text == "{":
            self.block()
        elif text == "@" or text in MODIFIERS or text in ("class", "function", "interface", "enum", "namespace", "module", "type", "import"):
            return self.declaration(first, end)
        elif text in ("var", "let") and (following in ("[", "{") or first + 1 < self.n and self.kind[first + 1] == "name"):
            self.variables(end)
        elif text == "if" and following == "(":
            self.i += 1
            self.flow("branch", first, self.head())
            self.step(self.statement, end)
            if self.is_("else"):
                self.i += 1
                self.step(self.statement, end)
        elif text == "for":
            self.loop(first, end)
        elif text == "while" and following == "(":
            self.i += 1
            self.flow("loop", first, self.head())
            self.step(self.statement, end)
        elif text == "do":
            place = len(self.found)
            self.i += 1
            self.step(self.statement, end)
            if self.is_("while"):
                self.i += 1
                self.flow("loop", first, self.head(), place)
        elif text == "switch" and following == "(":
            self.i += 1
            self.flow("branch", first, self.head())
            if self.is_("{"):
                close = self.partner(self.i)
                self.i += 1
                self.upto(close, self.case, close)
        elif text == "try" and following == "{":
            self.flow("handler", first, None)
            self.i += 1
            self.block()
            if self.is_("catch"):
                self.i += 1
                if self.is_("("):
                    self.i = self.partner(self.i) + 1
                self.block()
            if self.is_("finally"):
                self.i += 1
                self.block()
        elif text == "return":
            self.returned(end)
        elif text == "throw":
            self.i += 1
            a = self.i
            self.expressions(end)
            self.failed(first, self.said(a, self.i), "throw")
        elif text in ("break", "continue", "debugger"):
            self.i += 1
            if self.i < self.n and self.kind[self.i] == "name" and not self.t.fresh[self.i]:
                self.i += 1
        elif following == ":" and text not in ("case", "default"):
            self.i += 2
        else:
            self.expressions(end)

    def block(self) -> None:
        if self.is_("{"):
            close = self.partner(self.i)
            self.i += 1
            while self.i < close:
                self.step(self.statement, close)
            self.i = min(close + 1, self.n)

    def case(self, end: int) -> None:
        if self.is_("case"):
            self.i += 1
            self.branch += 1
            self.expressions(end)
            self.branch -= 1
            self.i += self.is_(":")
        elif self.is_("default") and self.ahead(self.i + 1) == ":":
            self.i += 2
        else:
            self.statement(end)

    def head(self) -> str:
        """The text in brackets after a statement's word, walked."""
        if not self.is_("("):
            return ""
        a, close = self.i + 1, self.partner(self.i)
        self.i = a
        self.upto(close, self.expressions, close)
        return self.said(a, close)

    def loop(self, first: int, end: int) -> None:
        self.i += 1 + (self.ahead(self.i + 1) == "await")
        if self.is_("("):
            a, close, said, parts = self.i + 1, self.partner(self.i), "", []
            self.i = a
            of = None
            if self.is_("var", "let", "const"):
                self.variables(close, heads=True)
            elif not self.is_(";"):
                self.expressions(close)
            if self.is_("of", "in"):
                of = self.i + 1
            else:  # an expression took the in
                of = next((k + 1 for k in range(a, self.i) if self.ahead(k) in ("in", "of") and k > a), None) if not self.is_(";") else None
            while self.i < close:
                if self.is_(";"):
                    parts.append(self.i)
                    self.i += 1
                elif self.is_("of", "in", ","):
                    self.i += 1
                else:
                    self.step(self.expressions, close)
            if of:
                said = self.said(of, close)
            elif parts:
                said = self.said(parts[0] + 1, parts[1] if len(parts) > 1 else close)
            self.i = min(close + 1, self.n)
            self.flow("loop", first, said)
        self.step(self.statement, end)

    def flow(self, kind: str, first: int, said: str | None, place: int | None = None) -> None:
        if self.scope:
            self.emit("marker", first, self.i, {"name": f"control.{kind}", "flow": kind, "scope": self.scope, "condition": said or None})

    def returned(self, end: int) -> None:
        first = self.i
        self.i += 1
        if self.i >= end or self.is_(";", "}") or self.t.fresh[self.i]:
            self.emit("return", first, first + 1, {"scope": self.scope, "kind": "bare"})
            return
        a = self.i
        shape = self.expressions(end)
        kind, name, awaited = self.classified(shape)
        if shape.call is not None and shape.kind in ("call", "awaited_call"):
            shape.call["result"] = kind
        if shape.response is not None:
            shape.response["returned"] = True
        self.emit("return", first, self.i, {"scope": self.scope, "kind": kind, "name": name, "awaited": awaited, "expression": self.said(a, self.i)})

    @staticmethod
    def classified(shape: Shape) -> tuple[str, str | None, bool]:
        return shape.kind, shape.name, shape.kind == "awaited_call"

    def failed(self, first: int, said: str, via: str) -> None:
        self.emit("throw", first, self.i, {"scope": self.scope, "via": via, "expression": said or None, "inAsyncFunction": any(self.asyncs) or None})

    # Declarations

    def declaration(self, first: int, end: int) -> None:
        decorators = []
        while self.is_("@") or (self.i < self.n and self.ahead(self.i) in MODIFIERS and self.declares(self.i)):
            if self.is_("@"):
                decorators.append(self.i + 1)
                self.i += 2
                while self.is_(".", "("):
                    self.i = self.partner(self.i) + 1 if self.is_("(") else self.i + 2
            else:
                self.i += 1
        words = [self.text[k] for k in range(first, self.i) if self.text[k] in MODIFIERS]
        text, named = self.ahead(self.i), self.i + 1 < self.n and self.kind[self.i + 1] == "name"
        if text == "class":
            self.class_(first, words, decorators)
        elif text == "function":
            self.function(first, words, named_only=True)
        elif text == "interface" and named:
            self.interface(first, words)
        elif text == "type" and named and self.ahead(self.i + 2) in ("=", "<"):
            name = self.text[self.i + 1]
            self.i += 2
            if self.is_("<"):
                self.i = self.angle_end(self.i) or self.i + 1
            self.i = self.type_end(self.i + 1) if self.is_("=") else self.i
            self.entity("type", name, first, self.i)
        elif text == "enum" and named:
            self.enum(first)
        elif text in ("namespace", "module", "global") and (named or self.ahead(self.i + 1) == "{" or self.i + 1 < self.n and self.kind[self.i + 1] == "string") and not self.t.fresh[self.i + 1]:
            while self.i < end and not self.is_("{", ";"):
                self.i += 1
            self.block()
        elif words[-1:] == ["const"] or text in ("var", "let"):
            self.i -= words[-1:] == ["const"]
            self.variables(end)
        elif text == "import" and self.ahead(self.i + 1) not in ("(", "."):
            self.import_(first)
        elif "export" in words and (text in ("{", "*") or text == "type" and self.ahead(self.i + 1) in ("{", "*")):
            self.reexport(first)
        elif "export" in words and text == "=":
            self.i += 1
            self.expressions(end)
        elif self.i < end:
            self.expressions(end)

    def declares(self, k: int) -> bool:
        """Whether the modifier at k is one: something that can be declared follows."""
        text, after = self.text[k], self.ahead(k + 1)
        if text in ("export", "default"):
            return True
        if text == "const":
            return k + 1 < self.n and (self.kind[k + 1] == "name" or after in ("[", "{"))
        if text == "async":
            return after == "function" and not self.t.fresh[k + 1]
        return after in MODIFIERS or after in ("class", "function", "interface", "type", "enum", "namespace", "module", "global", "var", "let", "const")

    def class_(self, first: int, words: list[str], decorators: list[int], declared: bool = True) -> None:
        self.i += 1
        name = "default"
        if self.i < self.n and self.kind[self.i] == "name" and not self.is_("extends", "implements"):
            name = self.text[self.i]
            self.i += 1
        if self.is_("<"):
            self.i = self.angle_end(self.i) or self.i + 1
        extends, implements, calls = [], [], []
        if self.is_("extends"):
            self.i += 1
            a = self.i
            while self.i < self.n and not self.is_("{", "implements", "<"):
                self.i = self.partner(self.i) + 1 if self.is_("(", "[") else self.i + 1
            extends = [self.said(a, self.i, None)]
            calls = [a] if any(self.text[k] == "(" for k in range(a, self.i)) else []
            if self.is_("<"):
                self.i = self.angle_end(self.i) or self.i + 1
        if self.is_("implements"):
            implements = self.names()
        while self.i < self.n and not self.is_("{", ";"):
            self.i += 1
        body = self.i
        qualified = self.entity("class", name, first, min(self.partner(body) + 1, self.n), extends="\x1f".join(extends) or None, implements="\x1f".join(implements) or None, modifiers=" ".join(words) or None) if declared else None

        def members() -> None:
            for k in [*decorators, *calls]:
                self.i = k
                self.operand(body)
            self.i = body
            if self.is_("{"):
                close = self.partner(body)
                self.i += 1
                self.upto(close, self.member, close)

        self.inside(qualified, members)

    def names(self) -> list[str]:
        """A list of type names after extends or implements, without their arguments."""
        out = []
        while True:
            self.i += 1
            a = self.i
            while self.i < self.n and (self.kind[self.i] == "name" or self.is_(".")) and not self.is_("implements"):
                self.i += 1
            out.append(self.said(a, self.i, None))
            if self.is_("<"):
                self.i = self.angle_end(self.i) or self.i + 1
            if not self.is_(","):
                return [x for x in out if x]

    def interface(self, first: int, words: list[str]) -> None:
        name = self.text[self.i + 1]
        self.i += 2
        if self.is_("<"):
            self.i = self.angle_end(self.i) or self.i + 1
        extends = self.names() if self.is_("extends") else []
        if self.is_("{"):
            self.i = min(self.partner(self.i) + 1, self.n)
        self.entity("interface", name, first, self.i, extends="\x1f".join(extends) or None, modifiers=" ".join(words) or None)

    def enum(self, first: int) -> None:
        name = self.text[self.i + 1]
        self.i += 2
        close = self.partner(self.i) if self.is_("{") else self.i
        qualified = self.entity("constant", name, first, min(close + 1, self.n))

        def member() -> None:
            a, kind = self.i, self.kind[self.i]
            own = self.text[a] if kind in ("name", "string", "number") else None
            self.i = self.partner(a) + 1 if self.is_("[") else a + 1
            if self.is_("="):
                self.i += 1
                self.expression(close)
            if own:
                self.entity("constant", own, a, self.i)

        if self.is_("{"):
            self.i += 1
            self.inside(qualified, self.upto, close, member)

    def member(self, end: int) -> None:
        """A member of a class."""
        first, words, decorators = self.i, [], []
        while self.i < end:
            if self.is_("@"):
                decorators.append(self.i + 1)
                self.i += 2
                while self.is_(".", "("):
                    self.i = self.partner(self.i) + 1 if self.is_("(") else self.i + 2
            elif (self.ahead(self.i) in MODIFIERS or self.is_("get", "set")) and self.ahead(self.i + 1) not in ("(", "=", ":", ";", "?", "!", "}", "<", ",") and not (self.ahead(self.i) != "static" and self.i + 1 < end and self.t.fresh[self.i + 1]):
                words.append(self.text[self.i])
                self.i += 1
            else:
                break
        if words[-1:] == ["static"] and self.is_("{"):
            return self.block()
        if self.is_("*"):
            self.i += 1
        self.property(first, words, decorators, end, True)

    def property(self, first: int, words: list[str], decorators: list[int], end: int, in_class: bool) -> None:
        """A name with a method's parameters, a type, a value, or none of them."""
        if self.i >= end:
            return
        kind, name = self.kind[self.i], self.text[self.i]
        key = self.i
        if self.is_("["):
            close = self.partner(self.i)
            if in_class and self.ahead(self.i + 2) == ":":  # an index signature
                self.i = close + 1
            else:
                self.i += 1
                self.upto(close, self.expression, close)
            name = None
        elif kind not in ("name", "string", "number"):
            return
        else:
            self.i += 1
            name = None if name[0] == "#" and kind == "name" else name
        while self.is_("?", "!"):
            self.i += 1
        if self.is_("(", "<"):
            accessor = words[-1:] in (["get"], ["set"])
            if name == "constructor" and in_class and kind == "name":
                words = None
            return self.callable(first, None if accessor else name, words, decorators)
        if in_class and self.is_(":"):
            self.i = self.type_end(self.i + 1)
            if self.is_("="):
                return self.initialised(first, name, None, end, decorators)
        elif in_class and self.is_("="):
            return self.initialised(first, name, None, end, decorators)
        elif self.is_(":", "="):
            self.i += 1
            self.expression(end)
        elif not in_class and self.i == key + 1 and kind == "punct":
            self.i += 1
        for k in decorators:
            at = self.i
            self.i = k
            self.operand(end)
            self.i = at

    def function(self, first: int, words: list[str], named_only: bool = False) -> Shape:
        """A function at its word."""
        self.i += 1
        if self.is_("*"):
            self.i += 1
        name = None
        if self.i < self.n and self.kind[self.i] == "name":
            name = self.text[self.i]
            self.i += 1
        self.callable(first, name if named_only else None, words, [])
        return Shape("expression", None, None, first, self.i)

    def callable(self, first: int, name: str | None, words: list[str] | None, decorators: list[int]) -> None:
        """Parameters, type and body of a function or method; an entity if it has a name."""
        a = self.i
        is_async = "async" in (words or [])
        end = self.signature_end()
        body_end = self.partner(end) + 1 if self.ahead(end) == "{" else end
        qualified = None
        if name:
            more = {} if words is None else {"isAsync": is_async, "modifiers": " ".join(words) or None}
            qualified = self.entity("function", name, first, min(max(body_end, end, 1), self.n), signature=self.signature(a, end), **more)

        def inner() -> None:
            for k in decorators:
                self.i = k
                self.operand(end)
            self.i = a
            self.parameters()
            self.i = end
            self.block()

        self.inside(qualified, inner, is_async=is_async)
        if self.is_(";"):
            self.i += 1

    def signature_end(self) -> int:
        """The place after type parameters, parameters and return type."""
        k = self.i
        if self.ahead(k) == "<":
            k = self.angle_end(k) or k + 1
        if self.ahead(k) == "(":
            k = self.partner(k) + 1
        return self.type_end(k + 1) if self.ahead(k) == ":" else k

    def signature(self, a: int, end: int) -> str:
        k = (self.angle_end(a) or a) if self.ahead(a) == "<" else a
        return self.said(k, min(end, self.n), None) if k < end else "()"

    def parameters(self) -> None:
        """Default values and decorators in parameters; their types are skipped."""
        if self.is_("<"):
            self.i = self.angle_end(self.i) or self.i + 1
        if self.is_("("):
            close = self.partner(self.i)
            self.i += 1
            self.upto(close, self.parameter, close)

    def parameter(self, end: int) -> None:
        if self.is_("@"):
            self.i += 1
            self.operand(end)
            return
        if self.is_("{", "["):
            close = self.partner(self.i)
            self.i += 1
            self.upto(close, self.parameter, close)
        elif self.is_("=", ":") and self.i:
            pass
        else:
            self.i += 1
        self.i += self.is_("?")
        if self.is_(":"):
            self.i = self.type_end(self.i + 1) if self.ahead(self.i + 1) not in ("{", "[") or self.typed() else self.i + 1
        if self.is_("="):
            self.i += 1
            self.expression(end)

    def typed(self) -> bool:
        """Whether the colon here is of a type, not of a pattern's renaming: a name or bracket of a parameter list stands before."""
        depth, k = 0, self.i - 1
        while k >= 0:
            text = self.ahead(k)
            if text in CLOSERS:
                depth += 1
            elif text in ("(", "[", "{"):
                if not depth:
                    return text == "("
                depth -= 1
            k -= 1
        return True

    def variables(self, end: int, heads: bool = False) -> None:
        self.i += 1
        while self.i < end:
            first = self.i
            name = None
            if self.is_("{", "["):
                close = self.partner(self.i)
                self.i += 1
                self.upto(close, self.parameter, close)
            elif self.kind[self.i] == "name":
                name = self.text[self.i]
                self.i += 1
            else:
                break
            self.i += self.is_("!")
            declared = None
            if self.is_(":"):
                a = self.i + 1
                self.i = self.type_end(a)
                declared = self.said(a, self.i, None)
            if self.is_("="):
                self.initialised(first, name, declared, end, [], bound=True)
            if not self.is_(","):
                break
            self.i += 1
        if not heads and self.is_(";"):
            self.i += 1

    def initialised(self, first: int, name: str | None, declared: str | None, end: int, decorators: list[int], bound: bool = False) -> None:
        """A name with a value: a function if the value is one, else a constant."""
        for k in decorators:
            at = self.i
            self.i = k
            self.operand(end)
            self.i = at
        self.i += 1
        a = self.i
        is_async, at = self.functional(a, end)
        if name is None:
            self.expression(end)
            return
        more = {"declaredType": declared} if declared else {}
        if at is None:
            shape = self.expression(end)
            self.entity("constant", name, first, self.i, **more)
            if bound and shape.kind in ("call", "awaited_call") and shape.name and (shape.first == a or shape.kind == "awaited_call"):
                self.emit("binding", first, self.i, {"name": name, "callee": shape.name, "awaited": shape.kind == "awaited_call" or None, "scope": self.scope})
            return
        qualified = f"{self.scope}.{name}" if self.scope else name
        place = len(self.found)
        self.inside(qualified, self.expression, end, is_async=is_async)
        self.entity("function", name, first, self.i, isAsync=is_async, signature=self.signature(*at), **more)
        self.found.insert(place, self.found.pop())

    def functional(self, a: int, end: int) -> tuple[bool, tuple[int, int] | None]:
        """(async, the span of the signature) if the expression at a is a function as a whole."""
        is_async = self.ahead(a) == "async" and self.ahead(a + 1) not in (",", ";", ")", "=>", ".", "=")
        k = a + is_async
        if self.ahead(k) == "function":
            k += 1 + (self.ahead(k + 1) == "*")
            k += k < self.n and self.kind[k] == "name"
            at, self.i = self.i, k
            span = (k, self.signature_end())
            self.i = at
            close = self.partner(span[1]) + 1
            return is_async, span if self.ahead(close) not in ("(", ".", "[", "?.") or (close < self.n and self.t.fresh[close] and self.ahead(close) == "[") else None
        arrow = self.arrow(k)
        return is_async, arrow and (k, arrow)

    def arrow(self, k: int) -> int | None:
        """The place of => if an arrow function begins at k."""
        if k < self.n and self.kind[k] == "name" and self.ahead(k + 1) == "=>":
            return k + 1
        if self.ahead(k) == "<":
            k = self.angle_end(k) or self.n
        if self.ahead(k) != "(" or k not in self.close:
            return None
        k = self.close[k] + 1
        if self.ahead(k) == ":" and not self.branch:
            k = self.type_end(k + 1)
        return k if self.ahead(k) == "=>" else None

    # Imports

    def imported(self, first: int, kind: str, specifier: str, names: list[str]) -> None:
        external = not specifier.startswith((".", "/", "node:"))
        self.emit("import", first, self.i, {"specifier": specifier, "kind": kind, "names": "\x1f".join(names), "external": external})

    def listed(self, close: int) -> list[str]:
        """The names in braces, each with its new one."""
        out, k = [], self.i + 1
        while k < close:
            b = k
            while b < close and self.text[b] != ",":
                b += 1
            if b > k:
                out.append(re.sub(r"^type (?!as\b)", "", self.said(k, b, None)))
            k = b + 1
        return out

    def import_(self, first: int) -> None:
        self.i += 1
        types = self.is_("type") and self.ahead(self.i + 1) not in ("from", ",", "=") and not (self.i + 1 < self.n and self.kind[self.i + 1] == "string")
        self.i += types
        names = []
        while self.i < self.n and self.kind[self.i] != "string":
            if self.is_("{"):
                names += self.listed(self.partner(self.i))
                self.i = self.partner(self.i) + 1
            elif self.is_("*"):
                names.append(self.said(self.i, self.i + 3, None))
                self.i += 3
            elif self.is_("from", ","):
                self.i += 1
            elif self.is_("="):  # import x = require("y")
                self.i += 3 if self.ahead(self.i + 1) == "require" else 1
                names = []
            elif self.kind[self.i] == "name" and not self.t.fresh[self.i] or self.i == first + 1:
                names.append(self.text[self.i])
                self.i += 1
            else:
                return
        if self.i < self.n:
            kind = "require" if self.text[self.i - 1] == "(" else "type_only" if types else "static"
            specifier = self.text[self.i]
            self.i += 1
            self.imported(first, kind, specifier, names)
            if self.is_(")"):
                self.i += 1
            if self.is_("with", "assert") and self.ahead(self.i + 1) == "{":
                self.i = self.partner(self.i + 1) + 1

    def reexport(self, first: int) -> None:
        types = self.is_("type")
        self.i += types
        names = []
        if self.is_("{"):
            names = self.listed(self.partner(self.i))
            self.i = self.partner(self.i) + 1
        else:
            self.i += 3 if self.ahead(self.i + 1) == "as" else 1
        if self.is_("from") and self.i + 1 < self.n and self.kind[self.i + 1] == "string":
            self.i += 2
            self.imported(first, "type_only" if types else "reexport", self.text[self.i - 1], names)

    # Expressions

    def expressions(self, end: int) -> Shape:
        """An expression, or several with commas between."""
        shape = self.expression(end)
        while self.i < end and self.is_(","):
            self.i += 1
            later = self.step(self.expression, end)
            shape = Shape("expression", None, None, shape.first, later.last)
        return shape

    def expression(self, end: int) -> Shape:
        """One expression without commas: operands and operators, conditionals, assignments."""
        begin, shape, parts = self.i, self.operand(end), 1
        while self.i < end:
            text = self.ahead(self.i)
            if text in ("as", "satisfies") and not self.t.fresh[self.i]:
                self.i = self.type_end(self.i + 1)
                shape = Shape("expression", None, None, shape.first, self.i)
            elif text in BINARY:
                self.i += 1
                while self.is_(">", "=") and self.at(self.i) == self.t.end[self.i - 1]:  # >>, >=
                    self.i += 1
                if text in ASSIGN:
                    begin = self.i
                self.step(self.operand, end) if self.i < end else None
                parts += 1
            elif text == "?":
                place = len(self.found)
                said = self.said(begin, self.i)
                mark = self.i
                self.i += 1
                self.branch += 1
                self.step(self.expression, end)
                self.branch -= 1
                if self.is_(":"):
                    self.i += 1
                    if self.scope:
                        self.found.insert(place, (self.at(begin), -self.t.end[mark], len(self.found), "marker", {"name": "control.branch", "flow": "branch", "scope": self.scope, "condition": said}))
                    begin = self.i
                    held, self.branch = self.branch, 0
                    self.step(self.operand, end) if self.i < end else None
                    self.branch = held
                parts += 1
            else:
                break
        return shape if parts == 1 else Shape("expression", None, None, shape.first, self.i)

    def operand(self, end: int) -> Shape:
        first = self.i
        if first >= end:
            return Shape("expression", None, None, first, first)
        text, kind = self.text[first], self.kind[first]
        if kind == "name" and self.ahead(first + 1) != "=>" or kind == "punct":
            if text in PREFIX and not (kind == "name" and self.ahead(first + 1) in (".", ",", ")", ";", "=", "")) or text in ("await", "yield") and self.i + 1 < end and self.kind[self.i + 1] in ("string", "number"):
                self.i += 1
                if text == "yield" and self.is_("*"):
                    self.i += 1
                if text == "yield" and self.i < end and (self.t.fresh[self.i] or self.is_(")", "]", "}", ";", ",")):
                    return Shape("expression", None, None, first, self.i)
                inner = self.operand(end)
                if text == "await" and inner.kind == "call":
                    if inner.call is not None:
                        inner.call["awaited"] = True
                        inner.call.setdefault("result", "awaited_call")
                    return Shape("awaited_call", inner.name, None, first, self.i, inner.call)  # what is awaited isn't what is returned
                if text == "await" and inner.kind in ("identifier", "literal", "constructor"):
                    return Shape(inner.kind, inner.name, None, first, self.i)
                return Shape("expression", None, None, first, self.i)
        return self.postfix(self.primary(end), end)

    def primary(self, end: int) -> Shape:
        first = self.i
        text, kind = self.text[first], self.kind[first]
        is_async, signature = self.functional(first, end) if kind == "name" or text in ("(", "<") else (False, None)
        if signature and self.ahead(first + is_async) != "function":
            self.i = first + is_async
            self.lambda_(signature[1], is_async, end)
            return Shape("expression", None, None, first, self.i)
        if kind in ("string", "number", "regex"):
            self.i += 1
            return Shape("expression" if kind == "regex" else "literal", None, None, first, self.i)
        if kind == "template":
            close = self.partner(first)
            self.i += 1
            self.upto(close, self.expression, close)
            return Shape("expression", None, None, first, self.i)
        if kind == "punct":
            if text == "(":
                close = self.partner(first)
                self.i += 1
                inner = self.expressions(close)
                self.i = min(close + 1, self.n)
                return Shape(inner.kind, inner.name, inner.callee, first, self.i, inner.call, inner.response)
            if text == "[":
                close = self.partner(first)
                self.i += 1
                self.upto(close, self.expression, close)
                return Shape("literal", None, None, first, self.i)
            if text == "{":
                close = self.partner(first)
                self.i += 1
                self.upto(close, self.entry, close)
                return Shape("literal", None, None, first, self.i)
            if text == "<" and (k := self.angle_end(first)):  # a type assertion
                self.i = k
                self.operand(end)
                return Shape("expression", None, None, first, self.i)
            if text == "@":
                self.i += 1
                return self.operand(end)
            self.i += text not in (")", "]", "}", ";", ",", ":")
            return Shape("expression", None, None, first, max(self.i, first))
        if text == "async" and self.ahead(first + 1) == "function":
            self.i += 1
            return self.function(first, ["async"])
        if text == "function":
            return self.function(first, [])
        if text == "class":
            self.class_(first, [], [], declared=False)
            return Shape("expression", None, None, first, self.i)
        if text == "new" and self.ahead(first + 1) != ".":
            return self.new(end)
        self.i += 1
        if text == "import" and self.is_("("):
            close = self.partner(self.i)
            self.i += 1
            if self.i < close and self.kind[self.i] == "string":
                specifier, at = self.text[self.i], self.i
                self.i = close + 1
                self.imported(first, "dynamic", specifier, [])
                self.i = at
            self.upto(close, self.expression, close)
            return Shape("call", None, None, first, self.i)
        if text in ("this", "super", "import", "new"):
            return Shape("expression", None, None, first, self.i)
        if text in ("true", "false", "null"):
            return Shape("literal", None, None, first, self.i)
        return Shape("identifier", text, text, first, self.i)

    def lambda_(self, arrow: int, is_async: bool, end: int) -> None:
        """An arrow function from its parameters on."""
        if self.is_("(", "<"):
            self.parameters()
        self.i = arrow + 1
        held, self.branch = self.branch, 0
        self.block() if self.is_("{") else self.expression(end)
        self.branch = held

    def entry(self, end: int) -> None:
        """An entry of an object literal."""
        if self.is_("..."):
            self.i += 1
            self.expression(end)
            return
        first, words = self.i, []
        while self.is_("async", "get", "set") and self.ahead(self.i + 1) not in ("(", ":", ",", "}", "=", "<"):
            words.append(self.text[self.i])
            self.i += 1
        if self.is_("*"):
            self.i += 1
        self.property(first, words, [], end, False)

    def new(self, end: int) -> Shape:
        first = self.i
        self.i += 1
        made = self.new(end) if self.is_("new") and self.ahead(self.i + 1) != "." else self.primary(end)
        while self.i < end and self.is_(".", "["):
            if self.is_("["):
                close = self.partner(self.i)
                self.i += 1
                self.upto(close, self.expression, close)
                made.callee = None
            else:
                name = self.text[self.i + 1] if self.i + 1 < end else ""
                made.callee = f"{made.callee}.{name}" if made.callee else name
                self.i += 2
        if self.is_("<") and (k := self.angle_end(self.i)) and self.ahead(k) == "(":
            self.i = k
        arguments = self.arguments() if self.is_("(") else []
        answer = self.response(first, "Response", arguments, None) if made.callee == "Response" else None
        return Shape("constructor", made.callee, f"new {made.callee or '?'}", first, self.i, response=answer)

    def arguments(self) -> list[Shape]:
        close, out = self.partner(self.i), []
        self.i += 1
        while self.i < close:
            if self.is_(","):
                self.i += 1
            else:
                out.append(self.step(self.expression, close))
        self.i = min(close + 1, self.n)
        return out

    def postfix(self, shape: Shape, end: int) -> Shape:
        first, status = shape.first, None
        while self.i < end:
            text, kind = self.text[self.i], self.kind[self.i]
            if kind == "punct" and text in (".", "?.") and self.i + 1 < end and self.kind[self.i + 1] == "name":
                name = self.text[self.i + 1]
                shape = Shape("expression", None, f"{shape.callee}.{name}" if shape.callee else name, first, self.i + 2)
                self.i += 2
            elif kind == "punct" and text == "?." and self.ahead(self.i + 1) in ("(", "["):
                self.i += 1
            elif kind == "punct" and text == "[" and not (self.t.fresh[self.i] and shape.kind == "literal"):
                close = self.partner(self.i)
                key = self.text[self.i + 1] if close == self.i + 2 and self.kind[self.i + 1] == "string" else None
                self.i += 1
                self.upto(close, self.expression, close)
                shape = Shape("expression", None, f"{shape.callee or ''}[{key}]" if key else None, first, self.i)
            elif kind == "punct" and text == "(":
                shape = self.called(shape, status)
                status = shape.status  # what a configuring call sets is the answer's that is built on it
            elif kind == "punct" and text == "<" and shape.kind in ("identifier", "expression") and (k := self.angle_end(self.i)) and self.ahead(k) == "(" and self.text[self.i - 1] != ")":
                self.i = k
            elif kind == "template" and self.t.source[self.at(self.i)] == "`" or kind == "string" and self.t.source[self.at(self.i)] == "`":
                self.primary(end)
                shape = Shape("expression", None, None, first, self.i)
            elif kind == "punct" and text == "!" and not self.t.fresh[self.i]:
                self.i += 1
                shape = Shape("expression", None, None, first, self.i)
            elif kind == "punct" and text in ("++", "--") and not self.t.fresh[self.i]:
                self.i += 1
                shape = Shape("expression", None, None, first, self.i)
            else:
                break
        return shape

    def called(self, callee: Shape, status: int | None) -> Shape:
        """A call at its opening bracket: the call, and what calls of its name stand for."""
        first, opening, name = callee.first, self.i, callee.callee
        close = self.partner(opening)
        last = (name or "").rsplit(".", 1)[-1]
        given = [opening + 1] if opening + 1 < close else []
        text = self.text[opening + 1] if given and self.kind[opening + 1] == "string" else None
        route = self.route(name, last, first, opening, close, text)
        call = {"callee": name, "scope": self.scope}
        if route and route[1]:
            self.i = opening + 3
            a = self.i
            is_async, _ = route[1]
            qualified = f"{self.scope}.{route[0]}" if self.scope else route[0]
            self.inside(qualified, self.expression, close, is_async=is_async)
            self.entity("function", route[0], a, self.i, isAsync=is_async, modifiers="async" if is_async else None, routeHandler=True, method=last.upper(), path=text)
            arguments = [Shape("literal", None, None, opening + 1, opening + 2), Shape("expression", None, None, a, self.i)]
            while self.i < close:
                if self.is_(","):
                    self.i += 1
                else:
                    arguments.append(self.step(self.expression, close))
            self.i = min(close + 1, self.n)
        else:
            arguments = self.arguments()
        if not name:
            return Shape("call", None, None, first, self.i)
        for a in arguments:
            if a.last == a.first + 1 and self.kind[a.first] == "string":
                self.sql(a.first)
        if name == "require" and text is not None:
            self.imported(first, "require", text, [])
        if last == "use" and "." in name and text is not None:
            self.emit("marker", first, self.i, {"name": "middleware.mount", "path": text, "target": self.said(first, self.i)})
        if name in SUITES | CASES and text is not None and callee.kind == "identifier":
            mode = arguments[1] if name in CASES and len(arguments) > 1 else None
            self.emit("marker", first, self.i, {"name": "test.suite" if name in SUITES else "test.case", "title": text, "mode": self.text[mode.first] if mode and mode.last == mode.first + 1 and self.kind[mode.first] == "string" else None})
        if name in ("Promise.reject", "reject"):
            self.failed(first, self.said(arguments[0].first, arguments[0].last) if arguments else "", "reject")
        self.emit("call", first, self.i, call | {"argCount": len(arguments)})
        call = self.found[-1][4]
        own, answer = self.number(arguments), None
        if last in CONFIGURERS:
            if own is not None and name.split(".")[0] in RESPONDERS and not (self.ahead(self.i) in (".", "?.") and self.ahead(self.i + 1) in PRODUCERS and self.ahead(self.i + 2) == "("):
                self.emit("response", first, self.i, {"method": "status", "status": own, "statusOnly": True, "scope": self.scope})
            return Shape("call", name, f"{name}()", first, self.i, call, status=own)
        if (last in PRODUCERS and "." in name) or name in MADE:
            answer = self.response(first, "Response" if name in MADE else last, arguments, own if own is not None else status)
        return Shape("call", name, f"{name}()", first, self.i, call, answer)

    def route(self, name: str | None, last: str, first: int, opening: int, close: int, path: str | None):
        """A route's marker, if the call registers one; its handler's name, and that an inline one is async and where its signature is."""
        if not name or path is None or last.lower() not in METHODS or "." not in name or "(" in name or "[" in name or name.split(".")[0] not in HOLDERS:
            return None
        fields = {"name": "http.route", "httpMethod": last.upper(), "path": path}
        inline = None
        handler = None
        if self.ahead(opening + 2) == "," and opening + 3 < close:
            is_async, signature = self.functional(opening + 3, close)
            if signature:
                handler, inline = f"{last.upper()} {path} handler", (is_async, signature)
                fields |= {"handler": handler, "handlerDerived": True}
            else:
                fields["handler"] = self.said(opening + 3, self.argument_end(opening + 3, close))
        self.emit("marker", first, opening + 1, fields)
        return handler, inline

    def argument_end(self, k: int, close: int) -> int:
        while k < close and self.text[k] != ",":
            k = self.partner(k) + 1 if self.ahead(k) in ("(", "[", "{") else k + 1
        return min(k, close)

    def number(self, arguments: list[Shape]) -> int | None:
        """The status that a first argument states."""
        a = arguments[0] if arguments else None
        if a is None or a.last != a.first + 1 or self.kind[a.first] not in ("number", "string"):
            return None
        text = self.text[a.first]
        return int(text) if re.fullmatch(r"\d+" if self.kind[a.first] == "number" else r"\d{3}", text) else None

    def response(self, first: int, method: str, arguments: list[Shape], status: int | None) -> dict:
        kind, name, _ = self.classified(arguments[0]) if arguments else (None, None, False)
        answer = {"method": method, "status": status, "statusOnly": False, "payload": name, "payloadKind": kind, "scope": self.scope}
        self.emit("response", first, self.i, answer)
        return answer

    def sql(self, k: int) -> None:
        """Markers for the tables that a string of SQL accesses, its table expressions, or that it can't be classified."""
        got = analyse(self.text[k]) if re.match(r"\s*[A-Za-z(]", self.text[k]) else None
        if not got:
            return
        base = {"scope": self.scope}
        if not got.tables:
            self.emit("marker", k, k + 1, {"name": "sql.statement", "summary": got.summary, "unsupported": got.reason, **base})
            return
        for table, operation, role in got.tables:
            self.emit("marker", k, k + 1, {"name": "sql.query", "table": table, "operation": operation, "role": role, "statement": got.summary, "statementCount": got.count, **base})
        if got.ctes:
            self.emit("marker", k, k + 1, {"name": "sql.cte", "names": ",".join(got.ctes), "statement": got.summary, **base})


def typescript(text: str, path: str = "") -> Iterator[Row]:
    yield from Walk(text, path).rows()
