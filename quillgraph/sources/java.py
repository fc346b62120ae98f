"""A structural scanner of Java sources, and the tables that come from it.

The scanner knows tokens, brackets and declarations, not expressions: types, fields, methods and constructors with their headers, statement
texts, and call sites with the written receiver. Names are resolved afterwards by joins. Code is kept as it stands in the source.
A file that doesn't scan gives one row with an error and no declarations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import boilerplate
from .tables import cut, ship

_LEX = re.compile(
    r'(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')'
    r"|(?P<word>[^\W\d]\w*|\$\w*)|(?P<number>\.?\d[\w.]*(?:[eE][+-]\w+)?)|(?P<op>->|::|\.\.\.|[-+*/%&|^<=!]=|&&|\|\||\+\+|--|[{}()\[\];,.<>@=+\-*/%&|^!?:~])",
    re.S,
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_NOT_CALLS = frozenset("if for while switch catch synchronized return new throw else do try assert super this yield case when".split())
_COUNT = re.compile(TOKEN)


class ScanError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


@dataclass
class Type:
    kind: str
    name: str
    outer: str | None
    signature: str
    annotations: list[str]
    extends: list[str]
    implements: list[str]
    fields: list[tuple[str, str, str]] = field(default_factory=list)
    declarations: list[str] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)


def lex(source: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise ScanError(f"unexpected character in line {line}")
        if m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup or "", m[0], m.start(), m.end(), line))
        line += m[0].count("\n")
        at = m.end()
    return out


def _type_text(tokens: list[Token]) -> str:
    """A type in one spelling: a space after commas and around words only."""
    out = ""
    for t in tokens:
        if out and (out[-1] == "," or (out[-1].isalnum() or out[-1] in "_?") and (t.text[0].isalnum() or t.text[0] in "_?@") or t.text == "&" or out[-1] == "&"):
            out += " "
        out += t.text
    return out


class Scanner:
    def __init__(self, source: str):
        self.source, self.t = source, lex(source)
        self.close = self._brackets()
        self.package, self.imports, self.types = "", [], []

    def _brackets(self) -> dict[int, int]:
        pairs, stack, match = {"(": ")", "[": "]", "{": "}"}, [], {}
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in pairs:
                stack.append((i, pairs[t.text]))
            elif t.kind == "op" and t.text in ")]}":
                if not stack or stack[-1][1] != t.text:
                    raise ScanError(f"unbalanced {t.text} in line {t.line}")
                match[stack.pop()[0]] = i
        if stack:
            raise ScanError(f"unclosed {self.t[stack[-1][0]].text} in line {self.t[stack[-1][0]].line}")
        return match

    def _is(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i].text == text and self.t[i].kind != "text"

    def _slice(self, a: int, b: int) -> str:
        return self.source[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def _angle(self, i: int) -> int:
        """The place after the type arguments that begin at i."""
        depth = 0
        while i < len(self.t):
            depth += self._is(i, "<") - self._is(i, ">")
            i += 1
            if not depth:
                return i
        raise ScanError("unclosed type arguments")

    def _annotation(self, i: int) -> int:
        i += 2
        while self._is(i, "."):
            i += 2
        return self.close[i] + 1 if self._is(i, "(") else i

    def _modifiers(self, i: int) -> tuple[int, list[str], list[str]]:
        annotations, modifiers = [], []
        while i < len(self.t):
            if self._is(i, "@") and not self._is(i + 1, "interface"):
                end = self._annotation(i)
                annotations.append(self._slice(i, end))
                i = end
            elif self.t[i].kind == "word" and self.t[i].text in _MODIFIERS and not (self.t[i].text == "default" and (self._is(i + 1, ":") or self._is(i + 1, "->"))):
                modifiers.append(self.t[i].text)
                i += 1
            elif self._is(i, "non") and self._is(i + 1, "-"):
                modifiers.append("non-sealed")
                i += 3
            else:
                break
        return i, annotations, modifiers

    def scan(self) -> Scanner:
        i = 0
        while i < len(self.t):
            at, annotations, modifiers = self._modifiers(i)
            if self._is(at, "package"):
                end = self._until(at, ";")
                self.package, i = _type_text(self.t[at + 1 : end]), end + 1
            elif self._is(at, "import"):
                end = self._until(at, ";")
                self.imports.append(self._slice(at, end + 1))
                i = end + 1
            elif self._is(at, ";"):
                i = at + 1
            elif (kind := self._type_kind(at)) is not None:
                i = self._declared(at, kind, annotations, modifiers, None)
            else:
                raise ScanError(f"no declaration in line {self.t[min(at, len(self.t) - 1)].line}")
        return self

    def _until(self, i: int, *ends: str) -> int:
        """The first of `ends` outside brackets."""
        while i < len(self.t):
            if self.t[i].kind == "op" and self.t[i].text in ends:
                return i
            i = self.close[i] + 1 if i in self.close else i + 1
        raise ScanError(f"no {ends[0]} up to the end")

    def _type_kind(self, i: int) -> str | None:
        if self._is(i, "@") and self._is(i + 1, "interface"):
            return "@interface"
        if i + 1 < len(self.t) and self.t[i].kind == "word" and self.t[i + 1].kind == "word":
            if self.t[i].text in ("class", "interface", "enum"):
                return self.t[i].text
            if self.t[i].text == "record" and (self._is(i + 2, "(") or self._is(i + 2, "<")):
                return "record"
        return None

    def _type_list(self, a: int, b: int) -> list[str]:
        out, at = [], a
        while at < b:
            end = at
            while end < b and not self._is(end, ","):
                end = self._angle(end) if self._is(end, "<") else end + 1
            out.append(_type_text(self.t[at:end]))
            at = end + 1
        return out

    def _declared(self, i: int, kind: str, annotations: list[str], modifiers: list[str], outer: str | None) -> int:
        i += 2 if kind == "@interface" else 1
        name, i = self.t[i].text, i + 1
        if self._is(i, "<"):
            i = self._angle(i)
        if kind == "record" and self._is(i, "("):
            i = self.close[i] + 1
        clauses: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        while not self._is(i, "{"):
            if i >= len(self.t) or self.t[i].text not in clauses:
                raise ScanError(f"bad header of {name}")
            end = i + 1
            while end < len(self.t) and not self._is(end, "{") and self.t[end].text not in clauses:
                end = self._angle(end) if self._is(end, "<") else end + 1
            clauses[self.t[i].text] = self._type_list(i + 1, end)
            i = end
        words = [*modifiers, kind, name]
        signature = " ".join(words) + "".join(f" {k} {', '.join(clauses[k])}" for k in ("extends", "implements") if clauses[k])
        own = Type(kind, name, outer, signature, annotations, clauses["extends"], clauses["implements"])
        if kind in ("class", "interface"):
            self.types.append(own)
        self._body(i, own, name if kind in ("class", "interface") else outer)
        return self.close[i] + 1

    def _body(self, open_: int, own: Type, outer: str | None) -> None:
        i, end = open_ + 1, self.close[open_]
        if own.kind == "enum":
            i = self._constants(i, end, outer)
        while i < end:
            if self._is(i, ";"):
                i += 1
                continue
            start = i
            i, annotations, modifiers = self._modifiers(i)
            if self._is(i, "{"):
                self._local_types(i, outer)
                i = self.close[i] + 1
            elif (kind := self._type_kind(i)) is not None:
                i = self._declared(i, kind, annotations, modifiers, outer)
            else:
                i = self._member(start, i, end, own, annotations, modifiers, outer)

    def _constants(self, i: int, end: int, outer: str | None) -> int:
        while i < end and not self._is(i, ";"):
            if self._is(i, "{"):
                self._local_types(i, outer)
            i = self.close[i] + 1 if i in self.close else i + 1
        return i + 1

    def _local_types(self, open_: int, outer: str | None) -> None:
        """Types declared inside a body, and members of anonymous classes are not looked at."""
        i = open_ + 1
        while i < self.close[open_]:
            before = self.t[i - 1].text
            if before not in (".", "::") and (kind := self._type_kind(i)) is not None and before in ("{", "}", ";", *_MODIFIERS):
                i = self._declared(i, kind, [], [before] if before in _MODIFIERS else [], outer)
            else:
                i += 1

    def _member(self, start: int, i: int, end: int, own: Type, annotations: list[str], modifiers: list[str], outer: str | None) -> int:
        if self._is(i, "<"):
            i = self._angle(i)
        head = i
        while i < end and not (self.t[i].kind == "op" and self.t[i].text in ("(", ";", "=", ",", "{")):
            i = self._annotation(i) if self._is(i, "@") else self._angle(i) if self._is(i, "<") else i + 1
        if i >= end or i == head:
            raise ScanError(f"bad member in line {self.t[start].line}")
        if self._is(i, "(") or self._is(i, "{") and own.kind == "record" and i - head == 1:
            return self._method(start, head, i, end, own, annotations, modifiers, outer)
        if self._is(i, "{"):
            raise ScanError(f"bad member in line {self.t[start].line}")
        stop = self._until(head, ";")
        names_at = i - 1
        while self._is(names_at, "]") or self._is(names_at, "["):
            names_at -= 1
        kind = _type_text(self.t[head:names_at])
        text = self._slice(start, stop + 1)
        own.declarations.append(" ".join(text.split()))
        at = names_at
        while at < stop:
            name, dims, nxt = self.t[at].text, "", at + 1
            while self._is(nxt, "["):
                dims, nxt = dims + "[]", nxt + 2
            own.fields.append((name, kind + dims, " ".join(text.split())))
            while nxt < stop and not self._is(nxt, ","):
                nxt = self.close[nxt] + 1 if nxt in self.close else self._angle(nxt) if self._is(nxt, "<") and self.t[nxt - 1].text in ("new",) else nxt + 1
            at = nxt + 1
            if at < stop and not (self.t[at].kind == "word" and (self._is(at + 1, "=") or self._is(at + 1, ",") or self._is(at + 1, ";") or self._is(at + 1, "["))):
                break
        return stop + 1

    def _params(self, open_: int) -> list[tuple[str, str, bool]]:
        """(type, name, varargs) of each parameter."""
        out, at, end = [], open_ + 1, self.close[open_]
        while at < end:
            stop = at
            while stop < end and not self._is(stop, ","):
                stop = self.close[stop] + 1 if stop in self.close else self._angle(stop) if self._is(stop, "<") else stop + 1
            first, _, _ = self._modifiers(at)
            last, dims = stop - 1, ""
            while self._is(last, "]"):
                dims, last = dims + "[]", last - 2
            kind = self.t[first:last]
            varargs = bool(kind) and kind[-1].text == "..."
            if self.t[last].text != "this":
                out.append((_type_text(kind[:-1] if varargs else kind) + dims, self.t[last].text, varargs))
            at = stop + 1
        return out

    def _method(self, start: int, head: int, paren: int, end: int, own: Type, annotations: list[str], modifiers: list[str], outer: str | None) -> int:
        name = self.t[paren - 1].text
        constructor = paren - 1 == head
        params = self._params(paren) if self._is(paren, "(") else []
        i = self.close[paren] + 1 if self._is(paren, "(") else paren
        returns = _type_text(self.t[head : paren - 1])
        while self._is(i, "["):
            returns, i = returns + "[]", i + 2
        throws: list[str] = []
        if self._is(i, "throws"):
            stop = i + 1
            while stop < end and not self._is(stop, "{") and not self._is(stop, ";"):
                stop += 1
            throws, i = self._type_list(i + 1, stop), stop
        if self._is(i, "default"):
            i = self._until(i, ";")
        statements: list[tuple[int, int]] = []
        if self._is(i, "{"):
            statements, after = self._statements(i), self.close[i] + 1
            body = self._slice(i, after)
            self._local_types(i, outer)
            calls = self._calls(i + 1, self.close[i])
            names = self._declared_names(i + 1, self.close[i])
        elif self._is(i, ";"):
            after, body, calls, names = i + 1, None, [], []
        else:
            raise ScanError(f"no body of {name} in line {self.t[start].line}")
        access = next((m for m in modifiers if m in ("public", "protected", "private")), "")
        words = [access, *(m for m in ("static", "abstract", "final", "native", "synchronized") if m in modifiers), "" if constructor else returns]
        shown = ", ".join(f"{t}{'...' if v else ''} {n}" for t, n, v in params)
        signature = " ".join(w for w in words if w) + " " + f"{name}({shown})" + (f" throws {', '.join(throws)}" if throws else "")
        first = self._kind(*statements[0]) if statements else None
        own.methods.append({
            "name": "<init>" if constructor else name, "shown_name": name, "return_type": None if constructor else returns, "param_types": [t for t, _, _ in params], "params": [f"{t} {n}" for t, n, _ in params],
            "visibility": access or "package-private", "throws": throws, "annotations": annotations, "signature": signature.strip(), "code": self._slice(start, after), "body": body,
            "start_line": self.t[start].line, "end_line": self.t[after - 1].line, "n_statements": len(statements) if body is not None else None, "first_kind": first,
            "statements": [self._slice(a, b) for a, b in statements], "header": "\n".join([*annotations, signature.strip() + " {"]),
            "calls": calls, "scope": [(n, t) for t, n, _ in params] + names,
        })
        return after

    def _statements(self, open_: int) -> list[tuple[int, int]]:
        out, i, end = [], open_ + 1, self.close[open_]
        while i < end:
            stop = self._statement(i, end)
            out.append((i, stop))
            i = stop
        return out

    def _statement(self, i: int, end: int) -> int:
        """The place after the statement at i."""
        word = self.t[i].text
        if self._is(i, "{"):
            return self.close[i] + 1
        if self._type_kind(i) is not None:
            return self.close[self._until(i, "{")] + 1
        if word in ("if", "while", "for", "switch", "synchronized", "catch") and self._is(i + 1, "("):
            at = self._statement(self.close[i + 1] + 1, end)
            if word == "if" and at < end and self._is(at, "else"):
                at = self._statement(at + 1, end)
            return at
        if word == "do":
            return self._until(self._statement(i + 1, end), ";") + 1
        if word == "try":
            at = self.close[i + 1] + 1 if self._is(i + 1, "(") else i + 1
            at = self._statement(at, end)
            while at < end and self.t[at].text in ("catch", "finally"):
                at = self._statement(at, end) if self._is(at, "catch") else self._statement(at + 1, end)
            return at
        if self.t[i].kind == "word" and self._is(i + 1, ":") and word not in ("case", "default"):
            return self._statement(i + 2, end)
        return min(self._until(i, ";") + 1, end)

    def _kind(self, a: int, b: int) -> str:
        if self._is(a, "return"):
            return "return"
        i = a
        while i < b:
            if self.t[i].kind == "op" and self.t[i].text.endswith("=") and self.t[i].text not in ("==", "!=", "<=", ">="):
                words = [t for t in self.t[a:i] if t.kind == "word" and t.text != "this"]
                declared = len(words) > 1 and not any(self._is(k, ".") for k in range(a, i)) and self.t[a + 1].kind == "word"
                return "declare" if declared else "assign"
            i = self.close[i] + 1 if i in self.close else i + 1
        return "other"

    def _calls(self, a: int, b: int) -> list[tuple[str, str, int, int | None, list[str]]]:
        """(written receiver, name, number of arguments, place of the call that is the receiver, arguments) of each call, in source order;
        constructors don't count."""
        out, places, opens = [], {}, {v: k for k, v in self.close.items() if a <= k}
        for i in range(a, b - 1):
            t = self.t[i]
            if t.kind != "word" or not self._is(i + 1, "(") or t.text in _NOT_CALLS:
                continue
            k = i - 1
            if self.t[k].text == ">" and i - 1 > a:
                depth = 0
                while k >= a:
                    depth += self._is(k, ">") - self._is(k, "<")
                    k -= 1
                    if not depth:
                        break
            if self.t[i - 1].text == "new" or self.t[i - 1].kind == "word" and self.t[i - 1].text not in ("return", "throw", "else", "do", "case", "yield", "assert"):
                continue
            scope = self._receiver(k, a) if self._is(k, ".") else ""
            if scope.startswith("new ") and scope.count("(") == 0:
                continue
            at, end, begin, given = i + 2, self.close[i + 1], i + 2, []
            while at < end:
                if self._is(at, ","):
                    given.append((begin, at))
                    begin = at + 1
                if self._is(at, "<") and self.t[at - 1].text in (".", "new"):
                    at = self._angle(at)
                    continue
                at = self.close[at] + 1 if at in self.close else at + 1
            given += [(begin, end)] if begin < end else []
            places[i + 1] = len(out)
            inner = places.get(opens.get(k - 1)) if scope and self._is(k, ".") else None
            out.append((scope, t.text, len(given), inner, [" ".join(self._slice(x, y).split()) for x, y in given]))
        return out

    def _receiver(self, dot: int, a: int) -> str:
        """The text before a dot, back to the start of its chain."""
        opens = {v: k for k, v in self.close.items() if a <= k}
        i = dot - 1
        while i >= a:
            if i in opens:
                i = opens[i]
                if i - 1 >= a and (self.t[i - 1].kind == "word" and self.t[i - 1].text not in ("return", "if", "while", "for", "switch") or i - 1 in opens):
                    i -= 1
                    continue
            if i - 1 >= a and self.t[i - 1].text == "new":
                i -= 1
                break
            if i - 2 >= a and self._is(i - 1, "."):
                i -= 2
                continue
            break
        return " ".join(self._slice(max(i, a), dot).split())

    def _declared_names(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name, type) of local variables, by the shape `Type name =` or `Type name :` or `Type name ;`."""
        out = []
        for i in range(a + 1, b - 1):
            if self.t[i].kind != "word" or not (self.t[i + 1].text in ("=", ":", ";") and self.t[i + 1].kind == "op"):
                continue
            j = i - 1
            while j > a and self._is(j, "]"):
                j -= 2
            if self._is(j, ">"):
                depth, k = 0, j
                while k >= a:
                    depth += self._is(k, ">") - self._is(k, "<")
                    k -= 1
                    if not depth:
                        break
                j = k
            if self.t[j].kind == "word" and self.t[j].text not in _NOT_CALLS and self.t[j].text not in _MODIFIERS and self.t[j].text not in ("package", "import", "break", "continue", "goto"):
                k = j
                while k - 2 >= a and self._is(k - 1, "."):
                    k -= 2
                out.append((self.t[i].text, _type_text(self.t[k:i])))
        return out


def count_tokens(text: str) -> int:
    return len(_COUNT.findall(text))


def pack_lines(code: str, budget: int, count=count_tokens) -> list[str]:
    """F4."""
    parts, open_, n = [], "", 0
    lines = code.split("\n")
    while lines and not lines[-1]:
        lines.pop()
    for line in lines:
        k = count(line + "\n")
        if open_ and n + k > budget:
            parts.append(open_)
            open_, n = "", 0
        open_, n = open_ + line + "\n", n + k
    return [*parts, open_] if open_ else parts


def pack_statements(header: str, statements: list[str], code: str, budget: int, count=count_tokens) -> list[str]:
    """header and footer in each part, outside the budget; a longer statement is cut into lines."""
    parts, body, n = [], "", 0
    for s in statements:
        k = count(s + "\n")
        for piece, size in ((p, count(p)) for p in pack_lines(s, budget, count)) if k > budget else ((s, k),):
            if body and n + size > budget:
                parts.append(f"{header}\n{body}\n}}")
                body, n = "", 0
            body, n = body + piece + ("" if piece.endswith("\n") else "\n"), n + size
    if body:
        parts.append(f"{header}\n{body}\n}}")
    return parts or pack_lines(code, budget, count)


def split_method(m: dict, budget: int, count=count_tokens) -> list[str]:
    """whole if it fits; methods by statements, constructors by lines."""
    if count(m["code"]) <= budget:
        return [m["code"]]
    if m["name"] == "<init>" or not m["statements"]:
        return pack_lines(m["code"], budget, count) or [""]
    return pack_statements(m["header"], m["statements"], m["code"], budget, count)


#: Parts that the subtypes of one type are dealt to while ancestors are joined.
SALTS = 8
_METHOD = (
    "array<struct<name:string,shown_name:string,return_type:string,param_types:array<string>,params:array<string>,visibility:string,throws:array<string>,annotations:array<string>,signature:string,"
    "code:string,body:string,start_line:int,end_line:int,n_statements:int,first_kind:string,parts:array<string>,calls:array<struct<scope:string,name:string,args:int,inner:int,given:array<string>>>,"
    "scope:array<struct<name:string,type:string>>>>"
)
FILE = (
    "file_path string, error string, package_name string, imports array<string>, types array<struct<kind:string,name:string,outer:string,signature:string,annotations:array<string>,extends:array<string>,"
    f"implements:array<string>,fields:array<struct<name:string,type:string,declaration:string>>,declarations:array<string>,methods:{_METHOD}>>"
)


def scan_source(source: str, budget: int, count=count_tokens) -> dict:
    s = Scanner(source).scan()
    types = []
    for t in s.types:
        methods = []
        for m in t.methods:
            keep = {k: v for k, v in m.items() if k not in ("statements", "header", "calls", "scope")}
            keep |= {"parts": split_method(m, budget, count), "calls": [dict(zip(("scope", "name", "args", "inner", "given"), c, strict=True)) for c in m["calls"]], "scope": [{"name": n, "type": k} for n, k in m["scope"]]}
            methods.append(keep)
        types.append({
            "kind": t.kind, "name": t.name, "outer": t.outer, "signature": t.signature, "annotations": t.annotations, "extends": t.extends, "implements": t.implements,
            "fields": [{"name": n, "type": k, "declaration": d} for n, k, d in t.fields], "declarations": t.declarations, "methods": methods,
        })
    return {"package_name": s.package, "imports": s.imports, "types": types}


def read_files(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """(file_path, source) of all *.java under the roots that exist; file_path is relative to the root."""
    paths, hadoop = [], spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in (root, *more):
        where = hadoop(p)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            paths.append(p)
    if not paths:
        return spark.createDataFrame([], "file_path string, source string")
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").text(paths, wholetext=True)
    full = F.regexp_replace(F.input_file_name(), r"^[a-z]+:/*(?=/)", "")
    base = "|".join(re.escape(p.removeprefix("file://").rstrip("/") + "/") for p in paths)
    return texts.select(F.regexp_replace(full, f"^(?:{base})", "").alias("file_path"), F.col("value").alias("source"))


def read_roots(spark: SparkSession, roots: list[str], fallback: str) -> DataFrame:
    """The source roots, or the whole repository if they hold no file."""
    found = read_files(spark, *roots) if roots else spark.createDataFrame([], "file_path string, source string")
    return read_files(spark, fallback) if found.isEmpty() else found


def read_listed(spark: SparkSession, files: list[str]) -> DataFrame:
    """S3: the named files; those that don't end in .java are skipped."""
    own = [f for f in files if f.endswith(".java")]
    if not own:
        return spark.createDataFrame([], "file_path string, source string")
    return spark.read.text(own, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("source"))


def scan(files: DataFrame, budget: int = 512) -> DataFrame:
    """One row for each file (FILE). Files are independent, so this is one pass without a shuffle."""

    ship(files.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = []
            for path, source in zip(pdf["file_path"], pdf["source"], strict=True):
                try:
                    rows.append({"file_path": path, "error": None, **scan_source(source or "", budget)})
                except (ScanError, IndexError, KeyError) as e:
                    rows.append({"file_path": path, "error": str(e) or type(e).__name__, "package_name": None, "imports": [], "types": []})
            yield pd.DataFrame(rows, columns=["file_path", "error", "package_name", "imports", "types"])

    return files.select("file_path", "source").mapInPandas(run, FILE)


class Tables:
    """The tables of a scanned tree: types, chunks, classes, fields, packages, edges (before admission), calls, errors."""

    def __init__(self, scanned: DataFrame, others: DataFrame | None = None):
        """others: rows of further files (name, outer, extends, implements, and methods' name, param_types and return_type of their types
        are read), against which names and calls are resolved, but which give no rows themselves."""
        scanned = cut(scanned)
        self.errors = scanned.where("error is not null").select("file_path", "error")
        self.types = self._typed(scanned)
        self.around = self._typed(others) if others is not None else None
        self.packages = scanned.where("package_name <> ''").select(F.col("package_name").alias("name")).distinct()
        self.known = self._every(lambda types: types.select("fq_name", F.col("t.name").alias("simple_name"), "pkg")).distinct()
        self.supers = cut(self._supers(self.types))
        self.every_supers = self.supers if others is None else self.supers.unionByName(self._supers(self.around)).distinct()
        self.classes = cut(self._classes())
        self.fields = self.types.select("fq_name", F.explode("t.fields").alias("f")).select(F.concat("fq_name", F.lit("."), "f.name").alias("fq_name"), F.col("f.name").alias("name"), F.col("f.declaration").alias("declaration"), F.col("f.type").alias("type"), F.col("fq_name").alias("owning_class_fqn"))
        self.methods = cut(self._methods())
        self.calls = cut(self._calls())
        self.chunks = cut(self._chunks())

    @staticmethod
    def _typed(scanned: DataFrame) -> DataFrame:
        fq = lambda name: F.when(F.col("pkg") == "", name).otherwise(F.concat("pkg", F.lit("."), name))
        types = scanned.withColumn("pkg", F.coalesce("package_name", F.lit(""))).select("file_path", "pkg", "imports", F.explode("types").alias("t"))
        return types.select("*", fq(F.col("t.name")).alias("fq_name")).withColumn("outer_fq", F.when(F.col("t.outer").isNotNull(), fq(F.col("t.outer"))))

    def _every(self, what) -> DataFrame:
        """What is read of the own types and of those around them."""
        return what(self.types) if self.around is None else what(self.types).unionByName(what(self.around))

    def resolve(self, rows: DataFrame, written: str) -> DataFrame:
        """Adds `resolved` to rows (pkg, imports, written type): an import, the same package, or null. Generics are erased."""
        name = F.regexp_replace(F.regexp_replace(F.col(written), r"<.*>", ""), r"[\[\].]+$", "")
        simple = F.substring_index(name, ".", -1)
        imported = F.get(F.filter(F.transform("imports", lambda i: F.regexp_replace(F.regexp_replace(i, r"^import\s+(static\s+)?", ""), r"\s*;$", "")), lambda i: F.endswith(i, F.concat(F.lit("."), simple))), 0)
        marked = rows.withColumn("_want", F.coalesce(imported, F.when(F.contains(name, F.lit(".")), name), F.when(F.col("pkg") == "", simple).otherwise(F.concat("pkg", F.lit("."), simple)))).withColumn("_imported", imported)
        own = self.known.select(F.col("fq_name").alias("_want"), F.lit(True).alias("_here")).distinct()
        return marked.join(own, "_want", "left").withColumn("resolved", F.coalesce(F.when(F.col("_here"), F.col("_want")), F.col("_imported"))).drop("_want", "_here", "_imported")

    def _supers(self, types: DataFrame) -> DataFrame:
        base = types.select("fq_name", "pkg", "imports", F.explode(F.concat(F.transform("t.extends", lambda x: F.struct(F.lit("EXTENDS").alias("kind"), x.alias("written"))), F.transform("t.implements", lambda x: F.struct(F.lit("IMPLEMENTS").alias("kind"), x.alias("written"))))).alias("s"))
        return self.resolve(base.select("fq_name", "pkg", "imports", "s.kind", "s.written"), "written").select("fq_name", "kind", F.coalesce("resolved", F.regexp_replace("written", r"<.*>", "")).alias("target")).distinct()

    def _classes(self) -> DataFrame:
        pick = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("target"))))
        lists = self.supers.groupBy("fq_name").agg(pick("EXTENDS").alias("extended_types"), pick("IMPLEMENTS").alias("implemented_types"))
        none = F.array().cast("array<string>")
        own = self.types.groupBy("fq_name").agg(F.max_by(F.struct("t", "file_path", "pkg"), "file_path").alias("r"))
        return own.join(lists, "fq_name", "left").select(
            "fq_name", F.col("r.t.name").alias("simple_name"), F.col("r.t.signature").alias("signature"), F.col("r.t.annotations").alias("annotations"), F.col("r.file_path").alias("file_path"), F.col("r.pkg").alias("package_name"),
            (F.col("r.t.kind") == "interface").alias("is_interface"), F.coalesce("extended_types", none).alias("extended_types"), F.coalesce("implemented_types", none).alias("implemented_types"))

    def _methods(self) -> DataFrame:
        m = self.types.select("file_path", "pkg", "imports", "fq_name", "t", F.explode("t.methods").alias("m"))
        m = m.withColumn("method_id", F.concat("fq_name", F.lit("#"), "m.name", F.lit("("), F.array_join("m.param_types", ", "), F.lit(")")))
        rules = m.select(F.col("fq_name").alias("class_key"), "method_id", F.col("m.name").alias("name"), F.col("m.n_statements").alias("n_statements"), F.col("m.first_kind").alias("first_kind"))
        annotation = F.transform("t.annotations", lambda a: F.regexp_extract(a, r"([\w]+)\s*(?:\(|$)", 1))
        classes = self.types.select(F.col("fq_name").alias("class_key"), annotation.alias("annotation_names"), F.size("t.fields").alias("n_fields")).dropDuplicates(["class_key"])
        dtos = boilerplate.dto_classes(classes, rules.where("name <> '<init>'"))
        marks = boilerplate.mark(rules, dtos).groupBy("method_id").agg(F.bool_and("is_boilerplate").alias("is_boilerplate"))
        return m.join(marks, "method_id", "left")

    def _ancestors(self) -> DataFrame:
        """(fq_name, ancestor, steps) of each type, itself at 0, over extends and implements, with the least number of steps.

        Ways are doubled: each round joins the ways found so far to each other, until no way is new or shorter. So a tower of n types
        takes log n rounds, and a cycle ends as any other graph does, since ways only get shorter.
        """
        own = self.known.select("fq_name", F.col("fq_name").alias("ancestor"), F.lit(0).alias("steps"))
        ways = cut(self.every_supers.where("fq_name <> target").select("fq_name", F.col("target").alias("ancestor"), F.lit(1).alias("steps")).distinct())
        size = None
        while True:
            now = ways.agg(F.count("*"), F.sum("steps")).first()
            if now == size or not now[0]:
                break
            size = now
            # a type that a third of all extend is one key: its subtypes are dealt by salts
            low = ways.withColumn("salt", F.pmod(F.xxhash64("fq_name"), F.lit(SALTS)).cast("int"))
            high = ways.select(F.col("fq_name").alias("ancestor"), F.col("ancestor").alias("above"), F.col("steps").alias("more"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
            longer = low.join(high, ["ancestor", "salt"]).where("fq_name <> above").select("fq_name", F.col("above").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
            ways = cut(ways.unionByName(longer).groupBy("fq_name", "ancestor").agg(F.min("steps").alias("steps")))
        return cut(own.unionByName(ways).distinct())

    def _members(self, sites: DataFrame) -> DataFrame:
        """(owner, name, args, steps, d_id, d_params, d_owner): what each type declares or inherits under the names that sites call, and
        the type that it returns."""
        id = F.concat("fq_name", F.lit("#"), "m.name", F.lit("("), F.array_join("m.param_types", ", "), F.lit(")"))
        declared = lambda types: types.select("fq_name", "pkg", "imports", F.explode("t.methods").alias("m")).select(
            F.col("fq_name").alias("ancestor"), F.col("m.name").alias("name"), F.size("m.param_types").alias("args"), id.alias("d_id"), F.col("m.param_types").alias("d_params"), F.col("m.return_type").alias("d_return"), "pkg", "imports")
        m = self._every(declared)
        m = self.resolve(m.join(sites.select("name", "args").distinct(), ["name", "args"], "left_semi"), "d_return").select("ancestor", "name", "args", "d_id", "d_params", F.col("resolved").alias("d_owner"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        low = self.ancestors.withColumn("salt", F.pmod(F.xxhash64("fq_name"), F.lit(SALTS)).cast("int"))
        return cut(low.join(m, ["ancestor", "salt"]).select(F.col("fq_name").alias("owner"), "name", "args", "steps", "d_id", "d_params", "d_owner").distinct())

    def _declared(self, sites: DataFrame) -> DataFrame:
        """(method_id, place, d_id, d_owner): for sites with an owner the declared method that a call means: that of the nearest ancestor,
        of overloads the one whose parameters have most types of the arguments, then the least id. Sites without one are left out."""
        near = sites.join(self.members, ["owner", "name", "args"])
        last = lambda t: F.substring_index(F.regexp_replace(t, r"<.*>", ""), ".", -1)
        fits = F.size(F.filter(F.zip_with("given", "d_params", lambda g, p: F.coalesce(last(g) == last(p), F.lit(False))), lambda x: x))
        best = F.min(F.struct("steps", (-fits).alias("f"), "d_id", "d_owner")).alias("d")
        return cut(near.groupBy("method_id", "place").agg(best).select("method_id", "place", "d.d_id", "d.d_owner"))

    def _calls(self) -> DataFrame:
        """(src, dst, written, resolved): the declared method that a call means, else the written form.

        The receiver's type is that of a variable or field, of a new object, a type's own name, the class itself (none, this), its
        superclass (super), or what the call before the dot returns; chains are resolved link by link.
        """
        self.ancestors = self._ancestors()
        sites = self.methods.select("method_id", "pkg", "imports", "fq_name", F.col("t.fields").alias("fields"), F.col("m.scope").alias("vars"), F.posexplode("m.calls").alias("place", "c"))
        named = lambda column, name: F.element_at(F.filter(column, lambda v: v["name"] == name), -1)["type"]
        has = lambda column, name: F.exists(column, lambda v: v["name"] == name)
        field = lambda name: F.regexp_replace(name, r"^this\.", "")
        of_name = lambda name: F.coalesce(F.when(has("vars", name), named("vars", name)), F.when(has("fields", field(name)), named("fields", field(name))))
        literal = lambda x: (
            F.when(F.startswith(x, F.lit('"')), "String").when(F.startswith(x, F.lit("'")), "char").when(x.isin("true", "false"), "boolean").when(x.rlike(r"^\d+[lL]$"), "long").when(x.rlike(r"^\d+$"), "int")
            .when(x.rlike(r"^\d*\.?\d+[fF]$"), "float").when(x.rlike(r"^\d*\.\d+[dD]?$"), "double").when(x.rlike(r"^new\s"), F.regexp_extract(x, r"^new\s+([\w.]+)", 1)).otherwise(of_name(x))
        )
        scope = F.col("c.scope")
        made = F.when(scope.rlike(r"^new\s"), F.regexp_extract(scope, r"^new\s+([\w.]+)", 1))
        kind = F.coalesce(of_name(scope), made, F.when(scope.rlike(r"^[A-Z]\w*$|^[a-z][\w.]*\.[A-Z]\w*$"), scope))
        sites = cut(sites.select("method_id", "pkg", "imports", "fq_name", "place", "c.scope", "c.name", "c.args", "c.inner", F.transform("c.given", literal).alias("given"), kind.alias("receiver")))
        self.members = self._members(sites)
        parent = self.supers.where("kind = 'EXTENDS'").groupBy("fq_name").agg(F.min("target").alias("parent"))
        typed = self.resolve(sites.where("inner is null"), "receiver").join(parent, "fq_name", "left")
        found = self._declared(typed.withColumn("owner", F.when(F.col("scope").isin("", "this"), F.col("fq_name")).when(F.col("scope") == "super", F.col("parent")).otherwise(F.col("resolved"))))
        # a plain name may be a method of the type around this one
        around = self.types.where("outer_fq is not null").groupBy("fq_name").agg(F.min("outer_fq").alias("owner"))
        outer = sites.where("scope = ''").join(around, "fq_name").join(found.select("method_id", "place"), ["method_id", "place"], "left_anti")
        found = found.unionByName(self._declared(outer))
        every, chained = found, sites.where("inner is not null").select("method_id", "place", "inner", "name", "args", "given")
        more = not chained.isEmpty()
        while more:  # one link of all chains a round; a link's inner call is another one, so this ends with the longest chain
            before = found.where("d_owner is not null").select("method_id", F.col("place").alias("inner"), F.col("d_owner").alias("owner"))
            found = self._declared(chained.join(before, ["method_id", "inner"]))
            more = not found.isEmpty()
            every = every.unionByName(found)
        joined = sites.join(every.select("method_id", "place", "d_id"), ["method_id", "place"], "left")
        written = F.concat(F.when(F.col("scope") == "", "this").otherwise(F.col("scope")), F.lit("."), "name", F.lit("("), F.array_join(F.array_repeat(F.lit("..."), F.col("args")), ", "), F.lit(")"))
        return joined.select(F.col("method_id").alias("src"), F.coalesce("d_id", written).alias("dst"), F.col("d_id").isNotNull().alias("resolved")).distinct()

    def _chunks(self) -> DataFrame:
        """One row for each part of a method; called_by is looked up by the id without its part."""
        calls = self.calls.groupBy(F.col("src").alias("method_id")).agg(F.sort_array(F.collect_set("dst")).alias("calls"))
        back = self.calls.groupBy(F.col("dst").alias("method_id")).agg(F.sort_array(F.collect_set("src")).alias("called_by"))
        none = F.array().cast("array<string>")
        rows = self.methods.join(calls, "method_id", "left").join(back, "method_id", "left")
        n = F.size("m.parts")
        parts = rows.select("*", F.posexplode("m.parts").alias("p", "code"))
        return parts.select(
            F.when(n > 1, F.concat("method_id", F.lit("#part"), F.col("p") + 1)).otherwise(F.col("method_id")).alias("chunk_id"), "file_path", F.col("pkg").alias("package_name"), "imports", F.col("t.name").alias("class_name"),
            F.col("fq_name").alias("fq_class_name"), F.col("t.signature").alias("class_signature"), F.col("t.annotations").alias("class_annotations"), F.col("t.declarations").alias("field_declarations"), F.col("m.name").alias("method_name"),
            F.col("m.signature").alias("method_signature"), F.col("m.annotations").alias("method_annotations"), F.col("m.start_line").alias("start_line"), F.col("m.end_line").alias("end_line"), "code",
            F.regexp_count("code", F.lit(TOKEN)).alias("token_count"), F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"), (F.col("p") + 1).alias("part_index"), n.alias("total_parts"), "is_boilerplate",
            F.col("fq_name").alias("parent_class"), F.col("pkg").alias("parent_package"))

    def type_info(self) -> DataFrame:
        """(id, kind, target)."""
        m = self.methods.select("method_id", "pkg", "imports", "m", "t")
        kinds = lambda column, kind: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("written")))
        returned = F.when(F.col("m.return_type").isNotNull(), F.array("m.return_type")).otherwise(F.array().cast("array<string>"))
        rows = m.select("method_id", "pkg", "imports", F.explode(F.concat(kinds("m.param_types", "USES_TYPE"), kinds(returned, "RETURNS_TYPE"), kinds("m.throws", "THROWS"))).alias("k")).select("method_id", "pkg", "imports", "k.kind", "k.written")
        typed = self.resolve(rows, "written").select(F.col("method_id").alias("id"), "kind", F.coalesce("resolved", "written").alias("target"))
        tests = self.methods.where((F.endswith("t.name", F.lit("Test")) | F.endswith("t.name", F.lit("Tests"))) & (F.col("m.name") != "<init>")).select(F.col("method_id").alias("src"))
        tested = self.calls.join(tests, "src", "left_semi").select(F.col("src").alias("id"), F.lit("TEST_FOR").alias("kind"), F.col("dst").alias("target"))
        return typed.unionByName(tested).distinct()

    def edges(self) -> DataFrame:
        """All edges before admission; those of methods leave boilerplate out."""
        from ..operators.edges import from_chunks

        t = self.types
        imports = t.select("fq_name", F.explode("imports").alias("i")).select(F.lit("IMPORTS").alias("edge_type"), F.col("fq_name").alias("src"), F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("i", r"^import\s+", ""), ";", ""), r"^static\s+", "")).alias("dst"))
        inner = t.where("outer_fq is not null").select(F.lit("INNER_CLASS_OF").alias("edge_type"), F.col("fq_name").alias("src"), F.col("outer_fq").alias("dst"))
        contains = t.where("pkg <> ''").select(F.lit("CONTAINS").alias("edge_type"), F.col("pkg").alias("src"), F.col("fq_name").alias("dst"))
        supers = self.supers.select(F.col("kind").alias("edge_type"), F.col("fq_name").alias("src"), F.col("target").alias("dst"))
        has = self.fields.select(F.lit("HAS_FIELD").alias("edge_type"), F.col("owning_class_fqn").alias("src"), F.col("fq_name").alias("dst"))
        kept = boilerplate.drop(self.chunks)
        info = self.type_info().join(kept.select(F.regexp_replace("chunk_id", r"#part\d+$", "").alias("id")).distinct(), "id", "left_semi")
        out = from_chunks(kept, info)
        for e in (imports, inner, contains, supers, has):
            out = out.unionByName(e)
        return cut(out.distinct())

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """The admitted edges and the stub types."""
        from ..operators.edges import admit

        ids = boilerplate.drop(self.chunks).select(F.regexp_replace("chunk_id", r"#part\d+$", "").alias("id")).distinct()
        return admit(self.edges(), ids, self.classes, self.fields)


def parsed_methods(blocks: DataFrame) -> DataFrame:
    """For diffs: the methods of code blocks (block, code): a whole file, types, or bare methods. A block that doesn't scan gives one row with parse_error."""

    ship(blocks.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = []
            for block, code in zip(pdf["block"], pdf["code"], strict=True):
                try:
                    rows += [{"block": block, **m} for m in methods_of(code or "")]
                except (ScanError, IndexError, KeyError):
                    rows.append({"block": block, "parse_error": True})
            rows = [{c: r.get(c) for c in columns} for r in rows]
            yield pd.DataFrame(rows, columns=columns)

    columns = ["block", "class_name", "method_name", "return_type", "params", "visibility", "throws", "calls", "annotations", "body", "signature", "code", "parse_error"]
    kind = dict(blocks.dtypes)["block"]
    return blocks.select("block", "code").mapInPandas(run, f"block {kind}, class_name string, method_name string, return_type string, params array<string>, visibility string, throws array<string>, calls array<string>, annotations array<string>, body string, signature string, code string, parse_error boolean")


def methods_of(code: str) -> list[dict]:
    """Methods of types, or of bare members, without constructors."""
    try:
        types = Scanner(code).scan().types
    except ScanError:
        types = Scanner("class $Bare {\n" + code + "\n}").scan().types
    out = []
    for t in types:
        for m in t.methods:
            if m["name"] != "<init>":
                calls = list(dict.fromkeys(f"{s}.{n}" if s else n for s, n, *_ in m["calls"]))
                out.append({"class_name": "" if t.name == "$Bare" else t.name, "method_name": m["name"], "return_type": m["return_type"], "params": m["params"], "visibility": m["visibility"], "throws": m["throws"], "calls": calls, "annotations": m["annotations"], "body": m["body"], "signature": m["signature"], "code": m["code"], "parse_error": False})
    return out


__all__ = ["Scanner", "Tables", "methods_of", "parsed_methods", "read_files", "read_listed", "read_roots", "scan", "scan_source"]
