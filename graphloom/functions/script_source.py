"""What a JavaScript or TypeScript file defines, imports and calls (X7-X9), by a scanner of tokens.

Tokens leave out comments and the inside of strings; brackets are matched once, and every question (where a callee
starts, where a body ends) is a walk over matched tokens. Calls inside template strings count.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TOKEN = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'?|"(?:\\[\s\S]|[^"\\\n])*"?)|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[\s\S])""")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
NO_CALL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "instanceof", "async"}
VALUE_END = {"word", "number", "string", "template"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def tokens(text: str, at: int = 0, stop: int | None = None) -> list[Token]:
    """Tokens from one place to another; the fields of template strings are tokens between marks of their own."""
    out: list[Token] = []
    stop = len(text) if stop is None else stop
    while at < stop:
        last = out[-1] if out else None
        value = last is not None and (last.kind in VALUE_END and last.text not in NO_CALL or last.text in (")", "]", "}"))
        if text[at] == "`":
            at = template(text, at, stop, out)
            continue
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and not value:
            m = REGEX.match(text, at, stop)
            if m:
                out.append(Token("string", m[0], at, m.end()))
                at = m.end()
                continue
        m = TOKEN.match(text, at, stop)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


def template(text: str, at: int, stop: int, out: list[Token]) -> int:
    """Reads a template string from its opening quote; returns the place behind it."""
    first, i = at, at + 1
    inner: list[Token] = []
    while i < stop and text[i] != "`":
        if text[i] == "\\":
            i += 2
        elif text.startswith("${", i):
            end = field_end(text, i + 2, stop)
            inner += [Token("mark", "${", i, i + 2), *tokens(text, i + 2, end), Token("mark", "$}", end, end + 1)]
            i = end + 1
        else:
            i += 1
    i = min(i + 1, stop)
    out += [*inner, Token("template", "`", first, i)]
    return i


def field_end(text: str, at: int, stop: int) -> int:
    depth = 0
    while at < stop:
        c = text[at]
        if c == "`":
            at = template(text, at, stop, [])
            continue
        if c in "'\"" or text.startswith(("//", "/*"), at):
            at = TOKEN.match(text, at, stop).end()
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            if not depth:
                return at
            depth -= 1
        at += 1
    return stop


class Script:
    def __init__(self, text: str):
        self.text, self.t = text, tokens(text)
        self.mate: dict[int, int] = {}
        open_: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind == "mark" and x.text in PAIRS:
                open_.append(i)
            elif x.kind == "mark" and x.text in PAIRS.values() and open_ and PAIRS[self.t[open_[-1]].text] == x.text:
                self.mate[i] = open_.pop()
                self.mate[self.mate[i]] = i
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.declared = self.definition_brackets()

    def line(self, place: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, place) + 1

    def is_(self, i: int, *text: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in ("mark", "word") and self.t[i].text in text

    def past_type(self, i: int) -> int:
        """Behind a type annotation that starts with a colon at i: at the brace or arrow that follows it."""
        if not self.is_(i, ":"):
            return i
        i += 1
        if self.is_(i, "{"):
            i = self.mate.get(i, i) + 1
        while i < len(self.t) and not self.is_(i, "{", "=>", ";"):
            i = self.mate.get(i, i) + 1 if self.is_(i, "(", "[") else i + 1
        return i

    def body_after(self, bracket: int) -> int | None:
        """The brace of a body behind a parameter list, if there is one."""
        close = self.mate.get(bracket)
        if close is None:
            return None
        i = self.past_type(close + 1)
        return i if self.is_(i, "{") and i in self.mate else None

    def definition_brackets(self) -> set[int]:
        """Parameter lists of functions and methods: brackets that call nothing."""
        out = set()
        for i in range(len(self.t)):
            if not self.is_(i, "(") or i not in self.mate:
                continue
            before = i - 1
            if self.is_(before, ">"):
                before = self.before_types(before)
                before = -1 if before is None else before
            if self.is_(before, "function") or (self.is_(before - 1, "function") or (self.is_(before - 1, "*") and self.is_(before - 2, "function"))):
                out.add(i)
            elif before >= 0 and self.t[before].kind == "word" and self.t[before].text not in NO_CALL and self.body_after(i) is not None and self.is_(before - 1, "{", "}", ";", ",", "async", "get", "set", "static", "*", "public", "private", "protected", "readonly", "override"):
                if self.in_braces(before):
                    out.add(i)
        return out

    def in_braces(self, i: int) -> bool:
        """Whether a name stands where a member of a class or object would."""
        j, depth = i - 1, 0
        while j >= 0:
            if self.t[j].kind == "mark" and self.t[j].text in ")]}" and j in self.mate:
                j = self.mate[j] - 1
                continue
            if self.is_(j, "{"):
                return True
            if self.is_(j, "(", "["):
                return False
            j -= 1
            depth += 1
        return False

    def callee_start(self, bracket: int) -> int | None:
        """The first token of what a bracket calls; None if it calls nothing."""
        i = bracket - 1
        if self.is_(i, "?."):
            i -= 1
        if self.is_(i, ">"):
            i = self.before_types(i)
            if i is None:
                return None
        while True:
            if i < 0:
                return None
            x = self.t[i]
            if x.kind == "mark" and x.text in ")]" and i in self.mate:
                first = self.mate[i]
                before = first - 1
                if self.is_(before, "?."):
                    before -= 1
                joined = before >= 0 and (self.t[before].kind in ("word", "template") and self.t[before].text not in NO_CALL or self.is_(before, ")", "]"))
                if joined and not (x.text == "]" and not self.touch(before, first)):
                    i = before
                    continue
                if x.text == "]" or self.is_(before, "if", "for", "while", "switch", "catch", "with"):
                    return None
                return first
            if x.kind == "word":
                if self.is_(i - 1, ".", "?."):
                    i -= 2
                    continue
                if x.text in NO_CALL:
                    return None
                return i - 1 if self.is_(i - 1, "new") and i != bracket - 1 and self.constructed(i, bracket) else i
            if x.kind in ("string", "template"):
                return i
            return None

    def touch(self, a: int, b: int) -> bool:
        return "\n" not in self.text[self.t[a].end : self.t[b].start]

    def constructed(self, i: int, bracket: int) -> bool:
        """Whether the arguments of a new expression that starts behind i end before the bracket."""
        j = i + 1
        while j < bracket and not self.is_(j, "("):
            j += 1
        return j < bracket

    def before_types(self, i: int) -> int | None:
        """Before type arguments that end at i and follow a name at once."""
        depth = 0
        while i >= 0:
            if self.is_(i, ">"):
                depth += 1
            elif self.is_(i, "<"):
                depth -= 1
                if not depth:
                    near = i > 0 and self.t[i - 1].kind == "word" and self.t[i - 1].end == self.t[i].start
                    return i - 1 if near else None
            elif not (self.t[i].kind in ("word", "string", "number") or self.is_(i, ",", ".", "|", "&", "[", "]", "{", "}", ":")):
                return None
            i -= 1
        return None

    def calls(self, first: int = 0, last: int | None = None) -> list[dict]:
        """Calls among tokens, outer before inner, in source order."""
        last = len(self.t) if last is None else last
        found = []
        for i in range(first, last):
            if not self.is_(i, "(") or i in self.declared or i not in self.mate or self.is_(self.mate[i] + 1, "=>"):
                continue
            start = self.callee_start(i)
            if start is None or start < first or (self.is_(start - 1, "new") and not self.constructed(start, i)):
                continue
            end = i - 1 if not self.is_(i - 1, ">", "?.") else (self.before_types(i - 1) if self.is_(i - 1, ">") else i - 2)
            a = self.t[start].start
            found.append((a, -self.t[self.mate[i]].end, {"name": self.text[a : self.t[end].end], "line": self.line(a)}))
        return [c for *_, c in sorted(found, key=lambda x: x[:2])]

    def names(self, bracket: int) -> list[str]:
        """Plain parameters of a list: names, optional and typed ones; patterns, defaults and rest ones are left out."""
        out, i, close = [], bracket + 1, self.mate[bracket]
        while i < close:
            end = i
            while end < close and not self.is_(end, ","):
                end = self.mate[end] + 1 if end in self.mate and self.mate[end] > end else end + 1
            part = [k for k in range(i, end) if not self.is_(k, "public", "private", "protected", "readonly")]
            if part and self.t[part[0]].kind == "word" and not any(self.is_(k, "=") for k in part):
                out.append(self.t[part[0]].text)
            i = end + 1
        return out

    def function(self, name: str, prefix: str, start: int, bracket: int | None, params: list[str], first: int, last: int) -> dict:
        return {"name": name, "qualified_name": f"{prefix}.{name}" if prefix else name, "line_start": self.line(self.t[start].start), "line_end": self.line(self.t[last].end - 1), "params": params, "decorators": [], "calls": self.calls(first, last + 1)}

    def declared_in(self, first: int, last: int, prefix: str, members: bool) -> list[dict]:
        """Functions that are direct children of a block: declarations (or methods), then arrows bound by let and const."""
        named, arrows, i = [], [], first
        while i < last:
            start = i
            if not members:
                while self.is_(i, "export", "default"):
                    i += 1
                start = i
                j = i + 1 if self.is_(i, "async") else i
                if self.is_(j, "function"):
                    j += 2 if self.is_(j + 1, "*") else 1
                    bracket = self.type_params(j + 1)
                    body = self.body_after(bracket) if self.is_(bracket, "(") else None
                    if body is not None and self.t[j].kind == "word":
                        named.append(self.function(self.t[j].text, prefix, start, bracket, self.names(bracket), body, self.mate[body]))
                        i = self.mate[body] + 1
                        continue
                if self.is_(i, "const", "let"):
                    i = self.arrows(i, last, prefix, arrows)
                    continue
            else:
                j = i
                while self.is_(j, "static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override", "abstract") and not self.is_(j + 1, "(", "="):
                    j += 1
                bracket = self.type_params(j + 1)
                if j < last and self.t[j].kind in ("word", "string", "number") and self.is_(bracket, "("):
                    body = self.body_after(bracket)
                    if body is not None:
                        named.append(self.function(self.t[j].text, prefix, start, bracket, self.names(bracket), body, self.mate[body]))
                        i = self.mate[body] + 1
                        continue
                i = self.member_end(i, last)
                continue
            i = self.mate[i] + 1 if i in self.mate and self.mate[i] > i else i + 1
        return named + arrows

    def type_params(self, i: int) -> int:
        if self.is_(i, "<"):
            depth = 0
            while i < len(self.t):
                depth += self.is_(i, "<") - self.is_(i, ">")
                i += 1
                if not depth:
                    break
        return i

    def member_end(self, i: int, last: int) -> int:
        """Behind a class member that is no method: a field up to its semicolon or line end."""
        row = self.line(self.t[i].start)
        while i < last and not self.is_(i, ";") and self.line(self.t[i].start) == row:
            i = self.mate[i] if i in self.mate and self.mate[i] > i else i
            row = self.line(self.t[i].end - 1)
            i += 1
        return i + 1 if self.is_(i, ";") else i

    def arrows(self, i: int, last: int, prefix: str, out: list[dict]) -> int:
        """Arrow functions of one let or const statement; returns the place behind it."""
        i += 1
        while i < last:
            name = i
            if self.t[name].kind != "word":
                break
            j = name + 1
            if self.is_(j, ":"):
                while j < last and not self.is_(j, "=", ";"):
                    j = self.mate[j] + 1 if j in self.mate and self.mate[j] > j else j + 1
            if not self.is_(j, "="):
                break
            j += 1
            if self.is_(j, "async"):
                j += 1
            j = self.type_params(j)
            params, arrow = None, None
            if self.is_(j, "(") and j in self.mate:
                params, arrow = self.arrow_names(j), self.past_type(self.mate[j] + 1)
            elif j < last and self.t[j].kind == "word":
                params, arrow = [self.t[j].text], j + 1
            if arrow is None or not self.is_(arrow, "=>"):
                j = self.statement_end(j, last)
            else:
                body = arrow + 1
                end = self.mate[body] if self.is_(body, "{") and body in self.mate else self.statement_end(body, last) - 1
                out.append(self.function(self.t[name].text, prefix, name, None, params, body, end))
                j = end + 1
            if not self.is_(j, ","):
                return j
            i = j + 1
        return i

    def arrow_names(self, bracket: int) -> list[str]:
        """Parameters of an arrow function, typed ones with their types."""
        out, i, close = [], bracket + 1, self.mate[bracket]
        while i < close:
            end = i
            while end < close and not self.is_(end, ","):
                end = self.mate[end] + 1 if end in self.mate and self.mate[end] > end else end + 1
            if self.t[i].kind == "word" and not any(self.is_(k, "=") for k in range(i, end)):
                out.append(self.text[self.t[i].start : self.t[end - 1].end])
            i = end + 1
        return out

    def statement_end(self, i: int, last: int) -> int:
        """Behind an expression: at a comma or semicolon, a closing bracket, or where a new line starts a statement."""
        while i < last and not self.is_(i, ",", ";", ")", "]", "}"):
            i = self.mate[i] + 1 if i in self.mate and self.mate[i] > i else i + 1
            goes_on = i < last and (self.is_(i, ".", "?.", "?", ":", "+", "-", "*", "/", "%", "&", "|", "=", "=>", "<", ">", "(", "[", ",") or self.is_(i - 1, "=", "=>", "+", "-", "*", "/", "%", "&", "|", "?", ":", "!", "await", "new", "typeof"))
            if i < last and not self.touch(i - 1, i) and not goes_on:
                break
        return i

    def classes(self) -> list[tuple[dict, list[dict]]]:
        """Class declarations at any depth, with their methods; abstract ones are a kind of their own and left out."""
        out = []
        for i in range(len(self.t)):
            if not self.is_(i, "class") or self.is_(i - 1, "=", "(", ",", "return", ".", ":", "abstract") or i + 1 >= len(self.t) or self.t[i + 1].kind != "word" or self.is_(i + 1, "extends"):
                continue
            j = self.type_params(i + 2)
            while j < len(self.t) and not self.is_(j, "{"):
                j = self.mate[j] + 1 if j in self.mate and self.mate[j] > j else j + 1
            if j not in self.mate:
                continue
            name, end = self.t[i + 1].text, self.mate[j]
            row = {"name": name, "line_start": self.line(self.t[i].start), "line_end": self.line(self.t[end].end - 1), "bases": []}
            out.append((row, self.declared_in(j + 1, end, name, True)))
        return out

    def imports(self) -> list[dict]:
        """import statements, then calls of require with a plain string."""
        out, t = [], self.t
        bare = lambda s: s.strip("'\"")
        for i in range(len(t)):
            if self.is_(i, "import") and not self.is_(i + 1, "(", ".") and not self.is_(i - 1, "."):
                j = i + 1
                while j < len(t) and t[j].kind != "string" and not self.is_(j, ";", "="):
                    j += 1
                if j >= len(t) or t[j].kind != "string":
                    continue
                named, default, k = [], [], i + 1
                while k < j:
                    if self.is_(k, "{") and k in self.mate:
                        for m in range(k + 1, self.mate[k]):
                            if t[m].kind == "word" and t[m].text != "as" and not self.is_(m - 1, "as") and not (t[m].text == "type" and self.t[m + 1].kind == "word"):
                                named.append(t[m].text)
                        k = self.mate[k] + 1
                        continue
                    if t[k].kind == "word" and t[k].text not in ("from", "as") and not self.is_(k - 1, "as") and not (t[k].text == "type" and (self.is_(k + 1, "{", "*") or (self.t[k + 1].kind == "word" and self.t[k + 1].text != "from"))):
                        default.append(t[k].text)
                    k += 1
                out.append({"module": bare(t[j].text), "names": named + default, "line": self.line(t[i].start), "is_relative": False})
        for i in range(len(t) - 2):
            if self.is_(i, "require") and not self.is_(i - 1, ".", "function") and self.is_(i + 1, "(") and i + 1 in self.mate:
                for m in range(i + 2, self.mate[i + 1]):
                    if t[m].kind == "string":
                        out.append({"module": bare(t[m].text), "names": [], "line": self.line(t[i].start), "is_relative": False})
                        break
        return out


def facts(text: str) -> dict:
    """imports, functions (methods after them, class by class), classes, calls of one file."""
    s = Script(text)
    functions, classes = s.declared_in(0, len(s.t), "", False), []
    for row, methods in s.classes():
        classes.append(row)
        functions += methods
    calls = [c | {"bare": False, "mixed": [], "inside": None, "inside_params": []} for c in s.calls()]
    return {"imports": s.imports(), "functions": functions, "classes": classes, "calls": calls}
