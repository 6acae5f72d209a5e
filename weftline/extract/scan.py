"""One source file to facts, by masking, bracket matching and patterns. Runs on executors, a file at a time.

There is no type checker: names resolve through imports, declarations of the file, and names that are unique in the tree
(see ``events``). Text in strings and comments is masked out before anything is looked for.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

WORD = r"[A-Za-z_$][\w$]*"
CLOSES = {"(": ")", "[": "]", "{": "}"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "import", "super", "constructor", "async"}
BUILT_IN_TYPES = {"string", "number", "boolean", "void", "any", "unknown", "never", "null", "undefined", "object", "true", "false"}
CODE_LIMIT, LOCAL_LIMIT, PARAMETER_LIMIT = 8000, 1000, 1000


class Fact(NamedTuple):
    """What one place in a file says. ``owner`` is the qualified name of the enclosing symbol."""

    fact: str
    name: str = ""
    kind: str = ""
    owner: str = ""
    specifier: str = ""
    names: tuple[str, ...] = ()
    line: int = 1
    end_line: int = 1
    exported: bool = False
    scope: str = ""
    signature: str = ""
    code: str = ""


def mask(text: str) -> str:
    """The text with the insides of strings and comments blanked; length and line breaks stay."""
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two, c = text[i : i + 2], text[i]
        if two == "//":
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
        elif two == "/*":
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
        elif c in "'\"`":
            end = i + 1
            while end < n and text[end] != c and (c == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            blank(i + 1, end)
            end += 1
        else:
            i += 1
            continue
        i = end
    return "".join(out)


def pairs(masked: str) -> dict[int, int]:
    """Opening bracket to closing bracket, by position; what doesn't match is left out."""
    stack, found = [], {}
    for m in re.finditer(r"[()\[\]{}]", masked):
        if m.group() in CLOSES:
            stack.append(m.start())
        elif stack and CLOSES[masked[stack[-1]]] == m.group():
            found[stack.pop()] = m.start()
    return found


class File:
    """A masked file with its brackets, lines and declared symbols."""

    def __init__(self, text: str) -> None:
        self.text, self.masked = text, mask(text)
        self.pairs = pairs(self.masked)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.depths = self._depths()
        self.symbols: list[tuple[int, int, str, bool]] = []  # start, end, qualified name, may own relations

    def _depths(self) -> tuple[list[int], list[int]]:
        at, level, depth = [], [], 0
        for i, opening in sorted([(a, 1) for a in self.pairs] + [(b, 0) for b in self.pairs.values()]):
            depth += 1 if opening else -1
            at.append(i)
            level.append(depth)
        return at, level

    def depth(self, i: int) -> int:
        at, level = self.depths
        k = bisect_right(at, i) - 1
        return level[k] if k >= 0 else 0

    def line(self, i: int) -> int:
        return bisect_right(self.starts, i)

    def end_of_statement(self, i: int) -> int:
        """Where the expression that begins at ``i`` ends: a semicolon, a comma or a line break outside brackets."""
        n = len(self.masked)
        while i < n:
            c = self.masked[i]
            if c in CLOSES:
                i = self.pairs.get(i, n - 1)
            elif c in ");,]}":
                return i
            elif c == "\n" and not re.match(r"\s*(?:[.?:&|+*/=<>-]|=>)", self.masked[i:]) and not re.search(r"(?:=>|[=(,:?&|+*/<>-])\s*\Z", self.masked[max(0, i - 40) : i]):
                return i
            i += 1
        return n

    def owner(self, i: int, relations: bool = False) -> str:
        """The innermost symbol around a position."""
        best = ""
        size = len(self.text) + 1
        for a, b, name, owns in self.symbols:
            if a <= i < b and b - a < size and (owns or not relations):
                best, size = name, b - a
        return best


def bounded(code: str, most: int) -> str:
    """Code up to a length, with a mark where it was cut."""
    return code if len(code) <= most else f"{code[:most]}\n/* cut after {most} characters */"


def function_kind(name: str, plain: str) -> str:
    """component, hook or the plain kind, by name."""
    return "component" if name[:1].isupper() else "hook" if name.startswith("use") else plain


def split_list(f: File, a: int, b: int) -> list[tuple[int, str]]:
    """Start and text of the comma-separated parts between two positions."""
    out, at, i = [], a, a
    while i < b:
        c = f.masked[i]
        if c in CLOSES:
            i = f.pairs.get(i, b)
        elif c == ",":
            out.append((at, f.text[at:i]))
            at = i + 1
        i += 1
    out.append((at, f.text[at:b]))
    return [(p + len(t) - len(t.lstrip()), t.strip()) for p, t in out if t.strip()]


def _parameters(f: File, opening: int, owner: str) -> list[Fact]:
    out = []
    for at, text in split_list(f, opening + 1, f.pairs.get(opening, opening + 1)):
        m = re.match(rf"(?:\.\.\.)?(?:(?:public|private|protected|readonly)\s+)*({WORD}|\{{[^}}]*\}}|\[[^\]]*\])", text)
        if m:
            line = f.line(at)
            name = f"{owner}::param:{m.group(1)}:{line}"
            f.symbols.append((at, at + len(text), name, False))
            out.append(Fact("param", m.group(1), "parameter", owner, line=line, end_line=f.line(at + len(text)), scope="parameter", signature=text.split("\n")[0].strip(), code=bounded(text, PARAMETER_LIMIT), specifier=name))
    return out


def _arrow(f: File, at: int) -> int | None:
    """The opening parenthesis of the function that an initializer is; -1 if it has none; None if it is no function."""
    m = re.compile(rf"\s*(?:async\s*)?(?:function\b[^(]*(\()|(\()|({WORD})\s*=>)").match(f.masked, at)
    if not m:
        return None
    if m.group(3):
        return -1
    i = m.start(1) if m.group(1) else m.start(2)
    if m.group(1):
        return i
    after = f.masked[f.pairs.get(i, i) + 1 :][:400]
    return i if re.match(r"\s*(?::[^=;{]*(?:\{[^}]*\})?[^=;{]*)?=>", after) else None


def declarations(f: File) -> list[Fact]:
    """Top-level symbols, methods, parameters and local variables."""
    out: list[Fact] = []
    head = re.compile(rf"(?P<exp>\bexport\s+)?(?P<def>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?\b(?P<what>function|class|interface|type|const|let|var)\b\s*\*?\s*(?P<name>{WORD})?")
    for m in head.finditer(f.masked):
        what, name, top = m["what"], m["name"] or ("default" if m["def"] else ""), f.depth(m.start()) == 0
        if not name or (what in ("type", "interface", "class") and not top) or re.search(r"[.\w$]\Z", f.masked[: m.start()][-1:]):
            continue
        if what in ("const", "let", "var"):
            out += _variables(f, m, top)
        elif what == "type":
            if "=" in f.masked[m.end() : m.end() + 400]:
                out.append(_declare(f, m.start(), f.end_of_statement(m.end()), name, "type", bool(m["exp"]), ""))
        elif what == "function":
            opening = f.masked.find("(", m.end())
            body = _body(f, f.pairs.get(opening, m.end()))
            if top and opening >= 0:
                out.append(_declare(f, m.start(), body[1] + 1, name, function_kind(name, "function"), bool(m["exp"]), f.text[m.start() : body[1] + 1]))
                out += _parameters(f, opening, name)
        else:
            opening = f.masked.find("{", m.end())
            close = f.pairs.get(opening, m.end())
            out.append(_declare(f, m.start(), close + 1, name, what, bool(m["exp"]), f.text[m.start() : close + 1] if what == "class" else ""))
            if what == "class" and opening >= 0:
                out += _methods(f, opening, close)
    return out


def _body(f: File, i: int) -> tuple[int, int]:
    """The braces after a parameter list; a return type may have braces of its own."""
    m = re.compile(r"\s*(?::\s*(?:[^{};=]|\{[^{}]*\}(?=\s*\{))*)?").match(f.masked, i + 1)
    at = m.end() if m else i + 1
    return (at, f.pairs[at]) if at in f.pairs else (i, i)


def _declare(f: File, a: int, b: int, name: str, kind: str, exported: bool, code: str, scope: str = "module") -> Fact:
    f.symbols.append((a, b, name, True))
    return Fact("symbol", name, kind, line=f.line(a), end_line=f.line(max(a, b - 1)), exported=exported, scope=scope, signature=f.text[a:b].split("\n")[0].strip(), code=code, specifier=name)


def _methods(f: File, opening: int, close: int) -> list[Fact]:
    out, level = [], f.depth(opening)
    for m in re.compile(rf"(?:(?:public|private|protected|static|async|get|set)\s+)*({WORD})\s*(\()").finditer(f.masked, opening + 1, close):
        if f.depth(m.start()) == level and m.group(1) not in NOT_CALLED:
            body = _body(f, f.pairs.get(m.start(2), m.end()))
            if body[1] > body[0]:
                out.append(_declare(f, m.start(), body[1] + 1, m.group(1), "method", False, f.text[m.start() : body[1] + 1], "class"))
                out += _parameters(f, m.start(2), m.group(1))
    return out


def _variables(f: File, m: re.Match, top: bool) -> list[Fact]:
    """The variables of one statement. Those of a pattern are named by the pattern's text, as one."""
    out, at = [], m.start("name") if m["name"] else m.end()
    part = re.compile(rf"\s*({WORD}|[\[{{])").match(f.masked, at)
    while part:
        start = part.start(1)
        end_name = part.end(1) if part.group(1) not in CLOSES else f.pairs.get(start, start) + 1
        name = f.text[start:end_name]
        eq = re.compile(r"\s*!?(?::[^=;\n]*(?:=>[^=;\n]*)?)?=(?![=>])").match(f.masked, end_name)
        end = f.end_of_statement(eq.end() if eq else end_name)
        opening = _arrow(f, eq.end()) if eq else None
        is_class = bool(eq and re.match(r"\s*class\b", f.masked[eq.end() :]))
        function = opening is not None or is_class
        code = f.text[start:end]
        if top:
            kind = "class" if is_class else function_kind(name, "function_variable") if function else "global_variable"
            qualified = name
            out.append(_declare(f, start, end, name, kind, bool(m["exp"]), bounded(code, CODE_LIMIT if function else CODE_LIMIT // 2)))
            f.symbols[-1] = (start, end, name, function)
        else:
            owner = f.owner(start)
            if owner:
                qualified = f"{owner}::var:{name}:{f.line(start)}"
                kind = "class" if is_class else function_kind(name, "function_variable") if function else "local_variable"
                f.symbols.append((start, end, qualified, function))
                out.append(Fact("var", name, kind, owner, line=f.line(start), end_line=f.line(max(start, end - 1)), scope="function", signature=code.split("\n")[0].strip(), code=bounded(code, 4000 if function else LOCAL_LIMIT), specifier=qualified))
            else:
                qualified = ""
        if qualified and opening is not None and opening >= 0:
            out += _parameters(f, opening, qualified)
        part = re.compile(rf"\s*({WORD}|[\[{{])").match(f.masked, end + 1) if end < len(f.masked) and f.masked[end] == "," else None
    return out


def imports(f: File) -> list[Fact]:
    """Imports, re-exports and dynamic imports with their specifier and names (``as`` gives ``name:local``)."""
    out = []
    for m in re.finditer(r"^[ \t]*(import|export)\b([^;'\"]*?)(?:\bfrom\s*)?(['\"])", f.masked, re.M):
        quote = f.masked.find(m.group(3), m.end())
        if quote < 0 or (m.group(1) == "export" and "from" not in f.masked[m.start() : m.end()]) or "(" in m.group(2) or "=" in m.group(2):
            continue
        names, clause = [], m.group(2)
        if braces := re.search(r"\{([^}]*)\}", clause):
            for x in braces.group(1).split(","):
                a, _, b = x.replace("type ", "").strip().partition(" as ")
                names += [f"{a.strip()}:{(b or a).strip()}"] * bool(a.strip())
        if default := re.match(rf"\s*(?:type\s+)?({WORD})\s*(?:,|from|\Z)", clause):
            names.append(f"default:{default.group(1)}")
        if star := re.search(rf"\*(?:\s*as\s+({WORD}))?", clause):
            names.append(f"*:{star.group(1) or '*'}")
        out.append(Fact("import", kind="re_export" if m.group(1) == "export" else "import", specifier=f.text[m.end() : quote], names=tuple(names), line=f.line(m.start(1))))
    for m in re.finditer(r"\bimport\s*\(\s*(['\"])", f.masked):
        quote = f.masked.find(m.group(1), m.end())
        if quote > 0:
            out.append(Fact("import", kind="dynamic", specifier=f.text[m.end() : quote], line=f.line(m.start())))
    return out


def exports(f: File) -> list[Fact]:
    """Names under which a file exports what it declares or imports otherwise: ``specifier`` is the local name."""
    out = []
    for m in re.finditer(r"^[ \t]*export\s*(?:type\s*)?\{([^}]*)\}(?!\s*from\b)", f.masked, re.M):
        for x in m.group(1).split(","):
            a, _, b = x.replace("type ", "").strip().partition(" as ")
            if a.strip():
                out.append(Fact("export", (b or a).strip(), specifier=a.strip(), line=f.line(m.start())))
    for m in re.finditer(rf"^[ \t]*export\s+default\s+(?:(?:async\s+)?function\b\s*\*?|(?:abstract\s+)?class\b)?\s*({WORD})(?=\s*(?:[;({{<]|\n|\Z|extends\b|implements\b))", f.masked, re.M):
        if m.group(1) not in ("function", "class", "async", "abstract", "new"):
            out.append(Fact("export", "default", specifier=m.group(1), line=f.line(m.start())))
    return out


def references(f: File, identifiers: bool) -> list[Fact]:
    """Calls, instantiations, rendered components, types and, if wanted, other identifiers, each with its owner."""
    out = []

    def add(kind: str, i: int, name: str, end: int) -> None:
        owner = f.owner(i, True)
        if owner and name:
            out.append(Fact("ref", name, kind, owner, line=f.line(i), end_line=f.line(end)))

    for m in re.finditer(rf"(?<![\w$])(new\s+)?((?:{WORD}\s*\.\s*)*)({WORD})\s*(?:<[^<>()]*>\s*)?\(", f.masked):
        if m.group(3) not in NOT_CALLED and not re.search(r"\bfunction\s*\Z", f.masked[: m.start()][-12:]):
            add("INSTANTIATES" if m.group(1) else "CALLS", m.start(), m.group(3), f.pairs.get(m.end() - 1, m.end()))
    for m in re.finditer(rf"(?<![\w$)\]])<({WORD}(?:\.{WORD})*)(?=[\s/>])", f.masked):
        add("RENDERS", m.start(), m.group(1).rpartition(".")[2], m.end())
    for m in re.finditer(rf"(?:[:|&]|\bas|\bextends|\bimplements|<|,)\s*({WORD})(?=\s*(?:[\[\]<>|&,;)={{]|\n))", f.masked):
        if m.group(1) not in BUILT_IN_TYPES and m.group(1)[:1].isupper():
            add("USES_TYPE", m.start(1), m.group(1), m.end())
    if identifiers:
        for m in re.finditer(rf"(?<![\w$.])({WORD})(?![\w$])", f.masked):
            add("REFERENCES", m.start(1), m.group(1), m.end())
    return out


def others(f: File, path: str) -> list[Fact]:
    """Environment keys, and test blocks of test files."""
    out = [Fact("env", m.group(1), line=f.line(m.start()), end_line=f.line(m.end())) for m in re.finditer(rf"\bprocess\.env\.({WORD})", f.masked)]
    if re.search(r"\.(?:test|spec)\.|__tests__/", path):
        for m in re.finditer(r"\b(describe|it|test)\s*(\()\s*(['\"`])", f.masked):
            quote = f.masked.find(m.group(3), m.end())
            out.append(Fact("test", f.text[m.end() : quote], m.group(1), line=f.line(m.start()), end_line=f.line(f.pairs.get(m.start(2), m.end()))))
    return out


def facts(path: str, text: str, relations: bool = True, identifiers: bool = False) -> list[Fact]:
    """All facts of one file."""
    f = File(text)
    out = declarations(f) + imports(f) + exports(f) + others(f, path)
    return out + (references(f, identifiers) if relations else [])
