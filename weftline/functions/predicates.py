"""Column expressions over paths, symbols and source lines. All run inside whole-stage code generation; no Python UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = r"[\t\n\f\r ]"
WORD = "A-Za-z0-9_"
#: Unicode white space that is stripped from both ends of a line.
STRIP = r"[\s\u0085   -     　]+"
# Names that are never descended into, suffixes that are searched, words that are not owners.
SKIPPED_DIRS = (".git", "node_modules", ".next", "dist", "coverage", ".turbo", ".cache")
SEARCHED_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "json", "md", "yml", "yaml", "env", "toml")
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "function")


def lit(x: str | Column) -> Column:
    """A literal, unless it is a column already."""
    return x if isinstance(x, Column) else F.lit(x)


def strip(c: Column) -> Column:
    """White space, of any script, removed from both ends."""
    return F.regexp_replace(F.regexp_replace(c, "^" + STRIP, ""), STRIP + r"\z", "")


def base_name(path: Column) -> Column:
    """The last segment of a path."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def java_regex(pattern: str) -> str:
    r"""Rewrite a linear-time (RE2) pattern for Java: ASCII ``\b``, ``\w``, ``\s``, and a dot that stops at newline only.

    ``\b`` becomes the look-around that holds next to a word character: the pattern must have one on its inner side.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two in (r"\w", r"\s", r"\b", r"\d"):
            if two == r"\w":
                out.append(WORD if in_class else f"[{WORD}]")
            elif two == r"\s":
                out.append(r"\t\n\f\r " if in_class else ASCII_SPACE)
            elif two == r"\d":
                out.append("0-9" if in_class else "[0-9]")
            else:
                out.append(f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
            i += 2
            continue
        if c == "\\":
            out.append(two)
            i += 2
            continue
        in_class = (c == "[" or in_class) and c != "]"
        out.append("[^\n]" if c == "." and not in_class else c)
        i += 1
    return "".join(out)


def matches(c: Column, pattern: str) -> Column:
    """Whether an RE2 pattern occurs in a column."""
    return c.rlike(java_regex(pattern))


# ---- paths -----------------------------------------------------------------------------------------------------


def classify_path(path: Column) -> Column:
    """test, docs, script, config or runtime."""
    base, ext = base_name(path), extension(path)
    return (
        F.when(path.contains("__tests__/") | path.contains(".test.") | path.contains(".spec."), "test")
        .when(ext == ".md", "docs")
        .when(path.startswith("scripts/"), "script")
        .when(base.startswith(".env") | ext.isin(".json", ".yml", ".yaml", ".toml") | base.contains("config"), "config")
        .otherwise("runtime")
    )


def include_category(category: Column, *, tests: bool = True, docs: bool = True, config: bool = True, scripts: bool = True) -> Column:
    """Whether the switches let a category in; runtime always is."""
    off = [name for name, on in (("test", tests), ("docs", docs), ("config", config), ("script", scripts)) if not on]
    return ~category.isin(*off) if off else F.lit(True)


def include_callsite_category(category: Column, *, tests: bool = True, scripts: bool = True) -> Column:
    """As ``include_category``, docs and config always out."""
    return include_category(category, tests=tests, scripts=scripts, docs=False, config=False)


def skip_path(path: Column, *, hidden: bool = False, tmp: bool = False) -> Column:
    """Whether the walk leaves a file out: vendor folders, hidden names, the top-level tmp folder."""
    names = "|".join(re.escape(d) for d in SKIPPED_DIRS)
    out = path.rlike(rf"(^|/)({names})/")
    if not hidden:
        out = out | path.rlike(r"(^|/)\.")
    if not tmp:
        out = out | path.startswith("tmp/")
    return out


def is_searchable(path: Column) -> Column:
    """Whether the text search reads a file."""
    return base_name(path).startswith(".env") | extension(path).isin(*("." + e for e in SEARCHED_EXTENSIONS))


def file_kind(path: Column) -> Column:
    """page, layout, route, test, config, component or source, by name."""
    base = base_name(path)
    return (
        F.when(base.rlike(r"^page\.(tsx|ts|jsx|js)$"), "page")
        .when(base.rlike(r"^layout\.(tsx|ts|jsx|js)$"), "layout")
        .when(base.rlike(r"^route\.(ts|js)$"), "route")
        .when(path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__/"), "test")
        .when(base.contains("config"), "config")
        .when(extension(path).isin(".tsx", ".jsx"), "component")
        .otherwise("source")
    )


def normalize_path(path: Column) -> Column:
    """Trimmed, with forward slashes and without a leading ``./``; empty and ``.`` are null."""
    p = F.regexp_replace(F.regexp_replace(strip(path), r"\\", "/"), r"^\./", "")
    return F.when(~p.isin("", "."), p)


def resolve_dots(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` segments."""
    drop = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != "..")
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & F.when(F.size(acc) > 0, up(acc)).otherwise(False), drop(acc)).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def path_in_scope(path: Column, prefix: str = "", package: str = "") -> Column:
    """Whether a file is under a prefix and belongs to a package, by its path alone."""
    out = F.lit(True)
    if prefix:
        p = prefix.replace("\\", "/").removesuffix("/")
        out = out & ((path == p) | path.startswith(p + "/"))
    return out & package_scope(F.lit(""), path, package) if package else out


def package_scope(package_id: Column, path: Column, wanted: str) -> Column:
    """Whether a package id or a path belongs to a package filter."""
    raw = wanted.strip()
    name = raw.removeprefix("package:").lower()
    if not name:
        return F.lit(True)
    leaf, low, pkg = name.rpartition("/")[2], F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(package_id, F.lit("")))
    out = pkg.contains(name) | low.contains(name) | low.contains(raw.lower())
    return out | low.contains(f"/{leaf}/") | low.startswith(leaf + "/") if leaf else out


def matches_filters(package_id: Column, path: Column, *, package_exact: str = "", package: str = "", prefix: str = "") -> Column:
    """Package id (equal, with its prefix, or contained), package scope and path prefix together."""
    out = F.lit(True)
    if package_exact:
        have = F.coalesce(package_id, F.lit(""))
        out = out & ((have == package_exact) | (have == "package:" + package_exact) | have.contains(package_exact))
    if package:
        out = out & package_scope(package_id, path, package)
    if prefix:
        p = prefix.removesuffix("/")
        out = out & ((path == p) | path.startswith(p + "/"))
    return F.coalesce(out, F.lit(False))


def package_hint(path: Column) -> Column:
    """``packages/x`` or ``apps/x`` of a path, else empty."""
    return F.regexp_extract(path, r"^((?:packages|apps)/[^/]+)/", 1)


# ---- lines -----------------------------------------------------------------------------------------------------


def is_comment(line: Column, stripped: Column | None = None) -> Column:
    """Whether a line starts as a comment."""
    t = strip(line) if stripped is None else stripped
    return t.startswith("//") | t.startswith("*") | t.startswith("/*")


def brace_delta(line: Column) -> Column:
    """Opening less closing braces."""
    count = lambda b: F.length(line) - F.length(F.replace(line, F.lit(b), F.lit("")))
    return count("{") - count("}")


def classify_line(query: str, line: Column) -> Column:
    """runtime_env_read, env_assignment or literal_reference."""
    t = strip(line)
    reads = [f"process.env.{query}", f"process.env[{query}]", f'process.env["{query}"]', f"process.env['{query}']"]
    read = t.contains(reads[0])
    for r in reads[1:]:
        read = read | t.contains(r)
    return F.when(read, "runtime_env_read").when(t.contains(query + "="), "env_assignment").otherwise("literal_reference")


def snippet(path: Column, line: Column) -> Column:
    """The stripped line, without values of an env file and cut at 180 characters."""
    t = strip(line)
    secret = base_name(path).startswith(".env") & t.contains("=")
    return F.when(secret, F.concat(F.substring_index(t, "=", 1), F.lit("=<redacted>"))).when(F.length(t) > 180, F.concat(F.left(t, F.lit(177)), F.lit("..."))).otherwise(t)


# How a line defines, imports, calls or mentions a symbol SYM, as RE2 patterns.
SYMBOL_PATTERNS = {
    "definition": r"\b(?:function|class|interface|type|const|let|var)\s+SYM\b|\bSYM\s*[:=]\s*(?:async\s*)?(?:\([^)]*\)\s*=>|function\b)|\bSYM\s*\([^)]*\)\s*\{",
    "import": r"\bimport\b.*\bSYM\b",
    "method_call": r"\.SYM\s*\(",
    "call": r"\bSYM\s*\(",
    "jsx": r"<SYM(?:\s|/|>)",
    "reference": r"\bSYM\b",
}
CALL_PATTERN = r"(?:^|[^.\w$])SYM\s*\(|\.SYM\s*\("


def symbol_patterns(symbol: str) -> dict[str, str]:
    """RE2 patterns of the ways in which a line can use a symbol."""
    return {kind: p.replace("SYM", re.escape(symbol)) for kind, p in SYMBOL_PATTERNS.items()}


def symbol_line_kind(symbol: str, line: Column, stripped: Column | None = None) -> Column:
    """How a line uses a symbol; null if it doesn't or is a comment. The cheap containment test comes first."""
    t = strip(line) if stripped is None else stripped
    kind = F.when(t.startswith("//") | t.startswith("*"), F.lit(None))
    for name, pattern in symbol_patterns(symbol).items():
        kind = kind.when(matches(t, pattern), name)
    return F.when(line.contains(symbol), kind)


def kind_bucket(kind: Column) -> Column:
    """definition, import, reference or call."""
    return F.when(kind.isin("definition", "import", "reference"), kind).when(kind.isNotNull(), "call")


NAME = r"[A-Za-z_$][\w$]*"
# Lines that begin a function or variable, in the order in which they are tried.
OWNER_PATTERNS = (
    rf"^(?:export\s+)?(?:async\s+)?function\s+({NAME})(?:[^\w$]|\z|(?<=\w)(?=\$))",
    rf"^export\s+(?:const|let|var)\s+({NAME})\s*=",
    rf"^(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*=>",
    rf"^(?:async\s+)?({NAME})\s*\([^)]*\)\s*" + r"\{",
)


def owner_name(line: Column, stripped: Column | None = None) -> Column:
    """The function or variable that a line begins, or empty. Each expression is evaluated once."""
    t = strip(line) if stripped is None else stripped
    names = F.array(*(F.regexp_extract(t, java_regex(p), 1) for p in OWNER_PATTERNS))
    return F.coalesce(F.get(F.filter(names, lambda n: (n != "") & ~n.isin(*CONTROL_WORDS)), F.lit(0)), F.lit(""))


def call_pattern(symbol: str) -> str:
    """RE2 pattern of a call; the match may start one character before the name."""
    return CALL_PATTERN.replace("SYM", re.escape(symbol))


def is_definition_or_import(symbol: str, line: Column) -> Column:
    """Whether a line defines the symbol, imports, or re-exports."""
    t = strip(line)
    return t.startswith("import ") | (t.startswith("export ") & t.contains(" from ")) | matches(t, symbol_patterns(symbol)["definition"])


def rename_bucket(category: Column, env_read: Column) -> Column:
    """Where a file that mentions an old name goes."""
    return F.when(category == "test", "tests").when(category == "docs", "docs").when(category == "config", "config").when(env_read, "runtimeReads").when(category == "script", "scripts").otherwise("other")


def is_identifier(c: Column) -> Column:
    """Whether a query is a plain symbol name."""
    return c.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
