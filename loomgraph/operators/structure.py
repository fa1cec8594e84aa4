"""Declarations, imports and calls of languages with braces (and Ruby), from one reading of each file.

Comments and strings are blanked first, so that neither braces nor words in them count; heads are found by a
language's patterns, and blocks by matching brackets.  A call belongs to the innermost function around it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

ROW = "path string, kind string, name string, start int, end int, parent string, exported boolean, params string, returns string"
Entry = tuple[str, str, int, int, str | None, bool, str | None, str | None]

_C_BLANKS = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_WITH_BACKTICKS = _C_BLANKS + r"|`(?:\\.|[^`\\])*`"
_HASH_BLANKS = r"\#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: Words before a bracket that call nothing.
_KEYWORDS = frozenset("if for while switch catch return function fn func fun def sizeof match when elseif else do in and or not await yield throw case typeof super new using lock foreach synchronized guard init".split())
_MODIFIERS = r"((?:(?:public|private|protected|internal|fileprivate|open|static|final|abstract|override|virtual|async|sealed|partial|synchronized|readonly|unsafe|extern|native|default|inline|suspend|operator|data|implicit|lazy|case|external|factory|const|mutating|convenience|required)\s+)*)"


@dataclass
class Language:
    """Patterns on blanked text; groups by name: ``name``, and ``mods``, ``returns``, ``owner`` where there are."""

    functions: list[str]
    types: list[str]
    imports: list[str]
    exported: Callable[[re.Match, str, bool], bool]  # of a head, its name, and whether it is at the top
    blanks: str = _C_BLANKS
    owners: list[str] = field(default_factory=list)  # blocks that give their name to what is inside, and are nothing themselves
    call: str = r"(?<![\w.$>:])((?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*[!?]?)\s*(?:<[\w, ]*>)?\("
    top_only: bool = False  # only functions outside types are functions; the others are methods
    returns: str = r"\s*(?:->|:)\s*([^{;=\n]+?)\s*(?=[{;=\n]|$)"
    exports: str = ""  # statements that export names


def _mods(m: re.Match) -> str:
    return m.groupdict().get("mods") or ""


def _public(m: re.Match, name: str, top: bool) -> bool:
    return "public" in _mods(m)


def _not_private(m: re.Match, name: str, top: bool) -> bool:
    return "private" not in _mods(m)


_TYPE = rf"^[ \t]*(?P<mods>{_MODIFIERS[1:-1]})"
LANGUAGES: dict[str, Language] = {
    "typescript": Language(
        [r"^[ \t]*(?P<mods>(?:export\s+)?(?:default\s+)?(?:async\s+)?)function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\(", r"^(?P<mods>(?:export\s+)?)(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?\((?=[^)]*\)[^\n]*=>)", r"^[ \t]+(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*)(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)[\w$#]+)\s*\((?=[^;]*?\)\s*(?::[^{;=]+)?\{)"],
        [r"^(?P<mods>(?:export\s+)?(?:default\s+)?)(?:abstract\s+)?class\s+(?P<name>\w+)", r"^(?P<mods>(?:export\s+)?)(?:interface|enum)\s+(?P<name>\w+)"],
        [r"^import\b[^'\"\n;]*['\"]([^'\"]+)['\"]", r"^export\b[^'\"\n;]*\bfrom\s+['\"]([^'\"]+)['\"]"],
        lambda m, name, top: "export" in _mods(m),
        _WITH_BACKTICKS,
        top_only=True,
        exports=r"^export\s*\{([^}]*)\}",
    ),
    "go": Language(
        [r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\("],
        [r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b"],
        [r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$"],
        lambda m, name, top: "A" <= name[0] <= "Z",
        _WITH_BACKTICKS,
        returns=r"\s*([^{\n]+?)\s*\{",
    ),
    "rust": Language(
        [r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:(?:const|async|unsafe)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\("],
        [r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:struct|enum|trait)\s+(?P<name>\w+)"],
        [r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", r"^[ \t]*(?:pub\s+)?mod\s+(\w+)\s*;"],
        lambda m, name, top: "pub" in _mods(m),
        r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
        owners=[r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>\w+)"],
    ),
    "java": Language(
        [rf"^[ \t]+(?P<mods>{_MODIFIERS[1:-1]})(?:<[^>]+>\s+)?(?:(?P<returns>(?!return\b|new\b|else\b|throw\b)[\w<>\[\].?]+(?:\s*,\s*[\w<>\[\].?]+)*)\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|synchronized\b)[A-Za-z_]\w*)\s*\((?=[^;{{]*\)\s*(?:throws\s+[\w., ]+)?\s*\{{)"],
        [rf"{_TYPE}(?:class|interface|enum|record)\s+(?P<name>\w+)"],
        [r"^import\s+(?:static\s+)?([\w.*]+);"],
        _public,
    ),
    "csharp": Language(
        [rf"^[ \t]+(?P<mods>{_MODIFIERS[1:-1]})(?:(?P<returns>(?!return\b|new\b|else\b|throw\b|await\b)[\w<>\[\].?]+(?:\s*,\s*[\w<>\[\].?]+)*)\s+)?(?P<name>(?!if\b|for\b|foreach\b|while\b|switch\b|catch\b|using\b|lock\b)[A-Za-z_]\w*)\s*(?:<[^>]*>)?\((?=[^;{{]*\)\s*(?::\s*(?:base|this)[^{{]*)?(?:\{{|=>))"],
        [rf"{_TYPE}(?:class|interface|struct|record|enum)\s+(?P<name>\w+)"],
        [r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+);"],
        _public,
    ),
    "php": Language(
        [r"^[ \t]*(?P<mods>(?:(?:public|private|protected|static|final|abstract)\s+)*)function\s+&?(?P<name>\w+)\s*\("],
        [r"^[ \t]*(?P<mods>(?:(?:final|abstract)\s+)*)(?:class|interface|trait)\s+(?P<name>\w+)"],
        [r"^\s*use\s+([\w\\]+)(?:\s+as\s+\w+)?;"],
        lambda m, name, top: top,
        _C_BLANKS + r"|\#(?!\[)[^\n]*",
        call=r"(?<![\w>:\\])((?:new\s+)?(?:\$\w+->|[A-Z]\w*::)*[A-Za-z_]\w*)\s*\(",
    ),
    "cpp": Language(
        [r"^[ \t]*(?P<mods>(?:(?:static|inline|virtual|explicit|constexpr|extern)\s+)*)(?:(?P<returns>(?!return\b|else\b|new\b|class\b|struct\b)[\w:<>,*&]+(?:[ \t]+[\w:<>,*&]+)*?)[ \t*&]+)?(?:(?P<owner>\w+)::)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b)~?[A-Za-z_]\w*)\s*\((?=[^;{}()]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?::[^{;]*)?\{)"],
        [r"^[ \t]*(?P<mods>)(?:class|struct)\s+(?P<name>\w+)[^;{]*(?=\{)"],
        [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"],
        lambda m, name, top: "static" not in _mods(m),
        owners=[],
    ),
    "kotlin": Language(
        [rf"^[ \t]*(?P<mods>{_MODIFIERS[1:-1]})fun\s+(?:<[^>]+>\s*)?(?:[\w<>]+\.)?(?P<name>\w+)\s*\("],
        [rf"{_TYPE}(?:enum\s+)?(?:class|object|interface)\s+(?P<name>\w+)"],
        [r"^import\s+([\w.*]+)"],
        _not_private,
    ),
    "swift": Language(
        [rf"^[ \t]*(?P<mods>{_MODIFIERS[1:-1]})func\s+(?P<name>\w+)\s*(?:<[^>]*>)?\(", rf"^[ \t]+(?P<mods>{_MODIFIERS[1:-1]})(?P<name>init)\s*[?!]?\("],
        [rf"{_TYPE}(?:class|struct|enum|actor|protocol|extension)\s+(?P<name>\w+)"],
        [r"^import[ \t]+(?:(?:class|struct|enum|protocol|func|var|let|typealias)[ \t]+)?(\w+)"],
        _not_private,
    ),
    "dart": Language(
        [r"^[ \t]*(?P<mods>(?:(?:static|external|factory)\s+)*)(?:(?P<returns>(?!return\b|else\b|new\b|await\b)[\w<>?,\[\]]+)\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b)[A-Za-z_]\w*)\s*\((?=[^;{}]*\)\s*(?:async\*?\s*|sync\*\s*)?(?:\{|=>))"],
        [r"^[ \t]*(?P<mods>(?:abstract\s+)?)(?:class|mixin|enum)\s+(?P<name>\w+)", r"^extension\s+(?P<name>\w+)\s+on\s+\w+"],
        [r"^(?:import|export)\s+['\"]([^'\"]+)['\"]"],
        lambda m, name, top: not name.startswith("_"),
    ),
    "scala": Language(
        [rf"^[ \t]*(?P<mods>{_MODIFIERS[1:-1]})def\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("],
        [rf"{_TYPE}(?:class|trait|object|enum)\s+(?P<name>\w+)"],
        [r"^\s*import\s+([\w.{}, =>*]+)"],
        _not_private,
    ),
}
LANGUAGES["javascript"] = LANGUAGES["tsx"] = LANGUAGES["typescript"]
LANGUAGES["c"] = LANGUAGES["cpp"]


def blanked(text: str, pattern: str) -> str:
    """Comments and strings as blanks of the same length; line feeds stay."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _matching(text: str, at: int, pair: str) -> int:
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


def braced(text: str, lang: Language) -> Iterator[Entry]:
    plain = blanked(text, lang.blanks)
    feeds = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(feeds, at - 1) + 1
    types: list[tuple[int, int, str]] = []
    for patterns, shown in ((lang.types, True), (lang.owners, False)):
        for p in patterns:
            for m in re.finditer(p, plain, re.M):
                brace, stop = plain.find("{", m.end()), plain.find(";", m.end())
                feed = plain.find("\n", m.end())
                end = _matching(plain, brace, "{}") if brace >= 0 and not 0 <= stop < brace and (feed < 0 or not plain[m.end() : brace].count("\n") > 1) else max(m.end(), feed if feed >= 0 else len(plain)) - 1
                types.append((m.start(), end, m["name"]))
                if shown:
                    around = [t for t in types if t[0] < m.start() and m.start() < t[1]]
                    yield ("class", m["name"], line(m.start("name")), line(end), around[-1][2] if around else None, lang.exported(m, m["name"], not around), None, None)
    functions: list[tuple[int, int, str, int]] = []
    for p in lang.functions:
        for m in re.finditer(p, plain, re.M):
            bracket = m.end() - 1
            if any(b == bracket for *_, b in functions):
                continue
            close = _matching(plain, bracket, "()")
            body = re.compile(r"[ \t]*[^;{}=\n]*?\s*(?:=>?\s*)?\{").match(plain, close + 1)
            feed = plain.find("\n", close)
            end = _matching(plain, body.end() - 1, "{}") if body else feed if feed >= 0 else len(plain)
            inside = [t for t in types if t[0] < m.start() < t[1]]
            owner = m.groupdict().get("owner") or (max(inside)[2] if inside else None)
            params = re.sub(r"\s+", " ", text[bracket + 1 : close]).strip()
            returns = m.groupdict().get("returns") or ((r[1].strip() if (r := re.compile(lang.returns).match(plain, close + 1)) else None) if "returns" not in m.re.groupindex else None)
            functions.append((m.start(), end, m["name"], bracket))
            yield ("method" if owner and lang.top_only else "function", m["name"], line(m.start("name")), line(end), owner, lang.exported(m, m["name"], not owner), params, returns or None)
    functions.sort()
    heads = {f[3] for f in functions}
    for m in re.finditer(lang.call, plain):
        at = m.end() - 1
        name = re.sub(r"\s+", " ", m[1])
        if at in heads or name in _KEYWORDS:
            continue
        around = [f for f in functions if f[0] < m.start() <= f[1]]
        if around:
            yield ("call", name, line(m.start(1)), line(m.start(1)), max(around)[2], False, None, None)
    kept = blanked(text, r"//[^\n]*|/\*.*?\*/")
    for p in lang.imports:
        for m in re.finditer(p, kept, re.M):
            yield ("import", m[1].strip(), line(m.start()), line(m.start()), None, False, None, None)
    if lang.exports:
        for m in re.finditer(lang.exports, plain, re.M):
            for name in filter(None, (re.sub(r".*\bas\s+", "", x).strip() for x in m[1].split(","))):
                yield ("export", name, line(m.start()), line(m.start()), None, True, None, None)


def ruby(text: str) -> Iterator[Entry]:
    """Blocks end at the ``end`` of their own indentation."""
    plain = blanked(text, _HASH_BLANKS)
    rows = plain.split("\n")
    types: list[tuple[int, int, str]] = []
    functions: list[tuple[int, int, str]] = []
    for i, row in enumerate(rows, 1):
        m = re.match(r"^(\s*)(class|module|def)\s+((?:self\.)?[\w:]+[?!=]?)\s*(?:\(([^)]*)\))?", row)
        if not m:
            continue
        end = next((j for j in range(i + 1, len(rows) + 1) if re.match(rf"^{m[1]}end\b", rows[j - 1])), len(rows))
        around = [t for t in types if t[0] < i <= t[1]]
        owner = max(around)[2] if around else None
        if m[2] == "def":
            functions.append((i, end, m[3]))
            yield ("function", m[3], i, end, owner, owner is None, (m[4] or "").strip(), None)
        else:
            types.append((i, end, m[3]))
            yield ("class", m[3], i, end, owner, owner is None, None, None)
    for i, row in enumerate(rows, 1):
        around = [f for f in functions if f[0] < i < f[1]]
        for m in re.finditer(r"(?<![\w.:])((?:[A-Za-z_@]\w*\.)*[A-Za-z_]\w*[!?]?)\s*\(", row) if around else ():
            if m[1] not in _KEYWORDS:
                yield ("call", m[1], i, i, max(around)[2], False, None, None)
    for m in re.finditer(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", text, re.M):
        i = text.count("\n", 0, m.start(1)) + 1
        yield ("import", m[1], i, i, None, False, None, None)


def python(text: str) -> Iterator[Entry]:
    """The syntax tree's rows, with parameters and return types."""
    import ast

    tree = ast.parse(text)
    heads = {(x.name, x.lineno): x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)}
    for kind, name, start, end, parent, exported in blocks.python_tree(text):
        x = heads.get((name, start)) if kind in ("function", "method", "inner") else None
        params = ", ".join(a.arg for a in [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]) if x else None
        yield (kind, name, start, end, parent, exported, params, ast.unparse(x.returns) if x and x.returns else None)


def entries(language: str, text: str) -> list[Entry]:
    """All rows of a file: structure and calls come from one reading."""
    if language == "python":
        return list(python(text))
    if language == "ruby":
        return list(ruby(text))
    if language in LANGUAGES:
        return sorted(braced(text, LANGUAGES[language]), key=lambda e: (e[2], e[0] == "call"))
    return [(*e, None, None) for e in blocks.PARSERS[language](text)]


#: Languages whose files have calls (their other outcomes are about structure alone).
CALLING = ["python", "ruby", *LANGUAGES, "shell"]


#: Files whose rows a worker holds at once.
HELD = 256


def structure(files: DataFrame, rows: bool = True) -> DataFrame:
    """Rows of all files (``path, language, content``); a file that fails has one row of kind ``failed``, one without a parser ``skipped``.

    Without ``rows``, files are read as wholly, and only the row that tells how that ended is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
        for batch in (b.slice(s, HELD) for b in batches for s in range(0, len(b), HELD)):
            out: list[tuple] = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if language not in ("python", "ruby") and language not in LANGUAGES and language not in blocks.PARSERS:
                    out.append((path, "skipped", language or "", 0, 0, None, False, None, None))
                    continue
                try:
                    found = entries(language, content or "")
                    out += [(path, *e) for e in found if rows]
                    out.append((path, "parsed", language, 1, (content or "").count("\n") + 1, None, False, None, None))
                except Exception as e:  # one bad file must not end the job; it is told
                    out.append((path, "failed", type(e).__name__, 0, 0, None, False, None, None))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    return files.select("path", "language", "content").mapInArrow(run, ROW)


def outcomes(found: DataFrame, files: DataFrame) -> DataFrame:
    """``path, structure, calls``: succeeded, failed or skipped; calls are for code and scripts only (``files``: path, category)."""
    of = F.when(F.col("kind") == "failed", "failed").when(F.col("kind") == "skipped", "skipped").when(F.col("kind") == "parsed", "succeeded")
    per = found.withColumn("of", of).where("of is not null").select("path", "of")
    met = files.select("path", "category").join(per, "path", "left").withColumn("of", F.coalesce("of", F.lit("skipped")))
    return met.select("path", F.col("of").alias("structure"), F.when(F.col("category").isin("code", "script"), F.col("of")).otherwise("skipped").alias("calls"))


def exports(found: DataFrame) -> DataFrame:
    """``path, name, line``: declarations and statements that export, each name once, at its first line."""
    own = found.where("exported and kind in ('function', 'class', 'export')")
    return own.groupBy("path", "name").agg(F.min("start").alias("line"))


def metrics(files: DataFrame, found: DataFrame, resolved: DataFrame) -> DataFrame:
    """``path, total_lines, non_empty_lines`` and counts of functions, classes, exports, imports and calls.

    A final line feed opens no line; imports are those resolved, or, where nothing is resolved for a file, the relative ones.
    """
    lines = F.split("content", "\n")
    total = F.size(lines) - F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 1).otherwise(0)
    full = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    counted = found.groupBy("path").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("function", "class", "call")],
        F.count_if((F.col("kind") == "import") & F.col("name").startswith(".")).alias("relative"),
    )
    shown = exports(found).groupBy("path").agg(F.count(F.lit(1)).alias("export_count"))
    met = resolved.groupBy(F.col("source").alias("path")).agg(F.count_distinct("target").alias("resolved"))
    joined = files.select("path", total.cast("long").alias("total_lines"), full.cast("long").alias("non_empty_lines")).join(counted, "path", "left").join(shown, "path", "left").join(met, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select("path", "total_lines", "non_empty_lines", *[zero(f"{c}_count").alias(f"{c}_count") for c in ("function", "class", "export", "call")], F.coalesce("resolved", "relative", F.lit(0)).cast("long").alias("import_count"))


def language_of(path: Column) -> Column:
    from ..sources.files import detect_language

    return detect_language(path)
