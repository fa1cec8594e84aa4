"""Parsers that must follow nesting, in Arrow batches: Python by its syntax tree, brace languages by depth, YAML and JSON by key."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROW = "path string, kind string, name string, start int, end int, parent string, exported boolean"
Found = Iterator[tuple[str, str, int, int, str | None, bool]]


def python_tree(text: str) -> Found:
    """Top-level functions and classes (with methods), imports, and calls as callee text under the innermost function."""
    tree = ast.parse(text)

    def walk(node: ast.AST, owner: str | None, top: bool) -> Found:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                yield ("function" if top else "method" if isinstance(node, ast.ClassDef) else "inner", x.name, x.lineno, x.end_lineno or x.lineno, owner, top)
                yield from walk(x, x.name, False)
            elif isinstance(x, ast.ClassDef):
                yield ("class", x.name, x.lineno, x.end_lineno or x.lineno, owner, top)
                yield from walk(x, x.name if owner is None or isinstance(node, ast.Module) else owner, False)
            else:
                if isinstance(x, ast.Import):
                    yield from (("import", a.name, x.lineno, x.lineno, None, False) for a in x.names)
                elif isinstance(x, ast.ImportFrom):
                    yield ("import", "." * x.level + (x.module or ""), x.lineno, x.lineno, None, False)
                elif isinstance(x, ast.Call) and owner is not None:
                    yield ("call", ast.unparse(x.func), x.lineno, x.lineno, owner, False)
                yield from walk(x, owner, False)

    yield from walk(tree, None, True)


def _closing(text: str, at: int) -> int:
    """The place of the brace that closes the first one from at on; the text's end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def braced(heads: list[tuple[str, str]], inner: dict[str, list[tuple[str, str]]]) -> Callable[[str], Found]:
    """Blocks by the patterns of their heads (kind, pattern with a group for the name), and entries of theirs."""
    compiled = [(k, re.compile(p, re.M)) for k, p in heads]
    entries = {k: [(e, re.compile(p, re.M)) for e, p in ps] for k, ps in inner.items()}

    def parse(text: str) -> Found:
        for kind, head in compiled:
            for m in head.finditer(text):
                name = ".".join(g for g in m.groups() if g)
                end = _closing(text, m.start()) if "{" in text[m.start() : m.end() + 2] else m.end()
                yield (kind, name, _line(text, m.start()), _line(text, end), None, True)
                for e, p in entries.get(kind, []):
                    for x in p.finditer(text, m.end(), end):
                        yield (e, x[1], _line(text, x.start()), _line(text, x.end()), name, True)

    return parse


_graphql = braced(
    [(k, rf"^\s*{k}\s+(\w+)[^{{\n]*\{{") for k in ("type", "input", "enum", "interface")] + [("union", r"^\s*union\s+(\w+)"), ("scalar", r"^\s*scalar\s+(\w+)")],
    {k: [("field", r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:")] for k in ("type", "input", "interface")},
)
def graphql(text: str) -> Found:
    """Types and their fields; those of Query, Mutation and Subscription are endpoints."""
    for kind, name, start, end, parent, exported in _graphql(text):
        yield ("endpoint" if kind == "field" and parent in ("Query", "Mutation", "Subscription") else kind, name, start, end, parent, exported)


protobuf = braced(
    [(k, rf"^\s*{k}\s+(\w+)\s*\{{") for k in ("message", "enum", "service")],
    {"message": [("field", r"^\s*(?:repeated\s+|optional\s+)?[\w.<>, ]+\s+(\w+)\s*=\s*\d+")], "enum": [("value", r"^\s*(\w+)\s*=\s*\d+")], "service": [("endpoint", r"rpc\s+(\w+)")]},
)
terraform = braced([("resource", r'^(?:resource|data)\s+"([^"]+)"\s+"([^"]+)"\s*\{'), ("module", r'^module\s+"([^"]+)"\s*\{'), ("variable", r'^variable\s+"([^"]+)"\s*\{'), ("output", r'^output\s+"([^"]+)"\s*\{')], {})
shell = braced([("function", r"^[ \t]*(?:function[ \t]+)?([A-Za-z_][\w-]*)[ \t]*\(\)\s*\{?"), ("function", r"^[ \t]*function[ \t]+([A-Za-z_][\w-]*)\s*\{"), ("source", r"^\s*(?:source|\.)\s+[\"']?([^\s\"']+)")], {})


def yaml_keys(text: str) -> Found:
    """Top-level keys, to the line before the next."""
    lines = text.split("\n")
    at = [(i, m[1]) for i, x in enumerate(lines, 1) if (m := re.match(r"^([A-Za-z_][\w.-]*)\s*:(?:\s|$)", x))]
    for (i, name), (j, _) in zip(at, [*at[1:], (len(lines) + 1, "")], strict=True):
        yield ("section", name, i, j - 1, None, True)


def json_keys(text: str) -> Found:
    """Top-level keys after comments and trailing commas are taken out; and external ``$ref`` targets."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    plain = re.sub(r",(\s*[}\]])", r"\1", plain)
    try:
        root = json.loads(plain)
    except ValueError:
        return
    if isinstance(root, dict):
        for name in root:
            at = text.find(json.dumps(name))
            line = _line(text, max(at, 0))
            yield ("section", name, line, line, None, True)
    for m in re.finditer(r'"\$ref"\s*:\s*"([^"#][^"]*)"', text):
        yield ("reference", m[1], _line(text, m.start()), _line(text, m.start()), None, False)


PARSERS: dict[str, Callable[[str], Found]] = {"python": python_tree, "graphql": graphql, "protobuf": protobuf, "terraform": terraform, "shell": shell, "yaml": yaml_keys, "json": json_keys, "jsonc": json_keys}


def register(language: str, parser: Callable[[str], Found]) -> None:
    """The last parser of a language holds."""
    PARSERS[language] = parser


def parse_files(files: DataFrame, parsers: dict[str, Callable[[str], Found]] | None = None) -> DataFrame:
    """Rows of all files (``path, language, content``) whose language has a parser; a file that fails gives one row of kind ``failed``."""
    table = dict(PARSERS if parsers is None else parsers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(path, *x) for x in table[language](content or "")]
                except Exception as e:  # one bad file must not end the job; it is told
                    out.append((path, "failed", type(e).__name__, 0, 0, None, False))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    return files.where(files.language.isin(list(table))).select("path", "language", "content").mapInArrow(run, ROW)
