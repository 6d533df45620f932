"""Symbols and references from source text, per file, over Arrow batches.

Python goes through its own ``ast``. The brace languages (C#, Java, JavaScript,
TypeScript, Go, Rust, C, C++) go through a scanner that blanks comments and
strings, then follows braces: it finds types, functions, methods, constructors,
properties, fields and constants by their declarations, base lists after
``:`` / ``extends`` / ``implements``, embedded structs, types of parameters and results,
and calls and ``new`` in bodies. HTML gives
elements with an id. Macros, templates spread over lines and generated code are
beyond it; a file it can't read gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SYMBOL_ROWS = "file_path string, language string, name string, kind string, full_name string, line_start int, line_end int, modifiers string, documentation string"
REFERENCE_ROWS = "file_path string, source string, target string, relationship_type string, line int"

_MODIFIERS = "public|private|protected|internal|static|abstract|sealed|final|async|override|virtual|readonly|partial|export|default|const|pub|unsafe|extern|inline|synchronized|native|required|new"
_MODS = rf"(?P<mods>(?:(?:{_MODIFIERS})(?:\([^)]*\))?\s+)*)"
_TYPE = re.compile(rf"^\s*(?:\[[^\]]*\]\s*)*{_MODS}(?P<kw>class|interface|struct|enum|record|trait|namespace|module|impl|union)(?:\s+(?:class|struct))?\s+(?:<[^>]*>\s*)?(?P<name>[A-Za-z_][\w.:]*)(?P<rest>[^{{;]*)")
_GO_TYPE = re.compile(r"^\s*type\s+(?P<name>\w+)\s+(?P<kw>struct|interface)\b(?P<rest>)")
_FUNC = re.compile(rf"^\s*{_MODS}(?:func|fn|function)\s*\*?\s*(?P<recv>\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\(")
_METHOD = re.compile(rf"^\s*(?:\[[^\]]*\]\s*)*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^>]+>\s*)?(?P<ret>[\w<>\[\],.?&*:]+(?:\s*<[^()]*>)?[\s*&]+)?(?P<name>~?[A-Za-z_]\w*)\s*(?:<[^>()]*>)?\s*\([^;{{}}]*\)?[^;={{}}]*(?P<end>\{{|=>|;|$)")
_PROPERTY = re.compile(rf"^\s*{_MODS}(?P<ret>[\w<>\[\],.?]+)\s+(?P<name>[A-Za-z_]\w*)\s*(?:\{{\s*(?:(?:public|private|protected|internal)\s+)?(?:get|set|init)\b|=>)")
_EVENT = re.compile(rf"^\s*{_MODS}event\s+[\w<>.?]+\s+(?P<name>\w+)\s*[;{{=]")
_FIELD = re.compile(rf"^\s*{_MODS}(?P<ret>[\w<>\[\],.?*&:]+)[\s*&]+(?P<name>[A-Za-z_]\w*)\s*(?:=[^=>].*)?;")
_TS_FIELD = re.compile(rf"^\s*{_MODS}(?P<name>[A-Za-z_$]\w*)\s*[?!]?\s*:\s*(?P<ret>[^=;(){{}}]+?)\s*(?:=.*)?;")
_VARIABLE = re.compile(r"^\s*(?P<mods>(?:export\s+)?)(?:const|let|var|static)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)\s*(?::[^=]+)?=")
_EMBEDDED = re.compile(r"^\s*\*?(?:\w+\.)?([A-Za-z_]\w*)\s*(?:`[^`]*`)?\s*$")
_NOT_NAMES = frozenset("if for foreach while switch catch using lock return new throw else do try finally match loop sizeof typeof await yield case when in is as not and or function fn func delete defer go select import package with".split())
_PRIMITIVES = frozenset("int long short byte char bool boolean float double decimal string str void var object let const auto number any unknown never unsigned signed usize isize u8 u16 u32 u64 i8 i16 i32 i64 f32 f64 self this base super".split())
_KINDS = {"class": "Class", "interface": "Interface", "struct": "Struct", "enum": "Enum", "record": "Record", "trait": "Interface", "namespace": "Namespace", "module": "Module", "union": "Struct"}


def _blank(text: str) -> str:
    """The text with comments and string contents blanked, lines kept."""
    pattern = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n]){1,8}'|`[^`]*`", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text)


def _doc(lines: list[str], at: int) -> str | None:
    found = []
    while at > 0 and lines[at - 1].strip().startswith(("///", "/**", "*", "*/", "//!", "#", "[", "@")):
        at -= 1
        if not lines[at].strip().startswith(("[", "@")):
            found.append(re.sub(r"</?\w+>", "", re.sub(r"^\s*(///|//!|/\*\*|\*/|\*|#)\s?", "", lines[at])).strip())
    return " ".join(x for x in reversed(found) if x) or None


def _scan(text: str, language: str) -> tuple[list[dict], list[dict]]:
    source, lines = text.split("\n"), _blank(text).split("\n")
    symbols, refs, stack, depth = [], [], [], 0  # stack: (depth inside, symbol or None)
    pending = None
    for i, line in enumerate(lines):
        owner = next((s for _, s in reversed(stack) if s), None)
        in_body = owner is not None and owner["kind"] in ("Method", "Function", "Constructor")
        name = kind = None
        mods = ""
        if m := _TYPE.match(line) or (_GO_TYPE.match(line) if language == "Go" else None):
            name, kind, mods = m["name"], _KINDS.get(m["kw"]), m.groupdict().get("mods") or ""
            if m["kw"] == "impl":
                t = re.search(r"\bfor\s+(\w+)", m["rest"])
                if t:
                    refs.append({"source": t[1], "target": name, "relationship_type": "Implements", "line": i + 1})
                    name = t[1]
                pending = {"name": name, "kind": "Impl", "full_name": name, "line_start": i + 1, "line_end": i + 1}
                kind = None
            elif bases := re.search(r"(?::(?!:)|\bextends\b|\bimplements\b)(.*)", m["rest"]):
                for part in re.split(r",|\bimplements\b|\bextends\b|\+", bases[1].split(" where ")[0]):
                    base = re.sub(r"<.*|\(.*|\b(public|private|protected|virtual)\b", "", part).strip()
                    if re.fullmatch(r"[A-Za-z_][\w.:]*", base):
                        refs.append({"source": name, "target": base, "relationship_type": "Implements" if f"implements {base}" in m["rest"] or kind == "Interface" or re.match(r"I[A-Z]", base) else "Inherits", "line": i + 1})
        elif m := _FUNC.match(line):
            name, kind, mods = m["name"], "Function", m["mods"]
            if m["recv"]:
                kind = "Method"
                name = re.sub(r"[()*\s]|^\s*\(\s*\w+\s+", " ", m["recv"]).split()[-1] + "." + name
            elif owner is not None and not in_body:
                kind = "Method"
        elif not in_body and (m := _EVENT.match(line)):
            name, kind, mods = m["name"], "Event", m["mods"]
        elif not in_body and owner is not None and (m := _PROPERTY.match(line)) and m["ret"] not in _NOT_NAMES:
            name, kind, mods = m["name"], "Property", m["mods"]
        elif not in_body and (m := _METHOD.match(line)) and m["name"] not in _NOT_NAMES and (m["ret"] or owner) and (m["end"] != ";" or owner) and (m["ret"] or "").strip() not in _NOT_NAMES:
            name, mods = m["name"], m["mods"]
            own = owner["name"].split(".")[-1] if owner else ""
            kind = "Method" if owner else "Function"
            if not m["ret"] and name != own and name != "constructor" and language not in ("JavaScript", "TypeScript"):
                name = None
        elif not in_body and owner is not None and owner["kind"] != "Namespace" and (m := (_TS_FIELD if language == "TypeScript" else _FIELD).match(line)) and m["ret"] not in _NOT_NAMES:
            name, kind, mods = m["name"], "Field", m["mods"]
        elif owner is None and (m := _VARIABLE.match(line)):
            name, kind, mods = m["name"], "Variable", m["mods"]
        if name and kind:
            prefix = next((s["full_name"] for _, s in reversed(stack) if s and s["kind"] != "Namespace"), "")
            space = ".".join(s["full_name"] for _, s in stack if s and s["kind"] == "Namespace")
            full = ".".join(x for x in (prefix or space, name) if x)
            symbol = {"name": name.split(".")[-1], "kind": kind, "full_name": full, "line_start": i + 1, "line_end": i + 1, "modifiers": ",".join(mods.split()) or None, "documentation": _doc(source, i)}
            if kind != "Namespace":
                symbols.append(symbol)
            pending = symbol if kind not in ("Field", "Variable", "Event") else None
        elif in_body:
            for m in re.finditer(r"\bnew\s+([A-Z]\w*)", line):
                refs.append({"source": owner["full_name"], "target": m[1], "relationship_type": "References", "line": i + 1})
            for m in re.finditer(r"(?<!new )\b([A-Za-z_]\w*)\s*\(", line):
                if m[1] not in _NOT_NAMES and m[1] not in _PRIMITIVES:
                    refs.append({"source": owner["full_name"], "target": m[1], "relationship_type": "Calls", "line": i + 1})
        if owner is not None and owner["kind"] == "Struct" and language == "Go" and not name and (e := _EMBEDDED.match(line)):
            refs.append({"source": owner["full_name"], "target": e[1], "relationship_type": "Inherits", "line": i + 1})
        if kind in ("Method", "Function") and name and language not in ("JavaScript", "Html"):
            # types of parameters and what is returned: in these languages they begin with a capital letter
            declared = line[m.end("name") :].split("{")[0] + " " + (m.groupdict().get("ret") or "")
            for t in dict.fromkeys(re.findall(r"(?<![\w.\"'])[A-Z]\w*", declared)):
                refs.append({"source": symbols[-1]["full_name"], "target": t, "relationship_type": "References", "line": i + 1})
        if kind in ("Field", "Property") and name and m["ret"]:
            for t in re.findall(r"[A-Za-z_]\w*", m["ret"]):
                if t.lower() not in _PRIMITIVES:
                    refs.append({"source": symbols[-1]["full_name"], "target": t, "relationship_type": "References", "line": i + 1})
        for c in line:
            if c == "{":
                depth += 1
                stack.append((depth, pending))
                pending = None
            elif c == "}" and depth:
                while stack and stack[-1][0] >= depth:
                    _, s = stack.pop()
                    if s:
                        s["line_end"] = i + 1
                depth -= 1
            elif c == ";":
                pending = None
    return symbols, refs


def _python(text: str) -> tuple[list[dict], list[dict]]:
    symbols, refs = [], []

    def visit(node: ast.AST, prefix: str, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                full = f"{prefix}.{child.name}" if prefix else child.name
                kind = "Class" if isinstance(child, ast.ClassDef) else "Method" if inside == "Class" else "Function"
                symbols.append({"name": child.name, "kind": kind, "full_name": full, "line_start": child.lineno, "line_end": child.end_lineno, "modifiers": "async" if isinstance(child, ast.AsyncFunctionDef) else None, "documentation": ast.get_docstring(child)})
                for base in getattr(child, "bases", []):
                    if isinstance(base, ast.Name | ast.Attribute):
                        refs.append({"source": full, "target": base.id if isinstance(base, ast.Name) else base.attr, "relationship_type": "Inherits", "line": child.lineno})
                if kind != "Class":
                    for call in ast.walk(child):
                        if isinstance(call, ast.Call) and isinstance(call.func, ast.Name | ast.Attribute):
                            refs.append({"source": full, "target": call.func.id if isinstance(call.func, ast.Name) else call.func.attr, "relationship_type": "Calls", "line": call.lineno})
                visit(child, full, kind)
            elif isinstance(child, ast.Assign) and not inside:
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        symbols.append({"name": t.id, "kind": "Variable", "full_name": t.id, "line_start": child.lineno, "line_end": child.end_lineno, "modifiers": None, "documentation": None})
            elif not isinstance(child, ast.expr):
                visit(child, prefix, inside)

    visit(ast.parse(text), "", "")
    return symbols, refs


def _html(text: str) -> tuple[list[dict], list[dict]]:
    found = []
    for m in re.finditer(r"<(\w+)[^>]*?\bid\s*=\s*[\"']([^\"']+)[\"']", text):
        line = text.count("\n", 0, m.start()) + 1
        found.append({"name": m[2], "kind": "Element", "full_name": m[2], "line_start": line, "line_end": line, "modifiers": m[1].lower(), "documentation": None})
    return found, []


def extract(text: str | None, language: str) -> tuple[list[dict], list[dict]]:
    """(symbols, references) of one file; symbols once for each full name."""
    if not text:
        return [], []
    try:
        symbols, refs = _python(text) if language == "Python" else _html(text) if language == "Html" else _scan(text, language)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    return list({s["full_name"]: s for s in reversed(symbols)}.values())[::-1], refs


def _rows(which: int, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, language in zip(frame["file_path"], frame["content"], frame["language"], strict=True):
                out += [{"file_path": path, "language": language, **r} for r in extract(content, language)[which]]
            yield pd.DataFrame(out, columns=columns)

    return run


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _dealt(files: DataFrame) -> DataFrame:
    """The files in four tasks for each core, however few splits they came in: parsing takes far longer than moving the text."""
    spark = files.sparkSession
    ship(spark)
    return files.select("file_path", "content", "language").repartition(4 * spark.sparkContext.defaultParallelism, "file_path", "content")


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of files(file_path, content, language), without ids."""
    return _dealt(files).mapInPandas(_rows(0, _columns(SYMBOL_ROWS)), SYMBOL_ROWS)


def extract_references(files: DataFrame) -> DataFrame:
    """Raw references: source full name, target name as written."""
    return _dealt(files).mapInPandas(_rows(1, _columns(REFERENCE_ROWS)), REFERENCE_ROWS)


def with_symbol_ids(rows: DataFrame) -> DataFrame:
    """Deterministic ids from file, full name and line: equal names in different files stay apart."""
    key = F.concat_ws("|", "file_path", "full_name", F.col("line_start").cast("string"))
    return rows.select(F.substring(F.sha2(key, 256), 1, 32).alias("id"), "name", "kind", "file_path", "line_start", "line_end", "full_name", "modifiers", "documentation")
