"""Column expressions on text, paths and predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language; .h is sniffed.
LANGUAGES = {
    "cs": "CSharp", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "java": "Java", "py": "Python", "go": "Go", "rs": "Rust", "c": "C",
    "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp", "hxx": "Cpp", "html": "Html", "htm": "Html", "md": "Text", "txt": "Text",
}
TEXT_LIMIT = 100 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def detect_language(path: Column, content: Column) -> Column:
    """Language by extension; a .h file with C++ marks in its first 4096 characters is Cpp, else C; otherwise Unknown."""
    ext, head = extension(path), F.substring(content, 1, 4096)
    marks = head.contains("class") | head.contains("namespace") | head.contains("template") | head.contains("::")
    found = F.when(ext == "h", F.when(marks, "Cpp").otherwise("C"))
    for e, language in LANGUAGES.items():
        found = found.when(ext == e, language)
    return found.otherwise("Unknown")


def truncate_utf8(text: Column, most: int = TEXT_LIMIT) -> Column:
    """At most so many UTF-8 bytes, cut at a character border.

    The cut falls back over at most three continuation bytes (10xxxxxx) to the
    start of the character it would split.
    """
    raw = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    border = lambda i: (byte(i) < 128) | (byte(i) >= 192)  # noqa: E731  a character starts at byte i
    end = F.when(border(most + 1), most).when(border(most), most - 1).when(border(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def chunk_id(symbol: Column, content: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", symbol, content, path), 256), 1, 32)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def like_compat(col: Column, pattern: str, bare: str = "contains") -> Column:
    """LIKE in which only a leading and a trailing % are wildcards; without either the text is contained, or equal."""
    core = pattern.removeprefix("%").removesuffix("%")
    if pattern.startswith("%") and pattern.endswith("%") and len(pattern) > 1:
        return col.contains(core)
    if pattern.endswith("%"):
        return col.startswith(core)
    if pattern.startswith("%"):
        return col.endswith(core)
    return col.contains(core) if bare == "contains" else col == core


def not_equal_compat(col: Column, value) -> Column:
    """Two-valued <>: a null differs from everything else."""
    return ~col.eqNullSafe(F.lit(value))


class IgnoreRules:
    """Ignore file rules as one column expression; the last rule that matches wins.

    Blank lines and comments are skipped; ``!`` negates; a trailing ``/`` means
    directories (anything below them); a leading or inner ``/`` anchors at the
    root; ``*``, ``?``, ``**`` and ``[...]`` are wildcards. ``compat`` reproduces
    the older behaviour in which a negated literal beats every rule and a
    negated glob ignores.
    """

    def __init__(self, text: str, compat: bool = False):
        self.compat = compat
        self.rules: list[tuple[bool, bool, str]] = []  # negated, literal, regex
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule.strip() or rule.startswith("#"):
                continue
            negated = rule.startswith("!")
            rule = rule[1:] if negated else rule.removeprefix("\\")
            self.rules.append((negated, not re.search(r"[*?\[]", rule), self._regex(rule)))

    @staticmethod
    def _regex(rule: str) -> str:
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        out, i = "", 0
        while i < len(rule):
            c = rule[i]
            if rule.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                out, i = out + ".*", i + 2
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and "]" in rule[i:]:
                j = rule.index("]", i)
                out, i = out + "[" + rule[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            else:
                out, i = out + re.escape(c), i + 1
        return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")

    def matches(self, path: Column) -> Column:
        """Whether a path relative to the root is ignored."""
        verdict = F.lit(False)
        if self.compat:
            for negated, literal, regex in self.rules:
                if not (negated and literal):
                    verdict = verdict | path.rlike(regex)
            for negated, literal, regex in self.rules:
                if negated and literal:
                    verdict = verdict & ~path.rlike(regex)
            return verdict
        for negated, _, regex in self.rules:
            verdict = F.when(path.rlike(regex), F.lit(not negated)).otherwise(verdict)
        return verdict
