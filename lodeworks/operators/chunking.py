"""Deterministic chunks: of types (imports and body), members (parent header) and whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, truncate_utf8

TYPE_KINDS = ("Class", "Interface", "Struct", "Enum", "Record")
MEMBER_KINDS = ("Method", "Property", "Field", "Event", "Constructor", "Function")
_IMPORT = r"^\s*(using |import |from |#include|use |package |namespace )"


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1) of a text, joined again."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def imports(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(_IMPORT)), "\n")


def with_header(parent: Column, body: Column) -> Column:
    return F.concat(F.lit("// Parent: "), parent, F.lit("\n"), body)


def file_chunks(files: DataFrame, most: int | None = None) -> DataFrame:
    """One chunk for each file(file_path, content, language) that isn't blank, cut at ``most`` bytes."""
    kept = files.where(F.length(F.trim("content")) > 0)
    content = truncate_utf8(F.col("content"), most) if most else F.col("content")
    return kept.select(
        chunk_id(F.lit(""), content, F.col("file_path")).alias("id"), F.lit(None).cast("string").alias("symbol_id"), "file_path", content.alias("content"), "language", F.lit(1).alias("line_start"), F.size(F.split(content, "\n")).alias("line_end"), F.create_map(F.lit("scope"), F.lit("file")).alias("metadata")
    )


def symbol_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks of types and members; files without any become file chunks.

    A type's chunk starts with the file's import lines, a member's with a line
    that names its parent (its full name without the last part).
    """
    f = files.select(F.col("file_path").alias("fpath"), "content", "language")
    s = symbols.where(F.col("kind").isin(*TYPE_KINDS, *MEMBER_KINDS)).join(f, F.col("file_path") == F.col("fpath"))
    body = lines_between(F.col("content"), F.col("line_start"), F.col("line_end"))
    parent = F.regexp_replace("full_name", r"\.?[^.]*$", "")
    text = F.when(F.col("kind").isin(*TYPE_KINDS), F.concat_ws("\n", F.nullif(imports(F.col("content")), F.lit("")), body)).otherwise(with_header(parent, body))
    own = s.select(
        chunk_id(F.col("full_name"), text, F.col("file_path")).alias("id"), F.col("id").alias("symbol_id"), "file_path", text.alias("content"), "language", "line_start", "line_end", F.create_map(F.lit("scope"), F.when(F.col("kind").isin(*TYPE_KINDS), "type").otherwise("member"), F.lit("kind"), F.col("kind")).alias("metadata")
    )
    bare = files.join(own.select(F.col("file_path").alias("fp")).distinct(), F.col("file_path") == F.col("fp"), "left_anti")
    return own.unionByName(file_chunks(bare))
