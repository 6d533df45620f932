"""The three logical tables and their description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


S, I = T.StringType(), T.IntegerType()

SYMBOLS = _struct(("id", S, False), ("name", S, False), ("kind", S, False), ("file_path", S, False), ("line_start", I, False), ("line_end", I, False), ("full_name", S, False), ("modifiers", S, True), ("documentation", S, True))
RELATIONSHIPS = _struct(("id", S, False), ("source_symbol_id", S, False), ("target_symbol_id", S, False), ("relationship_type", S, False))
CHUNKS = _struct(("id", S, False), ("symbol_id", S, True), ("file_path", S, False), ("content", S, False), ("language", S, False), ("line_start", I, False), ("line_end", I, False), ("metadata", T.MapType(S, S), True), ("embedding", T.ArrayType(T.FloatType(), True), True))

#: What SQL users type -> table -> column. Spark resolves names without regard to case.
LOGICAL = {
    "SymbolRecord": ("symbols", {"Id": "id", "Name": "name", "Kind": "kind", "FilePath": "file_path", "LineStart": "line_start", "LineEnd": "line_end", "FullName": "full_name", "Modifiers": "modifiers", "Documentation": "documentation"}),
    "RelationshipRecord": ("relationships", {"Id": "id", "SourceSymbolId": "source_symbol_id", "TargetSymbolId": "target_symbol_id", "RelationshipType": "relationship_type"}),
    "ChunkRecord": ("chunks", {"Id": "id", "SymbolId": "symbol_id", "FilePath": "file_path", "Content": "content", "Language": "language", "LineStart": "line_start", "LineEnd": "line_end", "MetadataJson": "metadata"}),
}
SCHEMAS = {"symbols": SYMBOLS, "relationships": RELATIONSHIPS, "chunks": CHUNKS}
KEYS = {"symbols": "id", "relationships": "id", "chunks": "id"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What SQL can name: every table, and the logical ones in both spellings (symbols and SymbolRecord, with the latter's column names)."""
    found = dict(tables)
    for logical, (name, columns) in LOGICAL.items():
        if name in tables:
            have = {c.lower() for c in tables[name].columns}
            found[logical] = tables[name].selectExpr(*[f"{'to_json(metadata)' if v == 'metadata' else v} AS {k}" for k, v in columns.items() if v in have])
    return found


def describe() -> str:
    """The tables as text: a line for each column with type, nullability and role."""
    lines = []
    for logical, (name, columns) in LOGICAL.items():
        lines.append(f"{logical} ({name})")
        for shown, column in columns.items():
            f = SCHEMAS[name][column]
            marks = [f.dataType.simpleString()] + (["nullable"] if f.nullable else []) + (["key"] if column == KEYS[name] else [])
            lines.append(f"  {shown}: {', '.join(marks)}")
        if name == "chunks":
            lines.append("  Similarity: double, virtual; ORDER BY Similarity ranks by the text in Content LIKE '%...%'")
    return "\n".join(lines)
