"""Field registry: names, types, analyzers and weights of a document, with suffix-typed dynamic fields."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

from docsieve.errors import SearchError


class Field(NamedTuple):
    name: str
    kind: str  # string, boolean, int, float, long, double, date, general, ocr, code
    indexed: bool = True
    many: bool = False

    @property
    def text(self) -> bool:
        return self.kind in ("general", "ocr", "code")

    @property
    def type(self) -> T.DataType:
        return T.ArrayType(KINDS[self.kind]) if self.many else KINDS[self.kind]


KINDS = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "float": T.FloatType(), "long": T.LongType(),
    "double": T.DoubleType(), "date": T.TimestampNTZType(), "general": T.StringType(), "ocr": T.StringType(), "code": T.StringType(),
}

# Field names, dynamic suffixes, query weights, facets, highlighted fields and limits.
FIELDS = {
    f.name: f
    for f in (
        Field("_version_", "long", indexed=False), Field("id", "string"), Field("title", "general", many=True), Field("content", "general", many=True),
        Field("image_orc_text", "ocr"), Field("source_code_content", "code"), Field("language", "string"), Field("file_type", "string"),
        Field("file_path", "string"), Field("author", "string"), Field("repository", "string"), Field("last_modified", "date"),
        Field("url", "string", indexed=False), Field("repository_path", "string", indexed=False), Field("tags", "string", many=True),
    )
}
SUFFIXES = {"_i": ("int", False), "_s": ("string", False), "_l": ("long", False), "_t": ("general", True), "_b": ("boolean", False), "_f": ("float", False), "_d": ("double", False), "_dt": ("date", False)}
WEIGHTS = {"title": 5.0, "source_code_content": 1.5, "content": 1.0, "image_orc_text": 0.6, "author": 2.0, "file_path": 1.0}
DISMAX_WEIGHTS = {"title": 5.0, "content": 1.0, "author": 2.0, "file_path": 1.0}
FACETS = ("repository", "file_type")
FACET_LIMIT, GROUP_LIMIT, SNIPPETS, SNIPPET_CHARS, MAX_ROWS, MAX_CLAUSES = 20, 10, 3, 150, 100, 1024
HIGHLIGHTED = ("title", "content", "source_code_content", "image_orc_text")


def field(name: str) -> Field:
    """The field of this name, by the longest dynamic suffix where it is not a fixed one."""
    if name in FIELDS:
        return FIELDS[name]
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        if name.endswith(suffix) and len(name) > len(suffix):
            kind, many = SUFFIXES[suffix]
            return Field(name, kind, many=many)
    raise SearchError(f"undefined field {name}")


def struct(*dynamic: str) -> T.StructType:
    """The schema documents are read with; never inferred."""
    return T.StructType([T.StructField(f.name, f.type, f.name != "id") for f in [*FIELDS.values(), *map(field, dynamic)]])
