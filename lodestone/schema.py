"""Row types: the metadata record of a file, and the rows of the metric and finding relations."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
STRINGS = T.ArrayType(S)


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """A schema with one more field; ``add`` would change the one that is given."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])


#: One shape for the functions of all languages; a language leaves what it lacks null.
FUNCTION = row(
    name=S, args=STRINGS, decorators=STRINGS, docstring=S, is_async=B, is_generator=B, line_number=I, complexity=I,
    return_type=S, receiver=S, is_exported=B, flags=STRINGS,
)
#: One shape for classes, interfaces, structs, enums and traits.
CLASS = row(
    name=S, type=S, bases=STRINGS, implements=STRINGS, decorators=STRINGS, docstring=S, methods=T.ArrayType(row(name=S, is_async=B, is_property=B)),
    attributes=T.ArrayType(row(name=S, type=S)), line_number=I, is_exported=B, flags=STRINGS,
)
FILE = row(
    path=S, size=L, language=S, last_modified=T.TimestampType(), content_hash=S, imports=STRINGS, exports=STRINGS,
    functions=T.ArrayType(FUNCTION), classes=T.ArrayType(CLASS), dependencies=STRINGS, complexity=D, token_count=L,
    relative_path=S, module_path=S, file_type=S, external_dependencies=STRINGS, internal_dependencies=STRINGS,
    encoding=S, features=T.MapType(S, S), parse_error=S,
)
CACHE = row(path=S, content_hash=S, cached_at=T.TimestampType(), size=L)
METRIC = row(metric=S, ts=T.TimestampType(), value=D, metadata=T.MapType(S, S))
