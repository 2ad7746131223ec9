"""The data model: ids, markers, kinds and the schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
FIRST_SYMBOL_ID = 100
LAST_MARKER_ID = 99
MARKERS = {
    "LOOP": 1,
    "RECURSIVE_CALL": 2,
    "IF_TRUE": 3,
    "IF_FALSE": 4,
    "BRANCH_END": 5,
    "RETURN": 6,
    "LOOP_BACK": 7,
    "SWITCH_CASE": 8,
    "SWITCH_END": 9,
    "BREAK": 10,
    "CONTINUE": 11,
    "THROW": 12,
}
UNNAMED_MARKER = "MARKER"
KINDS = (
    "function", "method", "class", "interface", "enum", "variable",
    "constant", "parameter", "field", "module", "file", "config",
)
SCOPES = ("global", "object_field", "local", "parameter")
EFFECTS = (
    "none", "sql_query", "sql_write", "cache_read", "cache_write",
    "http_call", "event_emit", "file_read", "file_write", "log",
)

CALLABLE_KINDS = ("function", "method")
CLASS_KINDS = ("class", "interface", "enum")
FIELD_KINDS = ("field", "variable")


ANNOTATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("args", T.MapType(T.StringType(), T.StringType())),
        T.StructField("line", T.IntegerType()),
    ]
)
_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "longs": T.ArrayType(T.LongType()),
    "strings": T.ArrayType(T.StringType()),
    "floats": T.ArrayType(T.FloatType()),
    "annotations": T.ArrayType(ANNOTATION),
}


def _struct(fields: str) -> T.StructType:
    """A schema from `name type` pairs; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in map(str.split, fields.split(", "))])


SYMBOLS = _struct(
    "id long, name string, kind string, scope string, scope_id long, type_ref long, type_name string, file string, "
    "line int, end_line int, signature string, doc string, annotations annotations, language string"
)
CHAINS = _struct("func_id long, chain longs")
CALL_RECORDS = _struct(
    "caller_id long, call_name string, position int, arg_exprs strings, line int, condition string, "
    "is_loop_body boolean, effect string, effect_desc string, target_class string, target_method string"
)
CALL_SITES = _struct(
    "name_key string, caller_id long, call_name string, line int, condition string, is_loop_body boolean, "
    "arg_exprs strings"
)
EDGES = _struct(
    "caller_id long, callee_id long, position int, condition string, effect string, effect_desc string, "
    "arg_ids longs, is_loop_body boolean, is_recursive boolean"
)
FILES = _struct("path string, language string, bytes long, lines int")
EMBEDDINGS = _struct("symbol_id long, vector floats")
META = _struct("version long, next_id long")
STATS = _struct("symbols long, chains long, edges long, files long, next_id long")

#: What a parser gives for each file; ids inside are local to the file.
PARSED_SYMBOLS = T.StructType([T.StructField("path", T.StringType()), *SYMBOLS.fields])
PARSED_CHAINS = _struct("path string, func_id long, chain longs")
PARSED_CALLS = T.StructType([T.StructField("path", T.StringType()), *CALL_RECORDS.fields])
