"""Schemas of the tables, with field orders in which structs compare."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
FRAGMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType()), T.StructField("span", SPAN)])
LOCATION = T.StructType([T.StructField("path", T.StringType()), T.StructField("span", SPAN), T.StructField("fragment_id", T.StringType())])
EVIDENCE = T.StructType(
    [T.StructField("strict_equal", T.BooleanType()), T.StructField("renamed_equal", T.BooleanType()), T.StructField("shared_fingerprints", T.LongType())]
    + [T.StructField("fingerprint_jaccard", T.IntegerType()), T.StructField("fingerprint_containment", T.IntegerType())]
    + [T.StructField("edit_distance", T.LongType()), T.StructField("compared_tokens", T.LongType())]
)
PAIR = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("similarity", T.IntegerType()), T.StructField("left", LOCATION), T.StructField("right", LOCATION), T.StructField("evidence", EVIDENCE)])
ORACLE = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(f"{side}_{name}", kind) for side in ("left", "right") for name, kind in (("path", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()))]
    + [T.StructField("expected", T.BooleanType()), T.StructField("kind", T.StringType())]
)
