"""Row shapes."""

from pyspark.sql import types as T

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
ISSUE = T.StructType([T.StructField("code", T.StringType()), T.StructField("description", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("severity", T.StringType())])
ISSUES = T.ArrayType(ISSUE)
MEMBER = T.StructType([T.StructField("name", T.StringType()), T.StructField("stored_name", T.StringType())])
MEMBERS = T.ArrayType(MEMBER)
#: What one pass over a file's content gives; ``body`` is the content of small files.
FACTS = T.StructType([
    *(FILE[c] for c in ("path", "length", "error")), T.StructField("sha256", T.StringType()), T.StructField("head", T.BinaryType()), T.StructField("tail", T.BinaryType()),
    T.StructField("hits", T.ArrayType(T.StringType())), T.StructField("body", T.BinaryType()), T.StructField("members", MEMBERS),
])
RESULT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("size", T.LongType()), T.StructField("magic_type", T.StringType()), T.StructField("issues", ISSUES),
    T.StructField("score", T.IntegerType()), T.StructField("severity", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
])
#: ``reasons`` may be missing in older reports; a given schema reads it as null.
REPORT = T.StructType([T.StructField("generated_at", T.StringType()), T.StructField("files", T.ArrayType(RESULT))])
