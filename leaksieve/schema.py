"""Column layout of the two central tables."""

from pyspark.sql import types as T

# One row per text to scan.
UNIT_COLUMNS = ("unit_id", "uri", "context", "text")

# One row per match, before masking.
RAW_FINDING_COLUMNS = ("uri", "type", "value", "start", "end", "context", "unit_id", "rule_id")

FINDINGS = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("context", T.StringType()),
    T.StructField("unit_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("value_masked", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
])
