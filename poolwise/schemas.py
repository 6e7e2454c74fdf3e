"""Fixed schemas of the data model. Ids are always strings."""

from pyspark.sql import types as T

# Field names of the published manifest format.
MANIFEST = T.StructType([
    T.StructField("video_id", T.StringType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("ocr", T.StringType(), True),
    T.StructField("visual_materials", T.ArrayType(T.StringType()), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
])

# long-form feature store: one row per (key, position)
FEATURE_STORE = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("vec", T.ArrayType(T.FloatType()), True),
])

POOL_STATE = T.StructType([
    T.StructField("fold", T.IntegerType(), False),
    T.StructField("video_id", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("iteration", T.IntegerType(), False),
])
