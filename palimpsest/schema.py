"""The schemas of the data model; never inferred."""

from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: A row of the mutation log. value NULL: tombstone (an empty value is a value); expiry_ms 0: never.
MUTATION = StructType(
    [
        StructField("seq", LongType(), False),  # commit order, unique
        StructField("key", BinaryType(), False),
        StructField("value", BinaryType()),
        StructField("expiry_ms", LongType(), False),
    ]
)

#: A parsed command line; error is set where the line is none.
COMMAND = StructType(
    [
        StructField("verb", StringType()),
        StructField("key", StringType()),
        StructField("value", StringType()),
        StructField("ttl_s", LongType()),
        StructField("error", StringType()),
    ]
)
