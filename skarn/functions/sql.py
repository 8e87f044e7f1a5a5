"""The functions under SQL names: temporary SQL functions, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "gamma(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "coalesce(aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> least(abs(x), abs(y))), 0D, (s, x) -> s + x)"
        " / nullif(aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> greatest(abs(x), abs(y))), 0D, (s, x) -> s + x), 0D), 0D)"
    ),
    "tokens(text STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1)",
    "content_hash(text STRING) RETURNS STRING": "md5(cast(text AS BINARY))",
    "su_dimensions(d INT) RETURNS INT": "d * d - 1",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
