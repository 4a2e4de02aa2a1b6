"""Recognised boxes from JSON files, one array of boxes per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh.functions.geometry import SIDES, flatten
from casemesh.schemas import BOX


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Numbered box rows; ``doc_id`` is the file, ``page`` the number in its name (``..._p<n>.json``) or 1."""
    files = spark.read.text(path, wholetext=True).withColumn("doc_id", F.input_file_name())
    parsed = files.select("doc_id", F.from_json("value", T.ArrayType(BOX)).alias("boxes"))
    number = F.regexp_extract("doc_id", r"_p(\d+)\.json$", 1)
    rows = parsed.withColumn("page", F.when(number != "", number.cast("int")).otherwise(1)).select(
        "doc_id", "page", F.posexplode("boxes").alias("box_no", "_b")).select("doc_id", "page", "box_no", "_b.*")
    return flatten(rows).select("doc_id", "page", "box_no", "text", "confidence", "lang", *SIDES)
