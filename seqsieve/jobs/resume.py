"""Tables of earlier runs used again where their inputs and options are the same (O-1, S-10, S-11)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import numbered_lines


def digest(spark: SparkSession, path: str) -> str:
    """A digest of a text file's lines in order, made in one pass of its splits."""
    h = F.xxhash64("nth", "value")
    row = numbered_lines(spark, path).agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def resumed(spark: SparkSession, folder: str, name: str, stamp: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, kept in folder under the digest of the stamp (inputs' digests and options), or what a run of the same stamp
    kept there. A manifest is written once the table is whole, so that a run that broke off is not taken for done."""
    text = json.dumps(stamp, sort_keys=True, default=str)
    at = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"
    try:
        if spark.read.text(f"{at}/manifest", wholetext=True).first().value.strip() == text:
            return spark.read.parquet(f"{at}/table")
    except (AnalysisException, AttributeError):  # there is none, or it is empty
        pass
    out = make()
    out.write.mode("overwrite").parquet(f"{at}/table")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return spark.read.schema(out.schema).parquet(f"{at}/table")
