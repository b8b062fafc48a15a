"""Text functions: lines and link targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends as Python's str.splitlines knows them.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    lines = F.split(text, LINE_ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def numbered(files: DataFrame) -> DataFrame:
    """source, line (from 1), text of files (path, content)."""
    return files.select(F.col("path").alias("source"), F.posexplode(split_lines(F.col("content"))).alias("i", "text")).select("source", (F.col("i") + 1).alias("line"), "text")


def url_parts(target: Column) -> list[Column]:
    """path, query and fragment of a target without scheme; '' where there is none."""
    return [
        F.regexp_replace(target, "[?#].*$", "").alias("path"),
        F.regexp_extract(target, "[?]([^#]*)", 1).alias("query"),
        F.regexp_extract(target, "#(.*)$", 1).alias("fragment"),
    ]
