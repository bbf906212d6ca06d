"""Lists of URLs: bodies of requests, uploaded files, target positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that head a column of URLs.
HEADERS, CELL_HEADERS = ["url", "сайт", "site", "website"], ["url", "сайт", "site", "website", "домен"]


def task_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Trimmed URLs that are not blank; no scheme is added here."""
    return spark.createDataFrame([(u,) for u in urls], "url string").select(F.trim("url").alias("url")).where("url <> ''")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """URLs of an uploaded file, line by line.

    Of a line with commas, the first part with a dot that is no header word. Of others, all but blank lines, comments
    and header words. ``https://`` goes before what does not begin with ``http``.
    """
    line = F.ltrim(F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit("﻿"))
    cells = F.transform(F.split(line, ","), lambda c: F.trim(c))
    first = F.get(F.filter(cells, lambda c: c.contains(".") & ~F.lower(c).isin(CELL_HEADERS)), F.lit(0))
    plain = F.when((line != "") & ~line.startswith("#") & ~F.lower(line).isin(HEADERS), line)
    url = F.when(line.contains(","), first).otherwise(plain)
    return lines.select(url.alias("url")).where("url is not null").select(F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url")).alias("url"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def target_positions(field: Column) -> Column:
    """A form field with a JSON array, or else a list with commas, as an array."""
    listed = F.filter(F.transform(F.split(field, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.from_json(field, "array<string>", {"mode": "PERMISSIVE"}), listed)
