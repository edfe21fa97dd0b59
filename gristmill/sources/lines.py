"""Text files as (path, line_no, line), read by splits."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ordered import dense_index


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with a total order inside each file: (``block_start``, ``row_id``).

    A file is read by as many tasks as it has splits.  Inside one split the generated row id only
    grows, so the pair orders the whole file; the absolute id carries no meaning.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line); line numbers start at 1.

    Only the line count of each split is scanned over a file.
    """
    lines = dense_index(
        read_lines(spark, path), ["path"], ["row_id"], F.col("block_start"), "line_no"
    )
    return lines.select("path", (F.col("line_no") + 1).alias("line_no"), "line")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add parsed columns that are evaluated once per row.

    A plain projection would be repeated inside every filter the optimizer pushes below it; a
    generator of one row stays where it is.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def capture_of(path: Column, roots: str | list[str]) -> Column:
    """Capture id of a file: its path below the folder that was read, so no two files share one.

    Several folders count from the folder above them all.  A file that was named itself goes by its base
    name, one found by a pattern by its whole path.
    """
    named = [roots] if isinstance(roots, str) else list(roots)
    above = posixpath.commonpath(["/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", root).strip("/") for root in named])
    folder = above.rstrip("/") + "/"
    return (
        F.when(path.endswith(above), F.substring_index(path, "/", -1))
        .when(path.contains(folder), F.substring(path, F.locate(folder, path) + len(folder), F.length(path)))
        .otherwise(path)
    )


def invalid_byte_count(line: Column) -> Column:
    """Bytes of ``line`` that are not valid UTF-8."""
    mark = F.lit("�")
    valid = F.make_valid_utf8(line)
    marks_before = F.octet_length(line) - F.octet_length(F.replace(line, mark, F.lit("")))
    marks_after = F.octet_length(valid) - F.octet_length(F.replace(valid, mark, F.lit("")))
    return F.when(F.is_valid_utf8(line), F.lit(0)).otherwise(
        F.octet_length(line) - F.octet_length(valid) + (marks_after - marks_before)
    )


def clean_text(line: Column) -> Column:
    """``line`` with invalid UTF-8 made visible as U+FFFD."""
    return F.make_valid_utf8(line)
