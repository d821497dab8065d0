"""Delimited text in and out. Fields are plain strings; nothing is quoted or escaped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solekey.functions.combos import column


def _literal(delimiter: str) -> str:
    """The delimiter as a pattern that matches just itself."""
    if not delimiter:
        raise ValueError("the delimiter must not be empty")
    return "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, width: int | None = None
) -> DataFrame:
    """Read lines ending in \\n, \\r or \\r\\n, split on a literal delimiter.

    Every line is a row, blank ones and such of only empty fields too. There are as many columns
    as the longest line has fields; with `width` so many, and a longer line is an error. Columns
    are named c0, c1, ..., or by each file's first line with `header` (fields beyond it c<i>).
    Missing and empty fields are null, which the default null rule treats as one value.
    """
    lines = spark.read.text(path)
    names: list[str] = []
    if header:
        first, lines = _without_first_lines(lines)
        names = first.split(delimiter)
    fields = lines.select(F.split("value", _literal(delimiter), -1).alias("fields"))
    if width is None:
        width = max(len(names), fields.agg(F.max(F.size("fields"))).first()[0] or 0)
    elif longer := fields.where(F.size("fields") > width).count():
        raise ValueError(f"{longer} lines have more than {width} fields")
    names = [*names, *(f"c{i}" for i in range(len(names), width))][:width]
    values = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]
    return fields.select(*values)


def _without_first_lines(lines: DataFrame) -> tuple[str, DataFrame]:
    """The first line of a file, and all lines but the first of each file."""
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    heads = placed.where("start = 0").groupBy("file").agg(F.min_by("value", "id").alias("head"), F.min("id").alias("id"))
    found = heads.orderBy("file").first()
    rest = placed.join(heads.select("file", "id"), ["file", "id"], "left_anti").select("value")
    return (found.head if found else ""), rest


def read_integers(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """Read any number of integers per line into one column `value`; empty tokens are skipped."""
    tokens = spark.read.text(path).select(F.explode(F.split("value", _literal(delimiter))).alias("token"))
    return tokens.where(F.trim("token") != "").select(F.trim("token").cast("int").alias("value"))


def write_delimited(df: DataFrame, path: str, delimiter: str = "\t") -> None:
    """Write one line per row, fields joined by the delimiter, in a directory of part files.

    Null is written as an empty field. Values that would not come back as they are raise an
    error before anything is written: empty strings, and values with the delimiter or a line end.
    """
    values = [column(c).cast("string") for c in df.columns]
    broken = F.lit(False)
    for value in values:
        broken = broken | F.coalesce((value == "") | F.contains(value, F.lit(delimiter)) | value.rlike("[\\r\\n]"), F.lit(False))
    if rows := df.where(broken).count():
        raise ValueError(f"{rows} rows hold an empty string, a line end or the delimiter {delimiter!r}")
    _literal(delimiter)
    df.select(F.concat_ws(delimiter, *[F.coalesce(v, F.lit("")) for v in values]).alias("value")).write.text(path)
