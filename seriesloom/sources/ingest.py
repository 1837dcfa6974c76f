"""Upload ingestion: one reader per format, gates on the manifest, column detection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.panel import select_panel, to_stamp
from seriesloom.sources.dates import date_vote, with_dates
from seriesloom.sources.workbook import sheet_rows

# Accepted extensions, size limit, signature and date words.
EXTENSIONS = ("csv", "xlsx", "json")
MAX_BYTES = 100 * 1024 * 1024
XLSX_MAGIC = "504B0304"
DATE_WORDS = ("date", "time", "month", "year", "day", "period", "ds", "timestamp")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and inferred types; Spark splits large files, so no chunk loop exists."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records array, single record, or one object of equally long columns."""
    df = spark.read.json(path, multiLine=True)
    if not df.columns:
        raise ValueError("JSON input is empty.")
    if all(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields):
        return columns_to_rows(df)
    return df


def columns_to_rows(df: DataFrame) -> DataFrame:
    """Turn column-oriented arrays into rows; unequal lengths are an error."""
    sizes = [F.size(c) for c in df.columns]
    equal = sizes[0] == sizes[0]
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    checked = df.withColumn("_ok", F.when(~equal, F.raise_error(F.lit("JSON columns differ in length."))))
    return checked.filter(F.col("_ok").isNull()).select(F.inline(F.arrays_zip(*df.columns)))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Workbooks as long cells ``path, row, column, text``; files are read in parallel.

    A workbook is at most the upload limit, so one file per task is bounded.
    The first tab is read unless ``sheet`` names another; dates come as ISO text.
    The first row names the columns; cells beyond it are named by position. An
    empty or oversized file fails the read and is named.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    refused = F.raise_error(F.concat(F.lit("Workbook is empty or over the size limit: "), "path"))
    gated = files.select("path", F.when(F.col("length").between(1, MAX_BYTES), F.col("content")).otherwise(refused).alias("content"))

    def cells(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(content, sheet)
                head = rows[0] if rows else []
                width = max(map(len, rows), default=0)
                head = [*head, *(f"column_{k + 1}" for k in range(len(head), width))]
                for i, row in enumerate(rows[1:]):
                    for name, text in zip(head, row + [None] * (len(head) - len(row))):
                        out.append((p, i, name, text))
            yield pd.DataFrame(out, columns=["path", "row", "column", "text"])

    return gated.mapInPandas(cells, "path string, row int, column string, text string")


def xlsx_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Wide table of the named columns."""
    return cells.groupBy("path", "row").pivot("column", columns).agg(F.first("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File path, size and extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", "length", ext.alias("extension"))


def accept_files(files: DataFrame) -> DataFrame:
    """Gate by extension and size, with the reason of each refusal."""
    reason = (F.when(~F.col("extension").isin(*EXTENSIONS), "unsupported_type").when(F.col("length") == 0, "empty_file")
              .when(F.col("length") > MAX_BYTES, "too_large"))
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def signature_flags(files: DataFrame, content: str = "content") -> DataFrame:
    """Workbook signature and UTF-8 validity of the first bytes."""
    head = F.substring(F.col(content), 1, 4)
    # the sample may end inside a character, so up to three bytes less are tried too
    cuts = [F.is_valid_utf8(F.substring(F.col(content), 1, 4096 - k).cast("string")) for k in range(4)]
    return files.withColumns({"is_zip": F.hex(head) == XLSX_MAGIC, "is_utf8": cuts[0] | cuts[1] | cuts[2] | cuts[3]})


def detect_date_column(df: DataFrame) -> str | None:
    """First column named like a date that parses, else a text column that mostly parses.

    All candidates are tested in one aggregate; only those ratios reach the driver.
    """
    named = [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    typed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    for c in named:
        if c in typed:
            return c
    tested = list(dict.fromkeys([c for c in named if c in texts] + texts))
    if not tested:
        return typed[0] if typed else None
    ratios = df.agg(*[F.avg((to_stamp(df, c).isNotNull() | F.col(c).isNull()).cast("double")).alias(f"r{i}") for i, c in enumerate(tested)],
                    *[F.avg(to_stamp(df, c).isNotNull().cast("double")).alias(f"p{i}") for i, c in enumerate(tested)]).first()
    for i, c in enumerate(tested):
        if c in named and ratios[f"r{i}"] == 1.0:
            return c
    for i, c in enumerate(tested):
        if (ratios[f"p{i}"] or 0) > 0.8:
            return c
    return typed[0] if typed else None


def detect_date_texts(df: DataFrame) -> str | None:
    """The text column of which the largest share (over 0.8) reads as dates of one form; a name with a date word settles ties."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    best = (0.8, False, None)
    for c in names:
        vote = date_vote(df, c).first()
        share = vote["parsed"] / vote["filled"] if vote["filled"] else 0.0
        mine = (share, any(w in c.lower() for w in DATE_WORDS), c)
        best = mine if mine[:2] > best[:2] else best
    return best[2]


def detect_value_column(df: DataFrame, exclude: str | None) -> str | None:
    """First numeric column other than the date; schema only."""
    for f in df.schema.fields:
        if f.name != exclude and isinstance(f.dataType, T.NumericType):
            return f.name
    return None


def finalise(df: DataFrame, date_col: str | None = None, value_col: str | None = None, series: Column | None = None, forms: bool = False, strict: bool = False) -> DataFrame:
    """Detected or chosen columns as a canonical panel.

    With ``forms`` date texts are read in the form that most of them have; others
    leave the panel, or end the job with their number if ``strict``.
    """
    date_col = date_col or detect_date_column(df) or (detect_date_texts(df) if forms else None)
    value_col = value_col or detect_value_column(df, date_col)
    if date_col is None or value_col is None:
        raise ValueError("No usable date or value column was found.")
    if forms and isinstance(df.schema[date_col].dataType, T.StringType):
        df = with_dates(df, date_col, date_vote(df, date_col), to=date_col, strict=strict)
    return select_panel(df, date_col, value_col, series)


def store_panel(panel: DataFrame, path: str, partition: str | None = None) -> None:
    """Columnar store. Partition by a low-cardinality column only (for example the file id)."""
    writer = panel.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def load_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Pruned scan of the named columns."""
    return spark.read.parquet(path).select(*columns)


def as_json_rows(df: DataFrame, key: str) -> DataFrame:
    """Whole rows as JSON text next to their key: the result sink format."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("payload"))
