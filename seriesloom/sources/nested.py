"""Nested results as JSON text, and back with a check of what came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def to_payload(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Key and whole row as JSON text; NULL fields are written, so every field of the schema is named."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias(payload))


def from_payload(rows: DataFrame, schema: T.StructType, payload: str = "payload", required: Sequence[str] = ()) -> DataFrame:
    """Columns of ``schema`` read from JSON text, next to the other columns of ``rows``.

    Adds ``status`` and ``problem``:

    * ``corrupt``: no JSON object, or a field of another type; ``problem`` holds the text, all fields are NULL;
    * ``incomplete``: fields of ``required`` (dotted for nested structs) are absent or NULL; ``problem`` names them;
    * ``missing``: the text is NULL or blank;
    * ``ok``.
    """
    clash = {f.name for f in schema} & (set(rows.columns) - {payload} | {"status", "problem"})
    if clash:
        raise ValueError(f"Columns are there already: {', '.join(sorted(clash))}")
    shape = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # numbers beyond a double and bare NaN are refused with the rest
    read = F.from_json(F.col(payload), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "false"})
    rest = [c for c in rows.columns if c != payload]
    blank = F.coalesce(F.length(F.trim(F.col(payload))) == 0, F.lit(True))
    out = rows.select(*rest, blank.alias("_blank"), F.col(payload).alias("_text"), read.alias("_r"))
    # arrays and bare values leave no corrupt text but no object either
    broken = F.col(f"_r.{CORRUPT}").isNotNull() | ~F.ltrim(F.col("_text")).startswith("{")
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_r.{name}").isNull(), F.lit(name)) for name in required])) if required else F.array().cast("array<string>")
    status = F.when(F.col("_blank"), "missing").when(broken, "corrupt").when(F.size(lacking) > 0, "incomplete").otherwise("ok")
    problem = F.when(status == "corrupt", F.col("_text")).when(status == "incomplete", F.array_join(lacking, ","))
    fields = [F.when(~F.col("_blank") & ~broken, F.col("_r").getField(f.name)).alias(f.name) for f in schema]
    return out.select(*rest, *fields, status.alias("status"), problem.alias("problem"))
