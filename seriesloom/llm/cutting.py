"""Cut byte spans out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.arrays import released, slices
from seriesloom.llm.tables import bounded_batches


def text_key() -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


#: Columns that cutting adds; columns of ``docs`` with these names are replaced.
ADDED = ("kept", "spans", "n_bytes", "n_removed", "n_spans", "_id", "_tk", "_k")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the array ``spans`` of its rows (start, stop) in ``spans`` (doc_id, tk, start, stop)."""
    grouped = spans.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.withColumn("_k", text_key()).join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_tk")), "left").drop("_id", "_tk", "_k")


def cut(docs: DataFrame, least: int = 1) -> DataFrame:
    """Replace text by what the merged ``spans`` leave of it, and describe the cut.

    Adds kept (bytes), n_bytes, n_removed and n_spans. Merged spans shorter than
    ``least`` bytes stay in the text, unless they cover it. Null texts stay null with zero counts.
    """
    rest = [c for c in docs.columns if c not in ("text", "spans")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            rows = texts.rows
            column = rows.column(rows.schema.get_field_index("spans"))
            kept, removed, count = [], [], []
            for i in range(len(texts)):
                body, found = texts.data[texts.offsets[i] : texts.offsets[i + 1]], column[i].values
                if found is None or not len(found):
                    kept.append(None if texts.null[i] else body.tobytes())
                    removed.append(0)
                    count.append(0)
                    continue
                start, stop = (np.asarray(found.field(k), np.int64) for k in (0, 1))
                step = np.bincount(start, minlength=len(body) + 1) - np.bincount(stop, minlength=len(body) + 1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                first, last = edge[::2], edge[1::2]
                stays = (last - first < least) & (last - first < len(body))
                for a, b in zip(first[stays], last[stays], strict=True):
                    gone[a:b] = False
                first, last = first[~stays], last[~stays]
                kept.append(body[~gone].tobytes())
                removed.append(int((last - first).sum()))
                count.append(len(first))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in rest), pa.array(kept, pa.binary()), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                names=[*rest, "kept", "n_bytes", "n_removed", "n_spans"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return bounded_batches(docs.select(*rest, "text", "spans")).mapInArrow(released(work), f"{fields}kept binary, n_bytes long, n_removed long, n_spans long")
