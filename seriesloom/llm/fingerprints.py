"""Document fingerprints: the k least hashes of a text's word shingles.

Everything is DataFrame functions. A fingerprint is an ascending array of
distinct longs. The fingerprint of a whole is the merge of the fingerprints of
its parts (for shingles that lie inside a part). A set with fewer than k
shingles is held whole, and its estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.tables import bounds, bucket, partitions

K = 128
SIZE = 5
_BLANKS = " \\t\\n\\u000b\\f\\r"


def add_fingerprint(df: DataFrame, text: str, name: str, k: int = K, size: int = SIZE) -> DataFrame:
    """``df`` with the fingerprint of column ``text``; null and blank texts have an empty one.

    Words are split at ASCII white space in lower case. A text with fewer words
    than a shingle is one shingle.
    """
    words, n = F.col("_words"), F.size("_words")
    trimmed = F.expr(f"trim(BOTH '{_BLANKS}' FROM lower(coalesce(`{text}`, '')))")
    # each step is a projection of its own, so that no array is computed once per use
    out = df.withColumn("_words", F.when(F.length(trimmed) > 0, F.transform(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    shingles = F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(size))))).when(
        n > 0, F.array(F.xxhash64(words, F.lit("short")))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sets."""
    least = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.size(least))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second; null for an empty first set."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Fixed-width lower-case hex of a fingerprint."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merged(parts: DataFrame, key: str, fingerprint: str, k: int = K) -> DataFrame:
    """(key, fingerprint) of the union of many parts, without gathering the parts of a key.

    The k least of all parts are kept by rank inside tasks before the shuffle.
    """
    rows = parts.select(key, F.explode(fingerprint).alias("h")).distinct()
    rank = F.row_number().over(W.partitionBy(key).orderBy("h"))
    least = rows.withColumn("r", rank).filter(F.col("r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(fingerprint))


def with_next(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc_id, text, fp and the text and fp of the next row by descending doc_id (the first after the last).

    Rows are dealt into ranges of doc_id; the first row of a range is also
    sent to the range before it, so no task holds more than a range. Rows that
    repeat a doc_id follow each other in order of their texts; null doc_ids come last.
    """
    parts = partitions(docs)
    cuts = bounds(docs, "doc_id", 4 * parts)
    top = docs.agg(F.max("doc_id").alias("m")).first()["m"]
    own = bucket("doc_id", cuts)
    place = F.array(F.struct(own.cast("int").alias("bucket"), F.lit(0).alias("ghost")))
    if cuts:
        # only the largest rows of a range are cut values
        place = F.when(F.col("doc_id").isin(cuts), F.concat(place, F.array(F.struct((own + 1).cast("int").alias("bucket"), F.lit(1).alias("ghost"))))).otherwise(place)
    place = F.when(F.col("doc_id").eqNullSafe(F.lit(top)), F.concat(place, F.array(F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("ghost"))))).otherwise(place)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(place).alias("p")).select("doc_id", "text", "p.bucket", "p.ghost").repartition(parts, "bucket")
    rows = add_fingerprint(rows, "text", "fp", k, size)
    w = W.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    return rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).filter("ghost = 0").drop("bucket", "ghost")


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last third replaced by the beginning of the next
    document. Null texts are empty; other columns are ignored. Returns doc_id,
    n_chars, edited, fp, edited_fp, near_edited, near_next, contained (of the text
    in the edited one) and distinct_shingles (estimates).
    """
    rows = with_next(docs, size, k).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third)))
    rows = add_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fp", k, size)
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return rows.select("doc_id", "n_chars", "edited", "fp", "edited_fp", resemblance(fp, edited, k).alias("near_edited"), resemblance(fp, after, k).alias("near_next"),
                       containment(fp, edited, k).alias("contained"), distinct_count(fp, k).alias("distinct_shingles"))
