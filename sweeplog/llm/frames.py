"""Small helpers for frames of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, so that no other column can clash with what an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Rows of texts go to Python in batches of about `size`, from now on in this session, instead of 10,000 rows or 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def sampled(rows: DataFrame, key: Column, wanted: int, total: int, seed: int = 17) -> DataFrame:
    """About `wanted` of `total` rows, chosen by a hash of the key: the same rows on every run, whatever the partitions."""
    if total <= wanted:
        return rows
    return rows.where(F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * wanted / total))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names that docs has not, however they are spelled."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
