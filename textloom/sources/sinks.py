"""Sinks and stored forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import numbered

from .readers import LABELS


def passage_id(doc: Column, page: Column, split: Column) -> Column:
    """doc##page[##split]; a missing or negative split is left out."""
    return F.concat_ws("##", doc, page.cast("string"), F.when(split >= 0, split.cast("string")))


def stored(passages: DataFrame) -> DataFrame:
    """Typed passages as the stored nested form: lists become joined strings, lists of lists are flattened first."""

    def joined(c: str, sep: str) -> Column:
        nested = passages.schema[c].dataType.simpleString().startswith("array<array")
        return F.array_join(F.flatten(c) if nested else F.col(c), sep).alias(c)

    meta = F.struct("text", "doc_title", F.col("split_size").cast("int").alias("split_size"), F.col("split_id").cast("int").alias("split_id"), F.lit("").alias("source_filepath"), F.lit("").alias("output_filepath"), joined("sentences", "###"), *(joined(c, ", ") for c in LABELS))
    return passages.select("content", F.lit("text").alias("content_type"), passage_id(F.col("doc"), F.col("page_nr"), F.col("split_id")).alias("id"), meta.alias("meta"))


def flat(nested: DataFrame) -> DataFrame:
    """Stored passages with the meta fields beside content and id."""
    return nested.select("content", "id", "meta.*")


def write_jsonl(passages: DataFrame, path: str) -> None:
    stored(passages).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False) -> None:
    """Parquet, partitioned; without overwrite an existing table raises."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_vectors(vectors: DataFrame, path: str, overwrite: bool = False) -> None:
    """vectors(field, id, vec) in a folder of each field, so that a search reads its own field alone."""
    write_table(vectors.select("field", "id", "vec"), path, ["field"], overwrite)


def complete(chunks: int, done: DataFrame, part: str = "chunk") -> bool:
    """Whether as many parts are written as there are chunks."""
    return done.select(part).distinct().count() == chunks


def cached(df: DataFrame, path: str) -> DataFrame:
    """df as it was written to path, written now if nothing is there yet."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_table(df, path, overwrite=True)
    return spark.read.schema(df.schema).parquet(path)


def missing(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't done yet: how interrupted work is resumed."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, duplicates: str = "overwrite") -> DataFrame:
    """old and new rows by key: overwrite takes the new one, skip keeps the old one."""
    if duplicates == "overwrite":
        return missing(old, new, [key]).unionByName(new)
    if duplicates == "skip":
        return old.unionByName(missing(new, old, [key]))
    raise ValueError(duplicates)


def _told(key: Column, seed: int) -> Column:
    """A hash of seed and key that other engines have, too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def split_sets(docs: DataFrame, key: str, train: int = 120, val: int = 40, seed: int = 14) -> DataFrame:
    """docs with `part`: by a seeded hash order, the first rows train, the next ones val, the rest test.

    Null keys are told alike and stand together, by nothing but the row numbers.
    """
    x = numbered(docs.withColumn("__h", _told(F.col(key), seed)), ["__h", key], "__n")
    return x.withColumn("part", F.when(F.col("__n") < train, "train").when(F.col("__n") < train + val, "val").otherwise("test")).drop("__n", "__h")


def write_results(ranked: DataFrame, path: str, k: int = 3) -> None:
    """The best k rows of each query as CSV for judging."""
    ranked.filter(F.col("rank") <= k).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_samples(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One text file per sample, in a folder by its key."""
    rows.select(F.col(key), F.col(text).cast("string").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def sample(rows: DataFrame, key: str, n: int, seed: int = 14) -> DataFrame:
    """n rows drawn with replacement, reproducibly: draw i takes the row whose number in hash order is a hash of i.

    A sampling operator.  Null keys are told alike; an empty table gives no rows.
    """
    total = rows.count()
    if not total:
        return rows
    draws = rows.sparkSession.range(n).select(F.pmod(F.conv(F.substring(_told(F.col("id"), seed), 1, 15), 16, 10).cast("long"), F.lit(total)).alias("__n"))
    x = numbered(rows.withColumn("__r", _told(F.col(key), seed)), ["__r", key], "__n")
    return draws.join(x, "__n").drop("__n", "__r")
