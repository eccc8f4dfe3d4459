"""Helpers shared by the training-data operators: tables, scratch tables and SQL text snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import staged

__all__ = ["FEW_ROWS", "LOWER", "SPACES", "UPPER", "WORD", "ascii_lower", "join_by_key", "labelled_sample", "mod_crc32", "n_words", "staged", "table", "text_of", "word_array"]

#: White space as the contracts define it: space and the five ASCII controls from tab to return.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str | Column) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. translate() is slow, so it is kept for texts where lower() might touch more."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_array(text: Column, gap: str) -> Column:
    """The words between matches of the regex gap, empty strings removed."""
    return F.array_remove(F.split(text, gap), "")


def mod_crc32(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: how the contracts hold rows out."""
    return F.crc32(doc_id.cast("string")) % n


#: Rows of one key that a task takes along with others in any case.
FEW_ROWS = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a table of one row a key, whose column n (dropped) tells how many rows have the key.

    A key with more rows than an average task is hot. There are fewer such keys than shuffle partitions, so their rows of the table
    are broadcast and rows with them stay where they are; only the others are shuffled.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum("n")).first()[0] or 0
    bound = max(total // parts, FEW_ROWS)
    hot = table.where(F.col("n") > bound).drop("n")
    cold = table.where(F.col("n") <= bound).drop("n")
    if hot.isEmpty():
        return rows.join(cold, key)
    named = F.broadcast(hot.select(key))
    return rows.join(named, key, "left_anti").join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int) -> DataFrame:
    """(id, y, text) of at most about max_docs labelled documents, staged: of the labelled ids that docs hold, those of the least hashes.

    Several labels of an id are averaged. Rows that repeat an id and a text are one document; where ids repeat with so many
    different texts that there are more than max_docs rows, those of the least row hashes stay.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    there = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid")).distinct()
    sample = F.broadcast(marked.join(there, "lid", "left_semi").orderBy(F.xxhash64("lid"), "lid").limit(max_docs))
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col).cast("string")).alias("text")).join(sample, F.col("id") == F.col("lid"))
    rows = rows.select(F.col("lid").cast("string").alias("id"), "y", "text", F.xxhash64("lid", "text").alias("h")).dropDuplicates(["id", "h"])
    rows = staged(rows, "labelled")
    n = rows.count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    return rows.select("id", "y", "text")
