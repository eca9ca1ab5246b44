"""The statute corpus: reading files of articles in order, building them from paragraphs, writing one folder a code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators.sequence import parse_articles

FIELDS = ("dieu_so", "tieu_de", "noi_dung", "phan", "chuong", "muc", "tieu_muc", "luat", "ma_luat")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """Articles of all files below a path, with ``load_seq``: files by path, articles as they stand in their file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.input_file_name())
    rows = files.select("file", F.posexplode(F.from_json("value", f"array<struct<{SCHEMA.replace(' string', ':string')}>>")).alias("pos", "a"))
    order = Window.orderBy("file")
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.withColumn("before", F.sum("n").over(order) - F.col("n"))  # a row a file
    return rows.join(F.broadcast(offsets), "file").select((F.col("before") + F.col("pos")).alias("load_seq"), "a.*")


def as_articles(laws: DataFrame) -> DataFrame:
    """Laws in the shape that retrieval takes."""
    return laws.select(
        F.col("load_seq").alias("article_id"), "load_seq", F.col("ma_luat").alias("code"), F.col("dieu_so").alias("number"),
        F.col("tieu_de").alias("title"), F.col("noi_dung").alias("body"), F.col("luat").alias("law"), "chuong",
    )


def build_laws(paragraphs: DataFrame, names: DataFrame) -> DataFrame:
    """Paragraphs (source_id, pos, text) and names (source_id, luat, ma_luat) to articles; raw lines are normalised first."""
    clean = paragraphs.withColumn("text", X.corpus_line("text")).where("text <> ''")
    return parse_articles(clean).join(names, "source_id")


def write_laws(articles: DataFrame, path: str) -> None:
    articles.select(*FIELDS).write.mode("overwrite").partitionBy("ma_luat").parquet(path)
