"""Case files as rows: sniffing by content, decoding by kind, cleaning as columns. A bad file is a row with an error, not a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X

KINDS = ("docx", "doc", "rtf", "pdf")
DECODED = "path string, file_type string, raw string, warnings array<string>, error string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a folder or glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def sniff(content: Column | str) -> Column:
    """Kind of a file by its first bytes; null if they tell nothing. A PDF mark may stand up to a kilobyte in."""
    head = F.hex(F.substring(X.col(content), 1, 2048))
    bare = F.regexp_replace(head, "^(09|0A|0B|0C|0D|20)+", "")
    marked = F.regexp_instr(F.substring(head, 1, 2048), F.lit("^(..)*?255044462D")) > 0
    return (
        F.when(marked, "pdf")
        .when(F.startswith(bare, F.lit("7B5C727466")), "rtf")
        .when(F.startswith(head, F.lit("504B0304")), "docx")
        .when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "doc")
    )


def kind_of(path: Column | str, content: Column | str) -> Column:
    by_name = F.lower(F.regexp_extract(X.col(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(sniff(content), F.when(by_name.isin(*KINDS), by_name))


def _decode(batches):
    from quillon.sources.doc import doc_text
    from quillon.sources.docx import docx_text
    from quillon.sources.rtf import rtf_text

    readers = {"rtf": lambda d: (rtf_text(d), []), "docx": docx_text, "doc": doc_text}
    for pdf in batches:
        rows = []
        for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
            try:
                text, warnings = readers[kind](bytes(content))
                rows.append((path, kind, text, warnings, None))
            except Exception as e:  # noqa: BLE001 - any damage makes an error row
                rows.append((path, kind, "", [], str(e) if isinstance(e, ValueError) else f"unreadable: {type(e).__name__}"))
        yield type(pdf)(rows, columns=["path", "file_type", "raw", "warnings", "error"])


def extract(files: DataFrame) -> DataFrame:
    """Files (path, content) to (path, file_type, text, encoding, warnings, error, needs_review).

    PDF bytes need page candidates from outside (see ``operators.pages``); here they are rows with an error.
    """
    known = files.withColumn("kind", kind_of("path", "content"))
    readable = F.coalesce(F.col("kind").isin("rtf", "docx", "doc"), F.lit(False))
    decoded = known.where(readable).select("path", "kind", "content").mapInPandas(_decode, DECODED)
    other = known.where(~readable).select(
        "path",
        F.col("kind").alias("file_type"),
        F.lit("").alias("raw"),
        F.array().cast("array<string>").alias("warnings"),
        F.when(F.col("kind") == "pdf", "pdf: give its page candidates to the page operators").otherwise("unsupported file type").alias("error"),
    )
    rows = decoded.unionByName(other).withColumn("fixed", X.fix_legacy("raw")).withColumn("text", X.clean_text("fixed.text"))
    warn = F.when(F.col("fixed.encoding").isNotNull(), F.array(F.concat(F.lit("legacy encoding: "), "fixed.encoding"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("warnings", F.concat("warnings", warn))
    error = F.coalesce("error", F.when(F.col("text") == "", "no readable text"))
    return rows.select("path", "file_type", "text", F.col("fixed.encoding").alias("encoding"), "warnings", error.alias("error"), (F.size("warnings") > 0).alias("needs_review"))


def _writer(make):
    def run(batches):
        for pdf in batches:
            yield type(pdf)({"path": pdf["path"], "text": pdf["text"], "content": [make(t or "") for t in pdf["text"]]})

    return run


def as_rtf(texts: DataFrame) -> DataFrame:
    from quillon.sources.rtf import rtf_bytes

    return texts.select("path", "text").mapInPandas(_writer(rtf_bytes), "path string, text string, content binary")


def as_docx(texts: DataFrame) -> DataFrame:
    from quillon.sources.docx import docx_bytes

    return texts.select("path", "text").mapInPandas(_writer(lambda t: docx_bytes(t.split("\n"))), "path string, text string, content binary")
