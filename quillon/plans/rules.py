"""More queries of the catalogue: rules over lines, numbers, files and drafts that are made from the driver's tables by both sides alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X
from quillon.operators import assemble, audit, pages, sequence
from quillon.plans.catalogue import lit, query, read
from quillon.sources import files

ONE = [K.MISSING, "", " x ", "nothing"]
HEADS = ["Phần thứ ", "Chương ", "Tiểu  mục ", "Mục ", "Điều ", "chương "]


def pick(values: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))


def sql_pick(values: list[str], number: str) -> str:
    return f"([{', '.join(map(lit, values))}])[CAST({number} % {len(values)} + 1 AS INT)]"


@query(f"SELECT doc_id, trim(regexp_replace(translate(nfc_normalize(coalesce(text, '')), chr(208), chr(272)), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS line FROM (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents)")
def corpus_lines(spark, sf_dir):
    """The first line of every document as a statute's reader writes it."""
    first = F.substring_index("text", "\n", 1)
    return read(spark, sf_dir, "documents").select("doc_id", X.corpus_line(first).alias("line"))


@query(f"SELECT event_id, ([NULL, 'phan', 'chuong', 'tieu_muc', 'muc', NULL, 'chuong'])[CAST(event_id % 6 + 2 AS INT)] AS level FROM events")
def heading_levels(spark, sf_dir):
    """Levels of made headings."""
    line = F.concat(pick(HEADS, "event_id"), F.when(F.col("event_id") % 6 == 0, F.lit("nhất")).otherwise(F.col("event_id").cast("string")))
    return read(spark, sf_dir, "events").select("event_id", X.structure_level(line).alias("level"))


@query("SELECT event_id, event_id % 2 = 0 AND regexp_matches(event_type, '[a-z]') AS title FROM events")
def title_lines(spark, sf_dir):
    """Every other event type in capitals: a title."""
    line = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", X.is_title_line(line).alias("title"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN '' ELSE event_id || CASE WHEN event_id % 3 = 2 THEN 'a' ELSE '' END END AS number, CASE WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS title FROM events")
def article_lines(spark, sf_dir):
    """Numbers and titles of made article headings; a third of them miss the full stop."""
    e, n = read(spark, sf_dir, "events"), F.col("event_id") % 3
    line = F.concat(F.lit("Điều  "), "event_id", F.when(n == 2, "a").otherwise(""), F.when(n == 1, " ").otherwise(".  "), "event_type")
    return e.select("event_id", X.article_number(line).alias("number"), X.article_title(line).alias("title"))


@query("SELECT event_id, CAST(event_id AS INT) AS n, substr(event_type, 1, 1) AS suffix FROM events")
def number_keys(spark, sf_dir):
    """Order keys of numbers with a letter."""
    key = X.number_key(F.concat("event_id", F.substring("event_type", 1, 1)))
    return read(spark, sf_dir, "events").select("event_id", key["n"].alias("n"), key["suffix"].alias("suffix"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN trim(event_type) ELSE props END AS json FROM events")
def json_cuts(spark, sf_dir):
    """The JSON object inside an answer, or the answer where there is none."""
    said = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("Here: "), "props", F.lit(" end")))
    return read(spark, sf_dir, "events").select("event_id", X.cut_json(said).alias("json"))


@query("SELECT event_id, regexp_matches(lower('Error ' || event_id || ' ' || event_type), '503|429|404|500|unavailable|overload|resource_exhausted|quota|not found|deadline|timeout') AS again FROM events")
def retryable_errors(spark, sf_dir):
    """Which made errors are worth another call."""
    return read(spark, sf_dir, "events").select("event_id", X.is_retryable(F.concat(F.lit("Error "), "event_id", F.lit(" "), "event_type")).alias("again"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def folded(spark, sf_dir):
    """Texts without diacritics."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(X.fold("text")).alias("digest"))


@query(
    f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(t, {lit(K.UNICODE_SIGNS)})) AS u, len(regexp_extract_all(t, {lit(K.TCVN3_SIGNS)})) AS o,
  len(regexp_extract_all(t, {lit(K.VNI_SIGNS)})) AS v, len(regexp_extract_all(t, '\\pL')) AS l FROM c)
SELECT doc_id, CASE WHEN o >= 15 AND o > 5 * u THEN 'TCVN3' WHEN v >= 15 AND v > 5 * u AND v > l * 0.04 THEN 'VNI' END AS encoding FROM n"""
)
def legacy_encodings(spark, sf_dir):
    """Texts that look like an old code page."""
    return read(spark, sf_dir, "documents").select("doc_id", X.legacy_encoding("text").alias("encoding"))


STARTS = ["25504446", "7B5C72746631", "504B0304", "D0CF11E0A1B11AE1", "414243", "0A0D207B5C727466", "20202525504446"]


@query("SELECT event_id, (['pdf', 'rtf', 'docx', 'doc', NULL, 'rtf', NULL])[CAST(event_id % 7 + 1 AS INT)] AS kind FROM events")
def sniffed_kinds(spark, sf_dir):
    """Kinds of made files by their first bytes."""
    head = pick(["255044462D", *STARTS[1:]], "event_id")
    return read(spark, sf_dir, "events").select("event_id", files.sniff(F.unhex(F.concat(head, F.hex("event_type")))).alias("kind"))


@query("SELECT event_id, ([false, false, true, true])[CAST(event_id % 4 + 1 AS INT)] AS filled FROM events")
def filled_fields(spark, sf_dir):
    """Blank fields and those marked as missing."""
    return read(spark, sf_dir, "events").select("event_id", X.is_filled(pick(ONE, "event_id")).alias("filled"))


@query(
    """SELECT page_id, regexp_matches(html, '(?i)BÁO\\s+CÁO\\s+ĐỀ\\s+XUẤT') AS report, page_id % 2 = 0 AS made FROM pages"""
)
def report_test(spark, sf_dir):
    """Pages aren't proposal reports; every other one becomes one when the two headings are put before it."""
    head = F.when(F.col("page_id") % 2 == 0, F.lit("BÁO CÁO  ĐỀ XUẤT\nQuan điểm của công chức\n")).otherwise("")
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", assemble.is_report("html").alias("report"), assemble.is_report(F.concat(head, "html")).alias("made"))


@query(
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE '' END) AS kept, doc_id % 2 = 0 AS has FROM documents WHERE text IS NOT NULL"""
)
def appendix_split(spark, sf_dir):
    """A check that stands between its two marks is cut out of a draft."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    marked = F.concat(F.lit("Draft\n" + K.CHECK_BEGIN + "\n"), "text", F.lit("\n" + K.CHECK_END + "\nend"))
    got = audit.split_check(F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.lit("Draft")))
    return d.select("doc_id", F.md5(_second(got)).alias("kept"), (_second(got) != "").alias("has"))


def _second(parts: Column) -> Column:
    return F.coalesce(X.strip(F.regexp_replace(F.regexp_replace(F.coalesce(parts["appendix"], F.lit("")), K.CHECK_BEGIN, ""), K.CHECK_END, "")), F.lit(""))


@query(
    """WITH s AS (SELECT source, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT doc_id) AS n FROM documents GROUP BY source)
SELECT source, CAST(last - first + 1 - n AS BIGINT) AS missing FROM s"""
)
def missing_counts(spark, sf_dir):
    """How many numbers between its first and last each source lacks."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id")
    gaps = sequence.gaps(sequence.islands(d, "source", "doc_id"), "source").select("source", (F.col("hi") - F.col("lo") + 1).alias("n"))
    return d.select("source").distinct().join(gaps, "source", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))


@query(
    """SELECT source, coalesce(array_to_string(list_sort(list(doc_id) FILTER (doc_id % 3 = 0)), ','), '') AS ocr_pages,
coalesce(array_to_string(list_sort(list(doc_id) FILTER (doc_id % 5 = 0)), ','), '') AS problem_pages FROM documents GROUP BY source"""
)
def file_summaries(spark, sf_dir):
    """Documents as pages: every third recognised, every fifth with a problem."""
    d = read(spark, sf_dir, "documents")
    method = F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("text")
    issues = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("faint"))).otherwise(F.array().cast("array<string>"))
    out = pages.file_summary(d.select("source", F.col("doc_id").alias("number"), method.alias("method"), issues.alias("issues")), "source")
    return out.select("source", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ocr_pages", "problem_pages")))


@query(
    f"""SELECT event_id, NOT (dpi < {pages.LOW_DPI} OR contrast < {pages.FAINT} OR (contrast >= 3 AND sharp < {pages.BLURRY})) AS clean
FROM (SELECT event_id, event_id % 400 AS dpi, event_id % 90 AS contrast, (event_id % 11) / 10.0 AS sharp FROM events)"""
)
def image_checks(spark, sf_dir):
    """Made measurements of images: which have nothing wrong."""
    e = read(spark, sf_dir, "events")
    found = pages.image_issues(F.col("event_id") % 400, F.col("event_id") % 90, (F.col("event_id") % 11) / 10.0)
    return e.select("event_id", (F.size(found) == 0).alias("clean"))
