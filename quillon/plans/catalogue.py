"""Queries over the star schema and the text tables, one an operator, and the same as SQL.

Each applies an operator of this package to whole tables. The tables hold invented English, French, German and Spanish prose, so word lists and
thresholds are parameters here; the Vietnamese rules are tested on fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X
from quillon.operators import assemble, audit, memo, pages, retrieval, sequence

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer partitions than there are cores are spread first, since functions over text cost far more than reading."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ", ".join(map(lit, K.STOPWORDS)) + "]"


def sql_tokens(text: str) -> str:
    found = f"regexp_extract_all(lower(nfc_normalize(coalesce({text}, ''))), {lit(K.TOKEN)})"
    return f"list_filter(list_distinct({found}), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


#: Letters with marks in the tables' languages, in place of the Vietnamese ones.
MARKED = "[äöüßéèêçàâîôûñáíóú]"


# ---- retrieval

TOPK = 10


@query(
    f"""WITH q AS (SELECT item_id, unnest({sql_tokens("text")}) AS t FROM benchmark),
d AS (SELECT doc_id, unnest({sql_tokens("text")}) AS t FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {TOPK}"""
)
def lexical_topk(spark, sf_dir):
    """The ten documents that share most tokens with each benchmark item."""
    return retrieval.best_overlap(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", TOPK)


DEMO_PHRASES = ("in the", "of the", "de la", "und der")
DEMO_BOOSTS = (("fr", None, 8, (" les ", " des ")), ("de", None, 8, (" und ",)), ("es", "165", 30, (" que ", " los ")))


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as articles (first line as title, language as code, id as number) and benchmark items as queries."""
    docs = read(spark, sf_dir, "documents")
    articles = docs.select(
        F.col("doc_id").alias("article_id"),
        F.col("doc_id").alias("load_seq"),
        F.col("lang").alias("code"),
        F.col("doc_id").cast("string").alias("number"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
    )
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), articles


def _weighted(spark, sf_dir) -> DataFrame:
    queries, articles = _library(spark, sf_dir)
    return retrieval.best_articles(queries, articles, TOPK, phrases=DEMO_PHRASES, boosts=DEMO_BOOSTS, cited=r"(\d+)")


def _sql_weighted() -> str:
    any_of = lambda c, xs: "(" + " OR ".join(f"contains({c}, {lit(x)})" for x in xs) + ")"
    phrases = " + ".join(f"(CASE WHEN contains(q.n, {lit(p)}) AND contains(a.n, {lit(p)}) THEN 4 ELSE 0 END)" for p in DEMO_PHRASES)
    boosts = " + ".join(
        f"(CASE WHEN a.lang = {lit(c)}{'' if n is None else f' AND a.number = {lit(n)}'} AND {any_of('q.n', t)} THEN {p} ELSE 0 END)"
        for c, n, p, t in DEMO_BOOSTS
    )
    return f"""q AS (SELECT item_id, lower(nfc_normalize(text)) AS n, {sql_tokens("text")} AS t,
  list_distinct(regexp_extract_all(lower(text), '(\\d+)', 1)) AS numbers FROM benchmark),
a AS (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS number, split_part(text, chr(10), 1) || ' ' || text AS h, split_part(text, chr(10), 1) AS title,
  lower(nfc_normalize(split_part(text, chr(10), 1) || ' ' || text)) AS n FROM documents),
h AS (SELECT item_id, doc_id, count(*) AS o FROM (SELECT item_id, unnest(t) AS t FROM q) JOIN (SELECT doc_id, unnest({sql_tokens("h")}) AS t FROM a) USING (t) GROUP BY ALL),
ti AS (SELECT item_id, doc_id, count(*) AS o FROM (SELECT item_id, unnest(t) AS t FROM q) JOIN (SELECT doc_id, unnest({sql_tokens("title")}) AS t FROM a) USING (t) GROUP BY ALL),
s AS (SELECT q.item_id, a.doc_id, coalesce(h.o, 0) + 3 * coalesce(ti.o, 0) + {phrases} + {boosts}
  + (CASE WHEN list_contains(q.numbers, a.number) THEN 10 ELSE 0 END) AS score
  FROM q CROSS JOIN a LEFT JOIN h USING (item_id, doc_id) LEFT JOIN ti USING (item_id, doc_id) WHERE len(q.t) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {_sql_weighted()} SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {TOPK}")
def weighted_topk(spark, sf_dir):
    """The full score: tokens, title tokens, phrases, rule boosts, cited numbers."""
    return _weighted(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("article_id").alias("doc_id"), "score", "rank")


@query(
    f"""WITH {_sql_weighted()},
p AS (SELECT item_id, n.unnest AS doc_id, n.o FROM (SELECT item_id, unnest([item_id, 51, 52]) AS unnest, unnest([0, 1, 2]) AS o FROM benchmark) n JOIN labels ON labels.doc_id = n.unnest),
pp AS (SELECT item_id, doc_id, min(o) AS o FROM p GROUP BY ALL),
u AS (SELECT item_id, doc_id, 0 AS part, o FROM pp UNION ALL
  SELECT item_id, doc_id, 1, rank FROM r WHERE rank <= {TOPK} AND (item_id, doc_id) NOT IN (SELECT item_id, doc_id FROM pp))
SELECT item_id, doc_id, part = 0 AS pinned, CAST(row_number() OVER (PARTITION BY item_id ORDER BY part, o) AS INT) AS rank FROM u"""
)
def pinned_topk(spark, sf_dir):
    """Labelled documents 51, 52 and the item's own number in front, then the best ten that aren't among them."""
    queries, articles = _library(spark, sf_dir)
    asked = F.array(F.col("query_id"), F.lit(51).cast("long"), F.lit(52).cast("long"))
    requests = queries.select("query_id", F.posexplode(asked).alias("ord", "number"))
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), F.lit("labels").alias("code"), F.col("doc_id").alias("article_id"), F.col("doc_id").alias("load_seq"))
    pins = retrieval.articles_by_number(requests, labelled, "labels")
    out = retrieval.pinned_top_k(_weighted(spark, sf_dir), pins, TOPK)
    return out.select(F.col("query_id").alias("item_id"), F.col("article_id").alias("doc_id"), "pinned", "rank")


# ---- text


@query(
    f"""SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(coalesce(list_sum(list_transform(t, lambda w: length(w))), 0) AS BIGINT) AS token_chars
FROM (SELECT doc_id, {sql_tokens("text")} AS t FROM documents)"""
)
def token_stats(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", X.tokens(X.normalize("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("token_chars"))


SQL_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(nfc_normalize(coalesce({c}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '),
 '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FEFF}\x{200B}]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"""


@query(f"SELECT doc_id, CAST(length(c) AS INT) AS n, md5(c) AS digest FROM (SELECT doc_id, {SQL_CLEAN.replace('{c}', 'text')} AS c FROM documents)")
def clean_text_len(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("c"))
    return c.select("doc_id", F.length("c").alias("n"), F.md5("c").alias("digest"))


def sql_words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), {lit(K.WORD)})"


def sql_marked(c: str) -> str:
    return f"len(list_filter({sql_words(c)}, lambda w: regexp_matches(lower(w), {lit(MARKED)})))"


def sql_chars(c: str) -> str:
    return f"length(regexp_replace(coalesce({c}, ''), '\\s', '', 'g'))"


def sql_score(c: str) -> str:
    return f"(CASE WHEN len({sql_words(c)}) = 0 THEN -1 ELSE 2 * len({sql_words(c)}) + 5 * {sql_marked(c)} END)"


@query(
    f"""SELECT doc_id, CAST({sql_chars("text")} AS INT) AS chars, CAST(len({sql_words("text")}) AS INT) AS words,
round(CASE WHEN len({sql_words("text")}) = 0 THEN 0.0 ELSE CAST({sql_marked("text")} AS DOUBLE) / len({sql_words("text")}) END, 9) AS marked_ratio,
round(CASE WHEN {sql_chars("text")} = 0 THEN 0.0 ELSE 6.0 * len(regexp_extract_all(text, '\\(cid:\\d+\\)')) / {sql_chars("text")} END, 9) AS bad_ratio FROM documents"""
)
def text_stats(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", X.text_stats("text", MARKED).alias("s"))
    return s.select("doc_id", "s.chars", "s.words", F.round("s.viet_ratio", 9).alias("marked_ratio"), F.round("s.bad_ratio", 9).alias("bad_ratio"))


@query(f"SELECT doc_id, CAST({sql_score('text')} AS INT) AS score FROM documents")
def quality_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.score_text("text", MARKED).alias("score"))


# ---- pages

TAGS = "<[^>]*>"
SQL_LAYERS = f"""layers AS (SELECT page_id, 0 AS ord, 'raw' AS engine, html AS text FROM pages UNION ALL
SELECT page_id, 1, 'stripped', regexp_replace(html, '{TAGS}', ' ', 'g') FROM pages UNION ALL
SELECT page_id, 2, 'collapsed', regexp_replace(regexp_replace(html, '{TAGS}', ' ', 'g'), '[ \\t\\n]+', ' ', 'g') FROM pages)"""


def _layers(spark, sf_dir) -> DataFrame:
    p, bare = read(spark, sf_dir, "pages"), F.regexp_replace("html", TAGS, " ")
    kinds = F.array(
        *(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("engine"), t.alias("text")) for i, (n, t) in enumerate(
            (("raw", F.col("html")), ("stripped", bare), ("collapsed", F.regexp_replace(bare, "[ \\t\\n]+", " "))))
        )
    )
    return p.select("page_id", F.inline(kinds))


@query(
    f"""WITH {SQL_LAYERS}, s AS (SELECT *, CAST({sql_score("text")} AS DOUBLE) AS score, length(text) AS n FROM layers),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n DESC, ord) AS k FROM s)
SELECT page_id, engine, CAST(n AS INT) AS chars FROM r WHERE k = 1"""
)
def best_layer(spark, sf_dir):
    return pages.best_layer(_layers(spark, sf_dir), ["page_id"], MARKED).select("page_id", "engine", F.length("text").alias("chars"))


def sql_judge(c: str, cover: str) -> str:
    chars, n = sql_chars(c), f"len({sql_words(c)})"
    return f"""CASE WHEN {chars} < 25 THEN 'empty'
WHEN 6.0 * len(regexp_extract_all({c}, '\\(cid:\\d+\\)')) / {chars} > 0.05 THEN 'garbage'
WHEN {cover} >= 0.5 AND ({n} < 8 OR len(regexp_extract_all({c}, '\\p{{L}}')) < {chars} * 0.4) THEN 'garbage'
WHEN {n} >= 40 AND CAST({sql_marked(c)} AS DOUBLE) / {n} < 0.15 THEN 'suspect' ELSE 'good' END"""


@query(
    f"""WITH b AS (SELECT page_id, regexp_replace(html, '{TAGS}', ' ', 'g') AS t, 1.0 - CAST({sql_chars(f"regexp_replace(html, '{TAGS}', ' ', 'g')")} AS DOUBLE) / {sql_chars("html")} AS cover FROM pages)
SELECT page_id, {sql_judge("t", "cover")} AS verdict, cover >= 0.5 AS scanned FROM b"""
)
def page_judge(spark, sf_dir):
    """Pages judged by their text without tags; the share of markup stands for the share of the page under images."""
    count = lambda c: F.length(F.regexp_replace(c, X.U + r"\s", ""))
    b = read(spark, sf_dir, "pages").withColumn("t", F.regexp_replace("html", TAGS, " "))
    b = b.withColumn("cover", F.lit(1.0) - count("t").cast("double") / count("html"))
    return b.select("page_id", pages.judge("t", F.col("cover"), MARKED).alias("verdict"), (F.col("cover") >= pages.SCAN_COVERAGE).alias("scanned"))


@query(
    f"""WITH b AS (SELECT doc_id, lang, {sql_chars("text")} AS chars, len({sql_words("text")}) AS words, {sql_marked("text")} AS marked,
  round(CAST(len({sql_words("text")}) AS DOUBLE) / (len({sql_words("text")}) + 2 * len(regexp_extract_all(text, '[#*$%&|<>!]'))), 9) AS conf FROM documents)
SELECT doc_id, coalesce(conf < (CASE WHEN lang = 'en' THEN 0.88 ELSE 0.75 END) AND chars > 20, false) AS low_confidence,
  words >= 40 AND CAST(marked AS DOUBLE) / words < 0.25 AS few_marks FROM b"""
)
def low_confidence_flags(spark, sf_dir):
    """Issues of each document as if it had been recognised, with the share of plain words as confidence."""
    words, odd = F.size(X.text_words("text")), F.regexp_count("text", F.lit("[#*$%&|<>!]"))
    conf = F.round(F.when(words + 2 * odd > 0, words.cast("double") / (words + 2 * odd)), 9)
    engine = F.when(F.col("lang") == "en", "Tesseract").otherwise("other")
    d = read(spark, sf_dir, "documents").select("doc_id", pages.reading_issues("text", conf, engine, MARKED).alias("i"))
    return d.select("doc_id", F.array_contains("i", "low_confidence").alias("low_confidence"), F.array_contains("i", "few_marks").alias("few_marks"))


@query(
    """WITH b AS (SELECT doc_id, source, n_chars < 400 AS needs FROM documents),
n AS (SELECT *, sum(CAST(needs AS INT)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT doc_id, source, CASE WHEN NOT needs THEN 'text' WHEN k <= 5 THEN 'ocr' ELSE 'skipped' END AS method FROM n"""
)
def capped_pages(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return pages.cap_pages(d, "source", "doc_id", F.col("n_chars") < 400, 5).select("doc_id", "source", "method")


@query(
    """SELECT l_returnflag, round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE)
 / CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE), 9) AS confidence FROM lineitem GROUP BY l_returnflag"""
)
def weighted_confidence(spark, sf_dir):
    """The mean discount weighted by quantity, in exact sums."""
    dec = lambda c: F.col(c).cast("decimal(12,2)")
    out = pages.weighted_confidence(read(spark, sf_dir, "lineitem"), "l_returnflag", dec("l_quantity"), dec("l_discount"))
    return out.select("l_returnflag", F.round("confidence", 9).alias("confidence"))


@query(
    """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, CAST(count(*) AS BIGINT) AS n
FROM conversations WHERE text <> '' GROUP BY conv_id"""
)
def ordered_concat(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("text <> ''")
    text = pages.ordered_text(c, "conv_id", ["turn"], "text", "\n\n")
    return text.select("conv_id", F.md5("text").alias("digest")).join(c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id")


# ---- routing and facts

PROSE, SHOUT = " (?:the|and|of|que|les|und) ", r"!!|\*\*\*|%%%|\$\$\$"
SQL_ROUTE = f"""(SELECT doc_id, CASE WHEN ds >= 4 AND ds >= 3 * greatest(hs, 1) THEN '{K.CIVIL}' WHEN hs >= 4 AND hs >= 3 * greatest(ds, 1) THEN '{K.CRIMINAL}' END AS route
FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i){SHOUT}')) AS hs, len(regexp_extract_all(text, '(?i){PROSE}')) AS ds FROM documents))"""


def _routes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.case_type("text", SHOUT, PROSE).alias("route"))


@query(f"SELECT doc_id, route FROM {SQL_ROUTE}")
def rule_route(spark, sf_dir):
    """Documents routed by two families of marks, here common words against decoration."""
    return _routes(spark, sf_dir)


@query(f"SELECT coalesce(route, 'none') AS route, quality, CAST(count(*) AS BIGINT) AS n FROM {SQL_ROUTE} JOIN labels USING (doc_id) GROUP BY ALL")
def route_vs_label(spark, sf_dir):
    both = _routes(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy(F.coalesce("route", F.lit("none")).alias("route"), "quality").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.k')), ''), 'Không') AS k,
coalesce(nullif(trim(json_extract_string(props, '$.note')), ''), '…') AS note FROM events"""
)
def domain_null_default(spark, sf_dir):
    from quillon.operators.facts import filled

    return read(spark, sf_dir, "events").select("event_id", X.strip(filled("props", "$.k", "Không")).alias("k"), filled("props", "$.note", "…").alias("note"))


# ---- sequences


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[.;:]$'), true) AS s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM m)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, md5(string_agg(line, ' ' ORDER BY pos)) AS digest, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY doc_id, segment"""
)
def paragraph_segments(spark, sf_dir):
    """Lines joined to paragraphs: one ends where a line ends a sentence or clause."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    seg = sequence.segments(lines, "doc_id", "pos", F.coalesce(before.rlike("[.;:]$"), F.lit(True)))
    out = seg.groupBy("doc_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"), F.count(F.lit(1)).alias("n"))
    return out.select("doc_id", "segment", F.md5(F.array_join("l.line", " ")).alias("digest"), "n")


@query(
    """SELECT conv_id, turn, md5(last_value(CASE WHEN role IN ('system', 'user') THEN text END IGNORE NULLS)
OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS heading FROM conversations"""
)
def heading_carry(spark, sf_dir):
    """Every turn with the last system or user turn as its heading."""
    c = read(spark, sf_dir, "conversations")
    out = sequence.carry_forward(c, "conv_id", ["turn"], F.col("text"), F.col("role").isin("system", "user"), "heading")
    return out.select("conv_id", "turn", F.md5("heading").alias("heading"))


SQL_ISLANDS = """n AS (SELECT DISTINCT o_orderstatus AS g, o_orderkey AS k FROM orders),
i AS (SELECT g, min(k) AS lo, max(k) AS hi FROM (SELECT g, k, k - row_number() OVER (PARTITION BY g ORDER BY k) AS d FROM n) GROUP BY g, d),
b AS (SELECT * FROM (SELECT g, hi + 1 AS lo, lead(lo) OVER (PARTITION BY g ORDER BY lo) - 1 AS hi FROM i) WHERE hi IS NOT NULL)"""


def _islands(spark, sf_dir) -> DataFrame:
    return sequence.islands(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")


@query(f"WITH {SQL_ISLANDS} SELECT g AS o_orderstatus, lo, hi FROM i")
def gap_islands(spark, sf_dir):
    """Runs of consecutive order numbers of each status."""
    return _islands(spark, sf_dir)


@query(f"WITH {SQL_ISLANDS} SELECT g AS o_orderstatus, unnest(range(lo, hi + 1)) AS number FROM b")
def seq_gaps(spark, sf_dir):
    return sequence.missing_numbers(sequence.gaps(_islands(spark, sf_dir), "o_orderstatus"), "o_orderstatus")


@query(
    f"""WITH {SQL_ISLANDS}, x AS (SELECT g, lo, hi, unnest(range(lo - 1, hi + 1)) AS k FROM b),
m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT g AS o_orderstatus, lo, hi, bool_or(m.k IS NOT NULL) AS repealed FROM x LEFT JOIN m USING (k) GROUP BY g, lo, hi"""
)
def gap_classify(spark, sf_dir):
    """Gaps of each status, told apart by whether an urgent order of any status lies in them."""
    between = sequence.gaps(_islands(spark, sf_dir), "o_orderstatus")
    rows = read(spark, sf_dir, "orders")
    return sequence.classify_gaps(between, rows, "o_orderstatus", "o_orderkey", F.col("o_orderpriority") == "1-URGENT", own=False)


@query(
    """SELECT event_id, user_id FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before > value"""
)
def seq_out_of_order(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return sequence.out_of_order(e, "user_id", ["event_id"], F.col("value")).select("event_id", "user_id")


@query("SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def seq_duplicates(spark, sf_dir):
    return sequence.duplicates(read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


SQL_MODES = """c AS (SELECT l_returnflag, round_even(l_extendedprice / 1000, 0) AS v, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS o FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, o) AS k, sum(n) OVER (PARTITION BY l_returnflag) AS t FROM c)"""


@query(f"WITH {SQL_MODES} SELECT l_returnflag, v AS mode, CAST(n AS BIGINT) AS n FROM r WHERE k = 1")
def modal_margin(spark, sf_dir):
    """The commonest price in thousands, rounded half to even; of equal ones the first seen."""
    return sequence.modal(read(spark, sf_dir, "lineitem"), "l_returnflag", F.bround(F.col("l_extendedprice") / 1000), ["l_orderkey", "l_linenumber"])


@query(f"WITH {SQL_MODES} SELECT l_returnflag, max(CASE WHEN k <= 3 AND n >= t * 0.01 THEN v END) AS margin FROM r GROUP BY l_returnflag")
def top3_mode_max(spark, sf_dir):
    """The largest of the three commonest prices that at least a hundredth of the rows have."""
    return sequence.top_mode_max(read(spark, sf_dir, "lineitem"), "l_returnflag", F.bround(F.col("l_extendedprice") / 1000), ["l_orderkey", "l_linenumber"], share=0.01)


# ---- audits and assembly

MAIL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"\+?\d[\d -]{6,}\d"


@query(
    f"""SELECT doc_id, CAST(len(m) AS INT) AS missing, array_to_string(list_slice(list_sort(list_distinct(list_transform(m, lambda x: left(x, 60)))), 1, 6), '; ') AS missing_marks,
CAST((length(text) - length(replace(text, 'License', ''))) / 7 AS INT) AS law_marks, CAST(len(regexp_extract_all(text, '(?i){PHONE}')) AS INT) AS suggestions
FROM (SELECT doc_id, text, regexp_extract_all(text, '{MAIL}') AS m FROM documents)"""
)
def marker_audit(spark, sf_dir):
    """Counts of marks in documents, with addresses, licences and numbers as marks."""
    d = read(spark, sf_dir, "documents").select("doc_id", audit.marker_audit("text", missing=MAIL, law="License", suggestion=PHONE).alias("m"))
    return d.select("doc_id", "m.missing", "m.missing_marks", "m.law_marks", "m.suggestions")


SECTION = ("(licen[cs]ed|released) under", "all rights reserved")


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'),
  lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
f AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i){SECTION[0]}')), true) AS a FROM l),
e AS (SELECT doc_id, l, a, list_position(list_transform(l, lambda x, i: i > a AND regexp_matches(x, '(?i){SECTION[1]}')), true) AS b FROM f),
c AS (SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN list_slice(l, a, b - 1) END AS c FROM e)
SELECT doc_id, CAST(len(c) AS INT) AS n, md5(array_to_string(c, chr(10))) AS digest FROM c"""
)
def slice_between_anchors(spark, sf_dir):
    """The lines of every document from the first that grants a licence up to the next that reserves all rights."""
    lines = read(spark, sf_dir, "documents").select("doc_id", X.lines("text").alias("l"))
    start = assemble.find_line(F.col("l"), SECTION[0])
    marked = lines.withColumn("a", start).withColumn("b", assemble.find_line(F.col("l"), SECTION[1], F.col("a") + 1))
    cut = marked.select("doc_id", F.when(F.col("a").isNotNull(), assemble.cut(F.col("l"), F.col("a"), F.col("b"))).alias("c"))
    return cut.select("doc_id", F.when(F.col("c").isNotNull(), F.size("c")).alias("n"), F.md5(F.array_join("c", "\n")).alias("digest"))


REWRITES = [(r"[ \t]+", " "), (r"(?i)the and", "and the"), (r"!!+", "!"), (r"and the and", "and")]


def _sql_rewrites() -> str:
    out = "text"
    for pattern, new in REWRITES:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(new)}, 'g')"
    return out


@query(f"SELECT doc_id, md5({_sql_rewrites()}) AS digest FROM documents")
def ordered_rewrites(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(assemble.rewrite("text", REWRITES)).alias("digest"))


@query("SELECT conv_id, turn, sha256('stub' || chr(31) || '' || chr(31) || '4000' || chr(31) || coalesce(role, '') || chr(31) || coalesce(text, '')) AS key FROM conversations")
def memo_key(spark, sf_dir):
    key = memo.memo_key(F.lit("stub"), F.lit(None).cast("string"), F.lit(4000), F.col("role"), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"))


@query()
def memo_miss(spark, sf_dir):
    """User turns answered by a stub; what system and assistant turns hold is stored already, so only other prompts are sent."""
    key = memo.memo_key(F.lit("stub"), F.lit(None).cast("string"), F.lit(4000), F.lit(""), F.col("text"))
    turns = read(spark, sf_dir, "conversations").withColumn("key", key)
    known = turns.where("role <> 'user'").dropDuplicates(["key"]).select("key", F.lit("stored").alias("response"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", "key", F.lit("").alias("system"), F.col("text").alias("user"))
    answered, _ = memo.answer(asked, known, lambda system, user: f"{len(user)} characters")
    return answered.select("conv_id", "turn", "response")


def _cleaned():
    """What extraction makes of a text: the old code page repaired where its signs prevail, then cleaned."""
    return X.clean_text(X.fix_legacy("text")["text"])


@query()
def rtf_roundtrip(spark, sf_dir):
    """Documents written as RTF and read back; ``same`` tells whether the cleaned text came through.

    The reader drops a bar at the end of a line, as it stands after the last cell of a table row.
    """
    from quillon.sources import files

    made = files.as_rtf(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    out = files.extract(made.withColumn("path", F.concat("path", F.lit(".rtf"))))
    back = made.select(F.concat("path", F.lit(".rtf")).alias("path"), X.clean_text(F.regexp_replace(_cleaned(), "[ \\t]*\\|[ \\t]*\\n", "\n")).alias("want")).join(out, "path")
    return back.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "file_type", (F.col("want") == F.col("text")).alias("same"))


@query()
def docx_walk(spark, sf_dir):
    """Documents written as DOCX, a paragraph a line, and read back; blank lines and double spaces do not come through."""
    from quillon.sources import files

    made = files.as_docx(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    out = files.extract(made.withColumn("path", F.concat("path", F.lit(".docx"))))
    back = made.select(F.concat("path", F.lit(".docx")).alias("path"), F.array_join(X.lines(_cleaned()), "\n").alias("want")).join(out, "path")
    return back.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "file_type", (F.col("want") == F.col("text")).alias("same"))
