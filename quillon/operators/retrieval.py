"""Weighted lexical retrieval with pinned articles in front.

Up to ``MOST_QUERIES`` queries, the best k of each are found in one pass: the points that each token, phrase, boost and number gives to each query are a table
of bounded size that every task holds, an article is scored against all queries inside its row, and only k rows a query leave a batch. More queries go
through ``score_articles``, a postings equi-join whose pairs are shuffled.

Articles: ``article_id`` (unique), ``load_seq`` (order for ties), ``code``, ``number``, ``title``, ``body`` (the body starts with the title).
Queries: ``query_id``, ``text``. Every part of the score is an equi-join that yields points; the parts are added up, so a pair
needs no more than one shared token, number or boost to show up, and pairs that share nothing are never formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X


def postings(df: DataFrame, key: str, normal, stopwords=tuple(K.STOPWORDS)) -> DataFrame:
    return df.select(key, F.explode(X.tokens(normal, stopwords)).alias("token"))


def overlap(queries: DataFrame, articles: DataFrame, query_id: str, article_id: str, text: str = "text", stopwords=tuple(K.STOPWORDS)) -> DataFrame:
    """(query, article, score): how many distinct tokens both have."""
    q = postings(queries, query_id, X.normalize(text), stopwords)
    a = postings(articles, article_id, X.normalize(text), stopwords)
    return a.join(q, "token").groupBy(query_id, article_id).agg(F.count(F.lit(1)).alias("score"))


def top_k(scores: DataFrame, query_id: str, tie: str, k: int) -> DataFrame:
    """The best k of every query with their rank; equal scores stand in the order of ``tie``."""
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), tie)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def score_articles(
    queries: DataFrame,
    articles: DataFrame,
    *,
    phrases=K.PHRASES,
    boosts=K.BOOSTS,
    cited: str = K.CITED,
    stopwords=tuple(K.STOPWORDS),
) -> DataFrame:
    """(query_id, article_id, load_seq, code, number, score) for every pair with a score above zero."""
    q = queries.select("query_id", X.normalize("text").alias("q")).withColumn("t", X.tokens(F.col("q"), stopwords)).where(F.size("t") > 0)
    hay = F.concat_ws(" ", X.empty("title"), X.empty("body"))
    a = articles.select("article_id", "code", F.col("number").cast("string").alias("number"), X.normalize("title").alias("title"), X.normalize(hay).alias("hay"))
    qt = q.select("query_id", F.explode("t").alias("token"))
    parts = []
    all_tokens = a.select("article_id", F.explode(X.tokens(F.col("hay"), stopwords)).alias("token"))
    title_tokens = a.select("article_id", F.explode(X.tokens(F.col("title"), stopwords)).alias("token"))
    weighted = all_tokens.withColumn("p", F.lit(1)).unionByName(title_tokens.withColumn("p", F.lit(K.TITLE_POINTS)))
    weighted = weighted.groupBy("article_id", "token").agg(F.sum("p").alias("p"))
    parts.append(weighted.join(qt, "token").select("query_id", "article_id", "p"))
    if phrases:
        has = lambda c: F.explode(F.filter(F.array(*map(F.lit, phrases)), lambda x: F.contains(F.col(c), x))).alias("phrase")
        pq, pa = q.select("query_id", has("q")), a.select("article_id", has("hay"))
        parts.append(pa.join(pq, "phrase").select("query_id", "article_id", F.lit(K.PHRASE_POINTS).cast("long").alias("p")))
    for code, number, points, triggers in boosts:
        hit = reduce(lambda x, y: x | y, (F.contains(F.col("q"), F.lit(t)) for t in triggers))
        rows = a.where((F.col("code") == code) & (F.lit(True) if number is None else F.col("number") == number))
        hits = q.where(hit).select("query_id", F.lit(code).alias("c"))
        parts.append(rows.join(hits, F.col("code") == F.col("c")).select("query_id", "article_id", F.lit(points).cast("long").alias("p")))
    if cited:
        numbers = q.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit("(?Ud)" + cited), F.lit(1)))).alias("number"))
        parts.append(a.join(numbers, "number").select("query_id", "article_id", F.lit(K.NUMBER_POINTS).cast("long").alias("p")))
    points = reduce(DataFrame.unionByName, parts).groupBy("query_id", "article_id").agg(F.sum("p").alias("score")).where("score > 0")
    return points.join(articles.select("article_id", "load_seq", "code", F.col("number").cast("string").alias("number")), "article_id")


#: Queries, and entries of their point tables, up to which every task holds them.
MOST_QUERIES, MOST_ENTRIES = 4096, 2_000_000


def best_articles(
    queries: DataFrame,
    articles: DataFrame,
    k: int,
    *,
    phrases=K.PHRASES,
    boosts=K.BOOSTS,
    cited: str = K.CITED,
    stopwords=tuple(K.STOPWORDS),
) -> DataFrame:
    """(query_id, article_id, load_seq, code, number, score, rank): the best k of every query, as ``top_k`` of ``score_articles`` gives them."""
    q = queries.select("query_id", X.normalize("text").alias("q")).withColumn("t", X.tokens(F.col("q"), stopwords)).where(F.size("t") > 0)
    any_of = lambda triggers: reduce(lambda x, y: x | y, (F.contains(F.col("q"), F.lit(t)) for t in triggers))
    none = F.array().cast("array<string>")
    told = q.select(
        "query_id",
        "t",
        F.filter(F.array(*map(F.lit, phrases)), lambda x: F.contains(F.col("q"), x)).alias("phrases") if phrases else none.alias("phrases"),
        F.array_compact(F.array(*(F.when(any_of(t), F.lit(i)) for i, (*_, t) in enumerate(boosts)))).alias("boosts") if boosts else F.array().cast("array<int>").alias("boosts"),
        (F.array_distinct(F.regexp_extract_all("q", F.lit("(?Ud)" + cited), F.lit(1))) if cited else none).alias("numbers"),
    )
    size = told.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("t") + F.size("phrases") + F.size("boosts") + F.size("numbers")), F.lit(0))).first()
    if size[0] > MOST_QUERIES or size[1] > MOST_ENTRIES:
        return top_k(score_articles(queries, articles, phrases=phrases, boosts=boosts, cited=cited, stopwords=stopwords), "query_id", "load_seq", k)
    known = told.orderBy("query_id").collect()  # bounded by MOST_QUERIES and MOST_ENTRIES
    hay = F.concat_ws(" ", X.empty("title"), X.empty("body"))
    normal = articles.select("article_id", "load_seq", "code", F.col("number").cast("string").alias("number"), X.normalize("title").alias("title"), X.normalize(hay).alias("hay"))
    rows = normal.select(
        "article_id",
        "load_seq",
        "code",
        "number",
        X.tokens(F.col("hay"), stopwords).alias("tokens"),
        X.tokens(F.col("title"), stopwords).alias("title_tokens"),
        (F.filter(F.array(*map(F.lit, phrases)), lambda x: F.contains(F.col("hay"), x)) if phrases else none).alias("phrases"),
    )
    kinds = {c: articles.select(F.col(a).alias(c)).schema[c].dataType.simpleString() for c, a in (("article_id", "article_id"), ("load_seq", "load_seq"), ("code", "code"))}
    points = {"tokens": {}, "phrases": {}, "numbers": {}}
    for i, r in enumerate(known):
        for kind, values in (("tokens", r["t"]), ("phrases", r["phrases"]), ("numbers", r["numbers"])):
            for v in values:
                points[kind].setdefault(v, []).append(i)
    rules = [(code, number, n, [i for i, r in enumerate(known) if j in r["boosts"]]) for j, (code, number, n, _) in enumerate(boosts)]
    table = queries.sparkSession.sparkContext.broadcast((points, rules, [r["query_id"] for r in known]))  # bounded as above

    def run(batches):
        import numpy as np
        import pyarrow as pa

        points, rules, ids = table.value
        each = {kind: {v: np.array(x) for v, x in of.items()} for kind, of in points.items()}

        def scores(tokens, title, found, code, number):
            out = np.zeros(len(ids), "i8")
            for kind, values, n in (("tokens", tokens, 1), ("tokens", title, K.TITLE_POINTS), ("phrases", found, K.PHRASE_POINTS), ("numbers", [number], K.NUMBER_POINTS)):
                hits = [each[kind][v] for v in values or () if v in each[kind]]
                if hits:
                    out += n * np.bincount(np.concatenate(hits), minlength=len(ids))
            for rule_code, rule_number, n, of in rules:
                if code == rule_code and (rule_number is None or number == rule_number):
                    out[of] += n
            return out

        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            batch = batch.sort_by("load_seq")
            columns = [batch.column(c).to_pylist() for c in ("tokens", "title_tokens", "phrases", "code", "number")]
            table_ = np.stack([scores(*row) for row in zip(*columns, strict=True)])
            best = np.argsort(-table_, axis=0, kind="stable")[:k]  # ties stand in the order of load_seq
            of = np.broadcast_to(np.arange(len(ids)), best.shape)
            good = table_[best, of] > 0
            at, of = best[good], of[good]
            kept = batch.take(pa.array(at))
            cols = [pa.array([ids[i] for i in of.tolist()], id_type), *(kept.column(c) for c in ("article_id", "load_seq", "code", "number")), pa.array(table_[at, of])]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "article_id", "load_seq", "code", "number", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    query_type = queries.schema["query_id"].dataType
    id_type = to_arrow_type(query_type)
    schema = f"query_id {query_type.simpleString()}, article_id {kinds['article_id']}, load_seq {kinds['load_seq']}, code {kinds['code']}, number string, score long"
    return top_k(rows.mapInArrow(run, schema), "query_id", "load_seq", k)


def best_overlap(queries: DataFrame, articles: DataFrame, query_id: str, article_id: str, k: int, stopwords=tuple(K.STOPWORDS)) -> DataFrame:
    """(query, article, score, rank): ``top_k`` of ``overlap``, ties in the order of the article's id."""
    q = queries.select(F.col(query_id).alias("query_id"), "text")
    none = F.lit(None).cast("string")
    a = articles.select(F.col(article_id).alias("article_id"), F.col(article_id).alias("load_seq"), none.alias("code"), none.alias("number"), none.alias("title"), F.col("text").alias("body"))
    best = best_articles(q, a, k, phrases=(), boosts=(), cited="", stopwords=stopwords)
    return best.select(F.col("query_id").alias(query_id), F.col("article_id").alias(article_id), "score", "rank")


def articles_by_number(requests: DataFrame, articles: DataFrame, code: str = "blhs") -> DataFrame:
    """Requests (query_id, ord, number) answered from one code: first request of a number counts, last article of a number wins."""
    own = articles.where(F.col("code") == code).groupBy(F.lower(F.col("number").cast("string")).alias("n")).agg(
        F.max_by("article_id", "load_seq").alias("article_id")
    )
    asked = requests.select("query_id", "ord", F.lower(F.trim(F.col("number").cast("string"))).alias("n")).where("n <> ''")
    asked = asked.groupBy("query_id", "n").agg(F.min("ord").alias("ord"))
    return asked.join(own, "n").select("query_id", "ord", "article_id")


def pinned_top_k(scores: DataFrame, pins: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, article_id, pinned): pins in request order, then those of the best k that aren't pinned; more than k in all may come.

    ``scores`` may be ranked already.
    """
    ranked = scores.where(F.col("rank") <= k) if "rank" in scores.columns else top_k(scores, "query_id", "load_seq", k)
    rest = ranked.join(pins.select("query_id", "article_id"), ["query_id", "article_id"], "left_anti")
    both = pins.select("query_id", "article_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("o")).unionByName(
        rest.select("query_id", "article_id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("o"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "o"))
    return both.select("query_id", rank.alias("rank"), "article_id", (F.col("part") == 0).alias("pinned"))


def citations(facts: DataFrame) -> DataFrame:
    """Facts (query_id, facts as JSON): requested numbers in order, cited ones first, then those that are always pinned."""
    raw = F.get_json_object("facts", "$.dieu_luat_blhs_duoc_nhac_toi")
    found = F.when(raw.rlike(r"^\s*\["), F.transform(F.from_json(raw, "array<string>"), lambda x: F.regexp_replace(x, r"(?s)^\D*(\d+[a-zđ]?).*$", "$1")))
    found = F.coalesce(found, F.regexp_extract_all(raw, F.lit(r"\d+[a-zđ]?"), F.lit(0)), F.array().cast("array<string>"))
    wanted = F.concat(found, F.array(*map(F.lit, K.ALWAYS_PINNED)))
    return facts.select("query_id", F.posexplode(wanted).alias("ord", "number"))


def fact_query(facts: DataFrame, fields=K.CRIMINAL_FIELDS) -> DataFrame:
    """Query text from the fields of parsed facts; text that isn't an object is the query itself."""
    whole = F.col("facts").rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json("facts").isNotNull()
    picked = F.concat_ws(" ", *(X.empty(F.get_json_object("facts", f"$.{f}")) for f in fields))
    return facts.select("query_id", F.when(whole, picked).otherwise(F.col("facts")).alias("text"))


def format_articles(ranked: DataFrame, articles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): the ranked articles as one text, or the mark that none was found."""
    head = "### NGUỒN: DỮ LIỆU LUẬT ĐÃ NẠP SẴN (đáng tin cậy, đã tách từ văn bản chính thức)\n"
    none = "[KHÔNG TÌM THẤY ĐIỀU LUẬT LIÊN QUAN TRONG DỮ LIỆU CÓ SẴN]"
    chapter = F.when(X.empty("chuong") != "", F.concat(F.lit(" ("), F.col("chuong"), F.lit(")"))).otherwise(F.lit(""))
    block = F.concat(F.lit("["), X.empty("law"), F.lit("] Điều "), F.col("number"), chapter, F.lit("\n"), F.col("body"))
    rows = ranked.join(articles.select("article_id", block.alias("block")), "article_id")
    joined = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    text = F.array_join(F.concat(F.array(F.lit(head)), F.col("b.block")), "\n\n---\n\n")
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.when(F.col("b").isNull(), F.lit(none)).otherwise(text).alias("context")
    )
