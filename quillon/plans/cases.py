"""A case file from text to draft, as one plan over a table of cases. The text generator is an injected function.

Steps that rules can decide never reach the generator: a case routed by rule isn't sent to be classified, and a civil proposal report becomes
its statement directly. Every call goes through the memo table, so a second run sends nothing that was answered before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X
from quillon.operators import assemble, audit, facts, memo, retrieval

MEMO = "key string, response string"
ASK = {"classify": "Classify the case.", "extract": "Extract the facts as JSON.", "draft": "Draft the document."}


def ask(rows: DataFrame, step: str, user, known: DataFrame, call: Callable[[str, str], str], name: str, work: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the answer as ``name``; and the memo with the new answers. Both are stored below ``work``, which ends their lineage."""
    keyed = rows.withColumns({"system": F.lit(ASK[step]), "user": user})
    keyed = keyed.withColumn("key", memo.memo_key(F.lit("injected"), F.lit(step), F.lit(None).cast("string"), F.col("system"), F.col("user")))
    keyed = memo.stored(keyed, f"{work}/asked_{step}")
    answered, new = memo.answer(keyed, known, call, f"{work}/memo_{step}")
    answered = answered.withColumn(name, X.empty("response")).select(*rows.columns, name)
    return memo.stored(answered, f"{work}/answered_{step}"), known.unionByName(new)


def classify(cases: DataFrame, known: DataFrame, call, work: str) -> tuple[DataFrame, DataFrame]:
    """Cases (case_id, text) with ``case_type``: by rule, else by the generator; what it says counts as civil unless it says criminal."""
    ruled = cases.withColumn("case_type", X.case_type("text"))
    open_, known = ask(ruled.where("case_type is null").drop("case_type"), "classify", F.col("text"), known, call, "said", work)
    criminal = F.upper("said").rlike("HINH_SU|HÌNH SỰ")
    decided = open_.withColumn("case_type", F.when(criminal, K.CRIMINAL).otherwise(K.CIVIL)).drop("said")
    return ruled.where("case_type is not null").unionByName(decided), known


def law_context(rows: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """Rows (case_id, case_type, facts) with ``laws``: ranked articles as text; criminal cases get twice as many and their citations in front."""
    q = rows.select(F.col("case_id").alias("query_id"), "case_type", "facts")
    criminal, civil = q.where(F.col("case_type") == K.CRIMINAL), q.where(F.col("case_type") != K.CRIMINAL)
    text = retrieval.fact_query(criminal, K.CRIMINAL_FIELDS).unionByName(retrieval.fact_query(civil, K.CIVIL_FIELDS))
    scores = retrieval.score_articles(text, articles)
    pins = retrieval.articles_by_number(retrieval.citations(criminal), articles)
    pinned = retrieval.pinned_top_k(scores.join(criminal.select("query_id"), "query_id", "left_semi"), pins, max(k, 20))
    plain = retrieval.top_k(scores.join(civil.select("query_id"), "query_id", "left_semi"), "query_id", "load_seq", k)
    ranked = pinned.select("query_id", "rank", "article_id").unionByName(plain.select("query_id", "rank", "article_id"))
    out = retrieval.format_articles(ranked, articles, q).select(F.col("query_id").alias("case_id"), F.col("context").alias("laws"))
    return rows.join(out, "case_id", "left")


def finish(rows: DataFrame) -> DataFrame:
    """Drafts (case_type, facts, story, draft) to ``final`` and ``appendix``."""
    rows = rows.withColumn("__parts", audit.split_check("draft"))
    rows = rows.withColumn("appendix", F.coalesce("__parts.appendix", audit.code_check(F.col("__parts.document"))))
    rows = rows.withColumn("__kept", audit.keep_suggestions(audit.legal_terms(F.col("__parts.document")), F.col("draft")))
    criminal = assemble.default_wording(assemble.insert_narrative(assemble.trim_indictment("__kept"), F.col("story")))
    civil = assemble.strip_markdown(assemble.trim_statement("__kept"))
    return rows.withColumn("final", F.when(F.col("case_type") == K.CRIMINAL, criminal).otherwise(civil)).drop("__parts", "__kept")


def run_cases(cases: DataFrame, articles: DataFrame, call: Callable[[str, str], str], work: str, known: DataFrame | None = None, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(case_id, case_type, direct, facts, laws, draft, final, appendix) of every case with at least 50 characters; and the memo afterwards.

    ``work``: a folder of this run that all executors share.
    """
    spark = cases.sparkSession
    known = known if known is not None else spark.createDataFrame([], MEMO)
    cases = cases.select("case_id", "text").where(F.length(X.strip(X.empty("text"))) >= least)
    typed, known = classify(cases, known, call, work)
    built = memo.stored(assemble.build_statements(memo.stored(assemble.parse_reports(typed), f"{work}/parsed")), f"{work}/built")
    built = built.withColumn("direct", (F.col("case_type") == K.CIVIL) & F.col("statement").isNotNull())
    direct = built.where("direct").select(
        "case_id", "case_type", "direct",
        F.to_json(F.struct(F.lit("dân sự").alias("loai_vu_viec"), F.col("report.ten_vu_an").alias("ten_vu_an"), F.col("report.toa_an").alias("toa_an_thu_ly"), F.col("report.ksv").alias("kiem_sat_vien"))).alias("facts"),
        F.lit("").alias("laws"), F.col("statement").alias("draft"), F.col("statement").alias("final"), audit.code_check("statement").alias("appendix"),
    )
    rest = built.where(~F.coalesce("direct", F.lit(False))).select("case_id", "case_type", "text")
    rest, known = ask(rest, "extract", F.concat_ws("\n", "case_type", "text"), known, call, "said", work)
    rest = rest.withColumn("facts", facts.clean_json("said")).withColumn("story", X.empty(facts.apply_defaults("facts", "text")["narrative"])).drop("said")
    rest = memo.stored(law_context(memo.stored(rest, f"{work}/facts"), articles), f"{work}/laws")
    rest, known = ask(rest, "draft", F.concat_ws("\n", "case_type", "facts", "laws"), known, call, "draft", work)
    done = finish(rest).withColumn("direct", F.lit(False))
    return direct.unionByName(done.select(*direct.columns)), known
