"""Page decisions: the best text layer, its judgement, what needs a second reading, and warnings a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X

#: Least characters of a page, share of the page under an image from which it is a scan.
MIN_CHARS, SCAN_COVERAGE = 25, 0.5
#: Dots an inch, contrast and sharpness below which an image is doubtful.
LOW_DPI, FAINT, BLURRY = 140, 22.0, 0.40


def layer_score(c: Column | str, letters: str = K.VIETNAMESE) -> Column:
    """Points of a text, fewer the more bad characters it has; a text without words keeps some of its -1."""
    return X.score_text(c, letters) * (F.lit(1.0) - F.least(F.lit(0.9), X.text_stats(c, letters)["bad_ratio"] * 10))


def best_layer(layers: DataFrame, keys: list[str], letters: str = K.VIETNAMESE) -> DataFrame:
    """Rows (keys, ord, engine, text): the best of each page; equal scores go to the longer text, then to the earlier engine.

    A layer must beat -1 or be longer than nothing at that score; pages where none does have an empty engine and text.
    """
    scored = layers.withColumns({"score": layer_score("text", letters), "len": F.length(X.empty("text"))})
    best = F.max_by(F.struct("engine", "text", "score", "len"), F.struct("score", "len", -F.col("ord")))
    out = scored.groupBy(*keys).agg(best.alias("b"))
    good = (F.col("b.score") > -1) | ((F.col("b.score") == -1) & (F.col("b.len") > 0))
    return out.select(*keys, F.when(good, F.col("b.engine")).otherwise("").alias("engine"), F.when(good, F.col("b.text")).otherwise("").alias("text"))


def judge(c: Column | str, coverage: Column, letters: str = K.VIETNAMESE) -> Column:
    """empty, garbage, suspect or good; the first rule that holds decides."""
    s = X.text_stats(c, letters)
    scanned = coverage >= SCAN_COVERAGE
    return (
        F.when(s["chars"] < MIN_CHARS, "empty")
        .when(s["bad_ratio"] > 0.05, "garbage")
        .when(scanned & ((s["words"] < 8) | (X.letters(c) < s["chars"] * 0.4)), "garbage")
        .when((s["words"] >= 40) & (s["viet_ratio"] < 0.15), "suspect")
        .otherwise("good")
    )


def reading_issues(c: Column | str, confidence: Column, engine: Column, letters: str = K.VIETNAMESE) -> Column:
    """Codes of what is doubtful about a recognised text."""
    s = X.text_stats(c, letters)
    least = F.when(engine == "Tesseract", F.lit(0.88)).otherwise(F.lit(0.75))
    return F.array_compact(
        F.array(
            F.when((confidence < least) & (s["chars"] > 20), "low_confidence"),
            F.when(s["unreadable_marks"] > 0, "unreadable"),
            F.when((s["words"] >= 40) & (s["viet_ratio"] < 0.25), "few_marks"),
            F.when(s["bad_ratio"] > 0.03, "bad_characters"),
        )
    )


def image_issues(dpi: Column, contrast: Column, sharpness: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(dpi < LOW_DPI, "low_dpi"),
            F.when(contrast < FAINT, "faint"),
            F.when((contrast >= 3) & (sharpness < BLURRY), "blurred"),
        )
    )


def cap_pages(pages: DataFrame, group: str, order: str, needs: Column, most: int) -> DataFrame:
    """``method``: text for pages that need no second reading, ocr for the first ``most`` that do, skipped for the others."""
    flagged = pages.withColumn("__needs", needs)
    n = F.sum(F.col("__needs").cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    method = F.when(~F.col("__needs"), "text").when(n <= most, "ocr").otherwise("skipped")
    return flagged.withColumn("method", method).drop("__needs")


def weighted_confidence(words: DataFrame, group: str, length: Column, confidence: Column) -> DataFrame:
    """(group, confidence): mean weighted by length; negative confidences don't count, null where nothing does."""
    ok = confidence >= 0
    total, weight = F.sum(F.when(ok, length * confidence)), F.sum(F.when(ok, length))
    return words.groupBy(group).agg((total.cast("double") / F.nullif(weight.cast("double"), F.lit(0.0))).alias("confidence"))


def ordered_text(rows: DataFrame, group: str, order: list[str], text: str, joiner: str, name: str = "text") -> DataFrame:
    """(group, text): pieces in order, empty ones dropped."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__t")))), lambda x: x["__t"] != "")
    return rows.groupBy(group).agg(F.array_join(F.transform(kept, lambda x: x["__t"]), joiner).alias(name))


def page_list(islands: DataFrame, group: str) -> DataFrame:
    """(group, pages): runs as "1–3, 5, 7–8"."""
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("–", "lo", "hi"))
    runs = islands.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("lo", one.alias("t")))).alias("r"))
    return runs.select(group, F.array_join("r.t", ", ").alias("pages"))


def file_summary(pages: DataFrame, group: str) -> DataFrame:
    """Per file: recognised pages, pages with problems, and whether someone should compare it with the original."""
    numbers = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("number"))))
    problem = (F.size("issues") > 0) | F.col("method").isin("failed", "skipped")
    out = pages.groupBy(group).agg(numbers(F.col("method") == "ocr").alias("ocr_pages"), numbers(problem).alias("problem_pages"))
    return out.withColumn("needs_review", (F.size("ocr_pages") > 0) | (F.size("problem_pages") > 0))


def cluster_boxes(boxes: DataFrame) -> DataFrame:
    """Recognised boxes (page, top, bottom, left, text, conf) to lines of a page: a box starts a new line if its middle is further than 0.6 of
    its height from the running mean of the line; a fold over the boxes sorted by their middle."""
    box = F.struct(((F.col("top") + F.col("bottom")) / 2).alias("mid"), (F.col("bottom") - F.col("top")).alias("h"), "left", "text")
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("b"))
    line = "struct<mid:double,n:int,boxes:array<struct<left:double,text:string>>>"
    start = F.array().cast(f"array<{line}>")

    def step(done, x):
        last = F.element_at(done, -1)
        item = F.struct(x["left"].cast("double").alias("left"), x["text"].alias("text"))
        fresh = F.struct(x["mid"].cast("double").alias("mid"), F.lit(1).alias("n"), F.array(item).alias("boxes"))
        grown = F.struct(((last["mid"] * last["n"] + x["mid"]) / (last["n"] + 1)).alias("mid"), (last["n"] + 1).alias("n"), F.concat(last["boxes"], F.array(item)).alias("boxes"))
        same = (F.size(done) > 0) & (F.abs(x["mid"] - F.get(done, F.size(done) - 1)["mid"]) <= x["h"] * 0.6)
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.when(F.size(done) > 0, grown)))).otherwise(F.concat(done, F.array(fresh)))

    lines = F.aggregate("b", start, step)
    texts = F.transform(lines, lambda x: F.array_join(F.transform(F.array_sort(x["boxes"]), lambda y: y["text"]), " "))
    return pages.select("page", F.array_join(texts, "\n").alias("text"))


def decide_pages(layers: DataFrame, images: DataFrame, readings: DataFrame, mode: str = "auto", most: int = 60) -> DataFrame:
    """Every page's final text and how it came about.

    layers: file, page, ord, engine, text (candidates of the text layer). images: file, page, coverage, blank (no mark on the page).
    readings: file, page, engine, text, confidence, error (second readings made outside; only those a page needs are used).
    mode: auto, always or never. The order of decisions: best layer, code page, cleaning, judgement, need of a second reading, blank pages, cap,
    and whether the second reading is better than what was there.
    """
    best = best_layer(layers, ["file", "page"]).withColumn("fixed", X.fix_legacy("text"))
    p = images.select("file", "page", "coverage", "blank").join(best, ["file", "page"], "left")
    p = p.withColumn("layer", X.clean_text("fixed.text")).withColumn("kind", judge("layer", F.col("coverage")))
    scanned = F.col("coverage") >= SCAN_COVERAGE
    plain = (F.col("kind") == "good") | ((F.col("kind") == "suspect") & ~scanned)
    needs = {"always": F.lit(True), "never": F.lit(False)}.get(mode, ~plain)
    p = p.withColumn("needs", needs).withColumn("old", F.when((F.col("kind") == "empty") & F.lit(mode != "always"), "").otherwise(F.col("layer")))
    empty_page = F.col("needs") & F.lit(mode != "always") & (F.col("old") == "") & F.coalesce("blank", F.lit(False))
    p = p.withColumn("white", empty_page)
    p = cap_pages(p, "file", "page", F.col("needs") & ~F.col("white"), most)
    r = readings.select("file", "page", F.col("engine").alias("r_engine"), F.col("text").alias("r_text"), "confidence", F.col("error").alias("r_error"))
    p = p.join(r, ["file", "page"], "left")
    read = F.col("method") == "ocr"
    failed = read & (F.col("r_text").isNull() | (X.empty("r_error") != ""))
    worse = read & ~failed & F.lit(mode != "always") & (F.col("old") != "") & (X.score_text("r_text") < X.score_text("old"))
    taken = read & ~failed & ~worse
    none_left = failed & (F.col("old") == "")
    method = (
        F.when(F.col("white"), "blank")
        .when(none_left, "failed")
        .when(taken, "ocr")
        .when(F.col("method") == "skipped", "skipped")
        .when((F.col("kind") == "empty") & ~F.col("needs"), "blank")
        .otherwise("text")
    )
    text = F.when(taken, F.col("r_text")).when(F.col("white") | none_left | ((F.col("kind") == "empty") & ~F.col("needs")), "").when(F.col("needs"), F.col("old")).otherwise(F.col("layer"))
    issues = F.array_compact(
        F.array(
            F.when(~taken & (F.col("fixed.encoding") == "VNI"), "legacy_encoding"),
            F.when(~taken & ~F.col("white") & (F.col("kind") == "garbage"), "garbage_layer"),
            F.when(~taken & (F.col("kind") == "suspect"), "suspect_layer"),
            F.when(~taken & (F.col("kind") == "good") & scanned, "scanner_layer"),
            F.when((method == "blank") & ~F.col("white") & ~F.coalesce("blank", F.lit(False)), "unread_image"),
            F.when(failed, "reading_failed"),
            F.when(worse, "reading_not_better"),
            F.when(method == "skipped", "over_the_limit"),
            F.when(taken & (F.col("r_text") == ""), "nothing_read"),
        )
    )
    reading = F.when(taken, reading_issues("r_text", F.col("confidence"), F.col("r_engine"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        "file",
        "page",
        method.alias("method"),
        F.when(taken, F.col("r_engine")).otherwise(X.empty("engine")).alias("engine"),
        text.alias("text"),
        F.when(taken, F.col("confidence")).alias("confidence"),
        F.concat(issues, reading).alias("issues"),
    )


def read_files(pages: DataFrame) -> DataFrame:
    """Decided pages to files: text in page order, pages by method, and whether someone should look."""
    text = ordered_text(pages.withColumnRenamed("text", "t"), "file", ["page"], "t", "\n\n")
    info = file_summary(pages.select("file", F.col("page").alias("number"), "method", "issues"), "file")
    return text.withColumn("text", X.clean_text("text")).join(info, "file")
