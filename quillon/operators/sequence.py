"""Ordered rows: headings carried forward, lines joined again, gaps, islands, order and duplicates.

Numbers of one group are dealt to buckets of consecutive numbers, so windows over numbers see a bucket, or a row or two a bucket of a
whole group. Windows over the rows of a document, a conversation or a source (headings, lines, order) see all of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X

BUCKET = 1 << 16


def carry_forward(df: DataFrame, group: str, order: list, value: Column, when: Column, name: str) -> DataFrame:
    """``name``: the value at the last row so far on which ``when`` holds."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def segments(df: DataFrame, group: str, order: str, starts: Column, name: str = "segment") -> DataFrame:
    """Running number of the segment a row belongs to; the first row of a group always starts one."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.row_number().over(w) == 1
    df = df.withColumn("__start", (first | starts).cast("int"))
    return df.withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def islands(numbers: DataFrame, group: str, number: str, bucket: int = BUCKET) -> DataFrame:
    """(group, lo, hi): maximal runs of consecutive distinct numbers."""
    n = numbers.select(group, F.col(number).cast("long").alias("n")).where("n is not null").distinct()
    n = n.withColumn("__b", F.floor(F.col("n") / bucket))
    order = F.row_number().over(Window.partitionBy(group, "__b").orderBy("n"))
    runs = n.withColumn("__d", F.col("n") - order).groupBy(group, "__b", "__d").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    touches = (F.pmod("lo", F.lit(bucket)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(bucket)) == 0)
    inner = runs.where(~touches).select(group, "lo", "hi")
    w = Window.partitionBy(group).orderBy("lo")
    edge = runs.where(touches).withColumn("__new", F.coalesce((F.lag("hi").over(w) + 1 != F.col("lo")).cast("int"), F.lit(1)))
    edge = edge.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edge.groupBy(group, "__i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(group, "lo", "hi")
    return inner.unionByName(merged)


def gaps(found: DataFrame, group: str, bucket: int = BUCKET) -> DataFrame:
    """(group, lo, hi): what lies between islands. The next island is looked for in the bucket of this one, then in the next bucket that has any."""
    i = found.withColumn("__b", F.floor(F.col("lo") / bucket))
    inside = F.lead("lo").over(Window.partitionBy(group, "__b").orderBy("lo"))
    firsts = i.groupBy(group, "__b").agg(F.min("lo").alias("__first"))  # a row a bucket
    firsts = firsts.withColumn("__then", F.lead("__first").over(Window.partitionBy(group).orderBy("__b"))).drop("__first")
    i = i.withColumn("__next", inside).join(firsts, [group, "__b"]).withColumn("__next", F.coalesce("__next", "__then"))
    return i.where("__next is not null").select(group, (F.col("hi") + 1).alias("lo"), (F.col("__next") - 1).alias("hi"))


def missing_numbers(between: DataFrame, group: str, step: int = 10_000) -> DataFrame:
    """Every number of every gap; long gaps are cut first, so that no row holds more than ``step`` numbers."""
    cut = between.select(group, "hi", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("__lo"))
    return cut.select(group, F.explode(F.sequence("__lo", F.least("hi", F.col("__lo") + (step - 1)))).alias("number"))


def classify_gaps(between: DataFrame, rows: DataFrame, group: str, number: str, marked: Column, *, own: bool = True, bucket: int = BUCKET) -> DataFrame:
    """``repealed``: whether a row from just before the gap up to its end, the next heading excluded, is marked.

    That is so if the last mark up to the gap's end isn't before its start. The last mark is looked for in the bucket of the gap's end, then in the last bucket
    before that has any, so the length of a gap costs nothing. ``own``: rows carry the group and count for it alone; else they count for every group.
    """
    keys = [group] if own else []
    marks = rows.where(marked).select(*keys, F.col(number).cast("long").alias("__n")).where("__n is not null").distinct()
    ends = between.select(*([] if own else [group]), *keys, F.col("hi").alias("__n"), "lo", "hi")
    none = [F.lit(None).cast("long").alias(c) for c in ("lo", "hi")]
    extra = [] if own else [F.lit(None).cast(between.schema[group].dataType).alias(group)]
    both = ends.unionByName(marks.select(*extra, *keys, "__n", *none)).withColumn("__b", F.floor(F.col("__n") / bucket))
    mark = F.when(F.col("lo").isNull(), F.col("__n"))
    inside = F.max(mark).over(Window.partitionBy(*keys, "__b").orderBy("__n").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = both.groupBy(*keys, "__b").agg(F.max(mark).alias("__m")).withColumn("__before", F.max("__m").over(before)).drop("__m")  # a row a bucket
    found = both.withColumn("__inside", inside).where("lo is not null").join(buckets, [*keys, "__b"])
    return found.select(group, "lo", "hi", F.coalesce(F.coalesce("__inside", "__before") >= F.col("lo") - 1, F.lit(False)).alias("repealed"))


def out_of_order(df: DataFrame, group: str, order: list, key) -> DataFrame:
    """Rows whose key is smaller than that of the row before."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__before", before).where(F.col("__before") > key).drop("__before")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def modal(df: DataFrame, group: str, value: Column, order: list[str]) -> DataFrame:
    """(group, mode, n): the commonest value; of equal ones the first seen."""
    counted = df.select(group, value.alias("v"), F.struct(*order).alias("o")).groupBy(group, "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "o"))
    return counted.withColumn("r", best).where("r = 1").select(group, F.col("v").alias("mode"), "n")


def top_mode_max(df: DataFrame, group: str, value: Column, order: list[str], most: int = 3, share: float = 0.05) -> DataFrame:
    """(group, margin): the largest of the commonest values that hold at least a share of all rows; null if none does."""
    counted = df.select(group, value.alias("v"), F.struct(*order).alias("o")).groupBy(group, "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    w = Window.partitionBy(group)
    ranked = counted.withColumn("all", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), "o")))
    good = (F.col("r") <= most) & (F.col("n") >= F.col("all") * share)
    return ranked.groupBy(group).agg(F.max(F.when(good, F.col("v"))).alias("margin"))


def parse_articles(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (source_id, pos, text) to articles with the headings that hold for them.

    Lines are classed in the order article, heading, title, body. A title (capitals) right after a heading belongs to it. A heading ends all
    lower levels but not the article before it: an ordinary line after a heading goes to that article.
    """
    w = Window.partitionBy("source_id").orderBy("pos")
    past, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    df = paragraphs.select("source_id", "pos", "text")
    df = df.withColumn("stop", F.max(F.startswith("text", F.lit(K.END_OF_LAW)).cast("int")).over(so_far)).where("stop = 0").drop("stop")
    kind = F.when(F.col("text").rlike(X.U + K.ARTICLE), "article").otherwise(
        F.coalesce(X.structure_level("text"), F.when(X.is_title_line("text"), "title").otherwise("body"))
    )
    df = df.withColumn("kind", kind)
    df = df.withColumn("before", F.last(F.when(F.col("kind") != "title", F.struct("pos", "kind")), ignorenulls=True).over(past))
    levels = F.array(*map(F.lit, K.RANKS))
    absorbed = (F.col("kind") == "title") & F.coalesce(F.array_contains(levels, F.col("before.kind")), F.lit(False))
    df = df.withColumn("kind", F.when(absorbed, "absorbed").when(F.col("kind") == "title", "body").otherwise(F.col("kind")))
    titles = df.where("kind = 'absorbed'").groupBy("source_id", F.col("before.pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    titles = titles.select("source_id", "pos", F.array_join(F.col("t.text"), " ").alias("titles"))
    df = df.join(titles, ["source_id", "pos"], "left")
    plain = F.col("text").rlike(r"[.:]$") | F.contains("text", F.lit(" – "))
    full = F.when(F.col("titles").isNull(), F.col("text")).otherwise(F.concat("text", F.when(plain, F.lit(" ")).otherwise(F.lit(" – ")), "titles"))
    df = df.withColumn("full", full)
    for level in K.RANKS:
        df = df.withColumn("l_" + level, F.last(F.when(F.col("kind") == level, F.struct("pos", F.col("full").alias("text"))), ignorenulls=True).over(so_far))
    df = df.withColumn("article", F.sum((F.col("kind") == "article").cast("int")).over(so_far))
    df = df.where("article > 0 and kind in ('article', 'body')")
    heads = []
    for i, level in enumerate(K.RANKS):
        live = F.col(f"l_{level}.pos") > F.greatest(F.lit(-1).cast("long"), F.lit(-1).cast("long"), *(F.coalesce(F.col(f"l_{up}.pos"), F.lit(-1)) for up in K.RANKS[:i]))
        heads.append(F.when(live, F.col(f"l_{level}.text")).otherwise(F.lit("")).alias(level))
    df = df.withColumn("heads", F.struct(*heads))
    line = F.when(F.col("kind") == "article", X.article_title("text")).otherwise(F.col("text"))
    out = df.groupBy("source_id", "article").agg(
        F.min_by(F.struct(X.article_number("text").alias("dieu_so"), X.article_title("text").alias("tieu_de"), "heads"), "pos").alias("a"),
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"),
    )
    return out.select(
        "source_id",
        "article",
        F.col("a.dieu_so").alias("dieu_so"),
        F.col("a.tieu_de").alias("tieu_de"),
        F.array_join("lines.line", "\n").alias("noi_dung"),
        *(F.col(f"a.heads.{level}").alias(level) for level in K.RANKS),
    )


def rejoin_lines(rows: DataFrame) -> DataFrame:
    """Printed lines (source_id, ord, text, x0, x1, bold) to paragraphs (source_id, pos, text).

    A line goes on if the one before ran to the right margin or stopped in mid-sentence, unless its weight changes or it starts an
    article, a heading or, after a sentence's end, a clause.
    """
    rows = rows.where("text <> ''")
    left = modal(rows, "source_id", F.bround("x0"), ["ord"]).select("source_id", F.col("mode").alias("left"))
    right = top_mode_max(rows, "source_id", F.bround("x1"), ["ord"])
    raw = rows.groupBy("source_id").agg(F.max("x1").alias("widest"), F.count(F.lit(1)).alias("n"))
    margins = left.join(right, "source_id").join(raw, "source_id").select(
        "source_id", "left", F.when(F.col("n") > 20, F.col("margin")).otherwise(F.col("widest")).alias("right")
    )
    df = rows.join(margins, "source_id")
    flush = F.abs(F.col("x0") - F.col("left")) <= 3
    runs_on = (flush & (F.col("x1") >= F.col("right") - 6)) | (~flush & X.is_title_line("text") & (F.col("x1") >= F.col("right") - 30))
    df = df.withColumns({"runs_on": runs_on, "ended": F.rtrim("text").rlike(r"[.;:]$"), "clause": F.col("text").rlike(X.U + K.CLAUSE)})
    w = Window.partitionBy("source_id").orderBy("ord")
    prev = lambda c: F.lag(c).over(w)
    mid = ~prev("ended") & F.substring("text", 1, 1).rlike(r"^\p{Ll}") & ~F.col("clause")
    new = (
        ~(prev("runs_on") | mid)
        | (F.col("bold") != prev("bold"))
        | F.col("text").rlike(X.U + K.ARTICLE)
        | X.structure_level("text").isNotNull()
        | (F.col("clause") & prev("ended"))
    )
    df = segments(df, "source_id", "ord", new, "pos")
    out = df.groupBy("source_id", F.col("pos").cast("long").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return out.select("source_id", "pos", F.array_join("t.text", " ").alias("text"))


def audit(articles: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(source_id, finding, item): lettered, repealed, missing, duplicate, out of order, unparsed and short articles."""
    a = articles.withColumn("k", X.number_key("dieu_so"))
    item = lambda df, name, c: df.select("source_id", F.lit(name).alias("finding"), c.cast("string").alias("item"))
    plain = a.where("dieu_so rlike '^[0-9]+$'").withColumn("n", F.col("k.n").cast("long"))
    ends = plain.groupBy("source_id").agg(F.min_by("n", "article").alias("first"), F.max_by("n", "article").alias("last"))
    between = gaps(islands(plain, "source_id", "n"), "source_id").join(ends, "source_id").where("lo >= first and hi <= last").select("source_id", "lo", "hi")
    heads = paragraphs.select("source_id", "pos", F.regexp_extract("text", r"^Điều (\d+)\.", 1).try_cast("long").alias("n")).where("n is not null")
    at = heads.groupBy("source_id", "n").agg(F.min("pos").alias("pos"))
    b, e = at.select("source_id", (F.col("n") + 1).alias("lo"), F.col("pos").alias("p0")), at.select("source_id", (F.col("n") - 1).alias("hi"), F.col("pos").alias("p1"))
    spans = between.join(b, ["source_id", "lo"], "left").join(e, ["source_id", "hi"], "left")
    marks = paragraphs.where(F.lower("text").rlike("|".join(K.REPEALED))).groupBy("source_id").agg(F.collect_list("pos").alias("marks"))
    spans = spans.join(marks, "source_id", "left").withColumn(
        "repealed", F.coalesce(F.exists("marks", lambda p: (p >= F.col("p0")) & (p < F.col("p1"))), F.lit(False))
    )
    numbers = spans.select("source_id", "repealed", F.explode(F.sequence("lo", "hi")).alias("n"))
    doubled = duplicates(a, ["source_id", "dieu_so"])
    parts = [
        item(a.where("not dieu_so rlike '^[0-9]+$'"), "lettered", F.col("dieu_so")),
        numbers.select("source_id", F.when(F.col("repealed"), "repealed").otherwise("missing").alias("finding"), F.col("n").cast("string").alias("item")),
        item(doubled, "duplicate", F.col("dieu_so")),
        item(out_of_order(a, "source_id", ["article"], F.col("k")), "out_of_order", F.col("dieu_so")),
        item(paragraphs.where(F.col("text").rlike("(?Ud)(?i)" + K.LOOSE_ARTICLE) & ~F.col("text").rlike(X.U + K.ARTICLE)), "unparsed", F.substring("text", 1, 80)),
        item(a.where(F.length(X.strip(F.col("noi_dung"))) < 20), "short", F.col("dieu_so")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
