"""Page layouts: blocks of spans to Markdown, column votes, figures and analysis totals.

A layout row is (doc_id, page, blocks array<struct<type, bbox array<double>, lines array<struct<spans
array<struct<text, size, flags, font>>>>>>); images are blocks of type 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import academic_paper, bound, strip, strip_bound

BOLD_FLAG = 16
GAP, COLUMN_SHARE = 50, 0.3
FIGURE_SIDE = 100
MOST_FIGURES = 20


def sampled_pages(pages: Column) -> Column:
    """The first page, the quarters and the last, once each."""
    return F.filter(F.array_distinct(F.array(F.lit(0), *[F.floor(pages * i / 4) for i in (1, 2, 3)], pages - 1)), lambda p: (p >= 0) & (p < pages))


def _span(s: Column) -> Column:
    text = s["text"]
    bold = (s["flags"].bitwiseAND(BOLD_FLAG) > 0) & (strip(text) != "")
    return F.when(bold, F.concat(F.lit("**"), strip(text), F.lit("**"))).otherwise(text)


def page_markdown(layout: DataFrame) -> DataFrame:
    """doc_id, page, markdown: blocks as paragraphs; large type against the page's largest makes headings."""
    blocks = layout.select("doc_id", "page", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 0")
    lines = F.transform("b.lines", lambda line: F.array_join(F.transform(line["spans"], _span), ""))
    plain = F.array_join(F.transform("b.lines", lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")), " ")
    size = F.array_max(F.flatten(F.transform("b.lines", lambda line: F.transform(line["spans"], lambda s: s["size"]))))
    # Exploded where there is text, as a filter on the text would be pushed down and make it a second time.
    text = F.filter(F.array(bound(F.array_join(lines, "\n"), strip_bound)), lambda x: x != "")
    texts = blocks.select("doc_id", "page", "pos", F.explode(text).alias("text"), bound(plain, strip_bound).alias("plain"), size.alias("size"))
    share = F.col("size") / F.max("size").over(Window.partitionBy("doc_id", "page"))
    uneven = F.min("size").over(Window.partitionBy("doc_id", "page")) < F.max("size").over(Window.partitionBy("doc_id", "page"))
    mark = F.when(~uneven, "").when(share >= 0.9, "# ").when(share >= 0.75, "## ").when(share >= 0.6, "### ").otherwise("")
    rendered = texts.withColumn("md", F.when(mark != "", F.concat(mark, F.col("plain"))).otherwise(F.col("text")))
    return rendered.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: pages in order with a rule between them."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n\n---\n\n").alias("markdown"))


def side_by_side(boxes: DataFrame) -> DataFrame:
    """Boxes (doc_id, page, pos, x0, y0, x1, y1) that stand beside a later box of their page.

    The join is on the page; the conditions on the intervals stay within it.
    """
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (
        (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") < F.col("b.pos"))
        & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
        & ((F.col("a.x1") < F.col("b.x0") - GAP) | (F.col("a.x0") > F.col("b.x1") + GAP))
    )
    return a.join(b, on, "left_semi")


def analysis(layout: DataFrame) -> DataFrame:
    """doc_id, page_count, total_chars, figures, fonts, columns_votes, multi_column, academic."""
    pages = layout.withColumn("page_count", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    spans = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(F.coalesce(b["lines"], F.array()), lambda x: x["spans"]))))
    texts = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    picture = F.size(F.filter("blocks", lambda b: (b["type"] == 1) & (b["bbox"][2] - b["bbox"][0] > FIGURE_SIDE) & (b["bbox"][3] - b["bbox"][1] > FIGURE_SIDE)))
    sampled = F.array_contains(sampled_pages(F.col("page_count")), F.col("page").cast("long"))
    per_page = pages.select(
        "doc_id", "page", "page_count", texts.alias("chars"), picture.alias("figures"), sampled.alias("sampled"),
        F.when(sampled, F.array_distinct(F.transform(spans, lambda s: s["font"]))).alias("fonts"),
        F.when(F.col("page") == 0, F.array_join(F.transform(spans, lambda s: s["text"]), " ")).alias("first_text"))
    totals = per_page.groupBy("doc_id").agg(
        F.max("page_count").alias("page_count"), F.sum("chars").alias("total_chars"), F.sum("figures").alias("figures"),
        F.size(F.array_distinct(F.flatten(F.collect_list("fonts")))).alias("fonts"), F.count_if("sampled").alias("n_sampled"), F.max("first_text").alias("first_text"))
    boxes = pages.filter(sampled).select("doc_id", "page", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 0").select(
        "doc_id", "page", "pos", *[F.col("b.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    votes = side_by_side(boxes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("column_votes"), F.count_distinct("page").alias("column_pages"))
    return totals.join(votes, "doc_id", "left").na.fill(0, ["column_votes", "column_pages"]).select(
        "doc_id", "page_count", "total_chars", "figures", "fonts", "column_votes", "column_pages",
        (F.col("column_votes") > F.col("n_sampled") * COLUMN_SHARE).alias("multi_column"), academic_paper(F.col("first_text")).alias("academic"))


def ruling_lines(layout: DataFrame, slack: float = 1.0) -> DataFrame:
    """doc_id, h_lines, v_lines: lines (rules array<struct<x0, y0, x1, y1>>) that rule a page across or down."""
    rows = layout.select("doc_id", F.explode("rules").alias("r"))
    flat, upright = F.abs(F.col("r.y1") - F.col("r.y0")) <= slack, F.abs(F.col("r.x1") - F.col("r.x0")) <= slack
    return rows.groupBy("doc_id").agg(F.count_if(flat & ~upright).alias("h_lines"), F.count_if(upright & ~flat).alias("v_lines"))


def captioned(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """Figures (doc_id, page, seq) with the first caption of their document's text (doc_id, text), which all of them share."""
    named = texts.groupBy("doc_id").agg(F.max(caption(F.col("text"))).alias("caption"))
    return figures.join(named, "doc_id", "left")


def caption(text: Column) -> Column:
    """The first figure caption of a text."""
    return F.nullif(strip(F.regexp_extract(text, r"(?i)((?:figure|fig\.)\s*\d+[.:]\s*[^\n]+)", 1)), F.lit(""))


def render_figure(ref: Column, title: Column, confidence: Column, description: Column) -> Column:
    band = F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
    return F.concat_ws(
        "\n", F.lit("<figure>"), F.concat(F.lit("**"), ref, F.lit("**"), F.coalesce(F.concat(F.lit(": "), title), F.lit(""))),
        F.concat(F.lit("Confidence: "), band, F.lit(" ("), (confidence * 100).cast("int"), F.lit("%)")), description, F.lit("</figure>"))


def first_page_meta(first_lines: Column, info_title: Column, info_author: Column) -> tuple[Column, Column]:
    """Title and authors from the first lines of a paper, else from the file's own fields."""
    lines = F.transform(first_lines, strip)
    title = F.get(F.filter(F.slice(lines, 1, 20), lambda x: (F.length(x) > 20) & ~x.rlike(r"(?i)journal|https?:|www\.|doi") & ~((F.upper(x) == x) & (F.length(x) < 50))), F.lit(0))
    pattern = r"\A[A-Z][a-z]+(?:\s[A-Z]\.?)*\s[A-Z][a-z]+(?:,\s.*|\sand\s.*)"
    author = F.get(F.filter(F.slice(lines, 1, 15), lambda x: x.rlike(pattern)), F.lit(0))
    usable = lambda x: F.when((x != "") & ~F.lower(x).startswith("doi"), x)
    return F.coalesce(title, usable(info_title)), F.coalesce(author, usable(info_author))


def cascade(attempts: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tool, score, last_tool: the first attempt that is good enough ends the trying, else the best tried.

    Attempts: doc_id, ord, tool, score (null: unavailable, skipped but tried), with a threshold that rises for the first.
    """
    good = F.col("score") >= F.col("threshold")
    stop = F.min(F.when(good, F.col("ord"))).over(Window.partitionBy("doc_id"))
    tried = attempts.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("ord") <= F.col("stop")))
    best = F.max_by("tool", F.when(F.col("score").isNotNull(), F.struct(good.alias("good"), F.col("score"), (-F.col("ord")).alias("at"))))
    return tried.groupBy("doc_id").agg(best.alias("tool"), F.max_by("score", F.when(F.col("score").isNotNull(), F.struct(good.alias("good"), F.col("score"), (-F.col("ord")).alias("at")))).alias("score"), F.max_by("tool", "ord").alias("last_tool"))
