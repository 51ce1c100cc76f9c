"""Documents as lines: masks, breadcrumbs, pages and verbatim regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import numerals, section_key, strip, years

HEADING = r"\A(#{1,4})\s+(.+)\z"
PLACEHOLDER_CHARS = 60
#: Sections that only navigate.
NAVIGATION = ("toc", "pages", "guide", "landmarks", "figures", "index")


#: What a line stands in, with the lines that open and close it: a fence, a table or a figure, up to the end if none closes it.
_BLANK = r"[\s&&[^\n]]*+"
REGION = (
    rf"(?Uids)(?m:^){_BLANK}(?:(?:```|~~~).*?(?:\n{_BLANK}(?:```|~~~)[^\n]*|\z)"
    r"|<table.*?(?:</table>[^\n]*|\z)|<figure.*?(?:</figure>[^\n]*|\z))"
)


def _line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def states(body: Column) -> Column:
    """For each line of a text what it stands in: "" (nothing), ``fence``, ``table`` or ``figure``.

    The three exclude each other, as a lexer finds them from left to right. The text is cut at them once, and each
    part gives its state as often as it has lines.
    """
    between = F.split(body, REGION, -1).alias("between")
    parts = F.arrays_zip(between, F.regexp_extract_all(body, F.lit(REGION), F.lit(0)).alias("region"))

    def kind(region):
        head = F.lower(F.left(strip(region), F.lit(7)))
        return F.when(head.startswith("<table"), "table").when(head.startswith("<figure"), "figure").otherwise("fence")

    def part(x, nth):
        text, region = x["between"], x["region"]
        free = _line_breaks(text) + 1 - (nth > 0).cast("int") - region.isNotNull().cast("int")
        own = F.when(region.isNotNull(), F.array_repeat(kind(region), _line_breaks(region) + 1))
        return F.concat(F.array_repeat(F.lit(""), free), F.coalesce(own, F.array().cast("array<string>")))

    return F.flatten(F.transform(parts, part))


def to_lines(documents: DataFrame, body: str = "body", key: str = "doc_id") -> DataFrame:
    """doc_id, line_no (from 0), line, state."""
    lines = F.split(F.col(body), "\n", -1)
    rows = documents.select(key, lines.alias("lines"), states(F.col(body)).alias("states"))
    return rows.select(key, F.posexplode(F.arrays_zip("lines", "states")).alias("line_no", "x")).select(
        key, "line_no", F.col("x.lines").alias("line"), F.col("x.states").alias("state")
    )


def from_lines(lines: DataFrame, key: str = "doc_id", name: str = "body") -> DataFrame:
    """Documents back from their lines."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def breadcrumbs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with level and title (of headings), page (from 1, by rules) and path: the titles above each line.

    A heading of a level stands until one of the same or a higher level comes, so the title at a level counts if no
    higher heading has come since.
    """
    up_to = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    free = F.col("state") == ""
    level = F.when(free & F.col("line").startswith("#") & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1)))
    out = lines.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), strip(F.regexp_extract("line", HEADING, 2))))
    last = lambda n: F.last(F.when(F.col("level") == n, F.struct("line_no", "title")), ignorenulls=True).over(up_to)
    out = out.select("*", *[last(n).alias(f"h{n}") for n in range(1, 5)])
    parts = []
    for n in range(1, 5):
        above = [F.coalesce(F.col(f"h{m}.line_no"), F.lit(-1)) for m in range(1, n)]
        newest = F.greatest(F.lit(-1), F.lit(-1), *above)
        parts.append(F.when(F.col(f"h{n}.line_no") > newest, F.col(f"h{n}.title")))
    path = F.filter(F.array(*parts), lambda t: t.isNotNull())
    page = 1 + F.sum((free & F.contains("line", F.lit("---")) & (strip(F.col("line")) == "---")).cast("int")).over(up_to)
    return out.select(key, "line_no", "line", "state", "level", "title", page.cast("int").alias("page"), path.alias("path"))


def is_navigation(path: Column) -> Column:
    return F.exists(path, lambda t: section_key(t).isin(*NAVIGATION))


def regions(crumbs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables and figures, byte for byte: doc_id, start, stop (line numbers), kind, path, raw.

    Pipe rows are a table from two in a row; HTML tables and figures go to their closing tag; a section named
    Figures is one figure. Fences hold none.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    figures = F.exists(F.col("path"), lambda t: F.contains(F.lower(t), F.lit("figures")) & (section_key(t) == "figures"))
    kind = (
        F.when(F.col("state") == "fence", None)
        .when(figures, "figure")
        .when(F.col("state") == "table", "html")
        .when(F.col("state") == "figure", "figure")
        .when(F.contains("line", F.lit("|")) & strip(F.col("line")).startswith("|"), "pipe")
    )
    marked = crumbs.withColumn("kind", kind).withColumn("section", figures)
    opens = (
        (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("")))
        | (F.col("section") != F.lag("section").over(order))
        | (~F.col("section") & (F.contains("line", F.lit("<")) & F.lower(strip(F.col("line"))).rlike(r"\A<(table|figure)") & F.lag("line").over(order).rlike("(?i)</(table|figure)>")))
    )
    islands = marked.withColumn("island", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(order)).filter(F.col("kind").isNotNull())
    return (
        islands.groupBy(key, "island")
        .agg(
            F.min("line_no").alias("start"), F.max("line_no").alias("stop"), F.first("kind").alias("kind"), F.min_by("path", "line_no").alias("path"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"),
        )
        .filter((F.col("kind") != "pipe") | (F.col("stop") > F.col("start")))
        .drop("island")
    )


def excise(crumbs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with a placeholder in the place of each region."""
    first = F.split_part("raw", F.lit("\n"), F.lit(1))
    marks = found.select(key, F.col("start").alias("line_no"), F.concat(F.lit("[TABLE: "), F.left(first, F.lit(PLACEHOLDER_CHARS)), F.lit(" … ]")).alias("line"), "stop")
    every = crumbs.select(key, "line_no", "line", F.lit(None).cast("int").alias("stop")).unionByName(marks)
    # A line is in a region if one that has begun reaches it: lines and marks meet by their document alone, which brings them together once.
    up_to = Window.partitionBy(key).orderBy("line_no", F.col("stop").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.coalesce(F.max("stop").over(up_to) >= F.col("line_no"), F.lit(False))
    return from_lines(every.withColumn("inside", reached).filter(F.col("stop").isNotNull() | ~F.col("inside")), key)


def numeral_inventory(documents: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, numerals and years of the whole source, table_numerals of its regions."""
    own = documents.select(key, numerals(F.col(text)).alias("numerals"), years(F.col(text)).alias("years"))
    tables = found.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(numerals(F.col("raw")))))).alias("table_numerals"))
    return own.join(tables, key, "left")
