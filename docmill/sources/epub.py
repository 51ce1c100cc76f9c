"""E-books: archives of bytes to members, metadata and chapters.

Only unzipping is Python. The package file is read by XPath on local names, as publishers' namespaces vary; a bad archive has no members.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators.batches import BATCH_BYTES, map_batches
from docmill.sources.html import main_content, to_markdown, tree

CHAPTER_CHARS, TOTAL_CHARS = 24_000, 600_000
CUT = "\n[… cut …]"
CONTAINER, ROOT = "META-INF/container.xml", re.compile(r"full-path=\"([^\"]+)\"")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the e-books of a folder, not of those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(folder).select("path", "content")


def members(books: DataFrame) -> DataFrame:
    """path, name, text of the text members of each archive (path, content), and whether the container names it as the package.

    Whoever reads members several times should :func:`~docmill.operators.lineage.cut` them, as each reading unzips anew.
    """

    def opened(content: bytes) -> tuple[list[str], list[str]]:
        names, texts = [], []
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for n in z.namelist():
                    if n.lower().rsplit(".", 1)[-1] in ("xml", "opf", "ncx", "xhtml", "html", "htm"):
                        names.append(n)
                        texts.append(z.read(n).decode("utf-8", "replace"))
        except (zipfile.BadZipFile, OSError, RuntimeError):
            return [], []
        return names, texts

    def unzip(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Members go out at ``BATCH_BYTES``, as archives hold many times their size."""
        columns, held = ([], [], [], []), 0
        for nth, (path, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1)), 1):
            names, texts = opened(content.as_py() or b"")
            root = next((m[1] for n, t in zip(names, texts) if n == CONTAINER and (m := ROOT.search(t))), None)
            for column, some in zip(columns, ([path] * len(names), names, texts, [n == root for n in names])):
                column.extend(some)
            held += sum(map(len, texts))
            if columns[0] and (held >= BATCH_BYTES or nth == len(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["path", "name", "text", "package"])
                columns, held = ([], [], [], []), 0

    return map_batches(books.select("path", "content"), unzip, "path string, name string, text string, package boolean")


def _local(x: Column) -> Column:
    """XML without declaration, doctype and namespace prefixes, which XPath would want declared."""
    x = F.regexp_replace(x, r"(?s)\A.*?(?=<[A-Za-z])", "")
    return F.regexp_replace(F.regexp_replace(x, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?|\s)\w+:(?=\w+)", "$1")


def packages(parts: DataFrame) -> DataFrame:
    """path, opf_name, opf: each book's package file, found through its container file."""
    return parts.filter("package").select("path", F.col("name").alias("opf_name"), _local(F.col("text")).alias("opf"))


def metadata(opf: DataFrame) -> DataFrame:
    """path, title, author, year, edition; null where the package says nothing."""
    first = lambda tag: tx.missing_to_null(F.xpath_string("opf", F.lit(f"//*[local-name()='{tag}'][1]")))
    edition = lambda c: tx.missing_to_null(F.regexp_extract(c, r"(?i)\b(\d+(?:st|nd|rd|th)\s+edition|(?:first|second|third|fourth|fifth|revised)\s+edition)\b", 1))
    return opf.select(
        "path", first("title").alias("title"), first("creator").alias("author"),
        tx.missing_to_null(F.regexp_extract(first("date"), r"(\d{4})", 1)).alias("year"), F.coalesce(edition(first("title")), edition(first("description"))).alias("edition"))


def chapters(parts: DataFrame, opf: DataFrame, chapter_chars: int = CHAPTER_CHARS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """path, pos, href, title, text, char_count in reading order.

    The spine is joined with the manifest; only pages count; each is cut at ``chapter_chars`` and the book ends with the
    chapter that reaches ``total_chars``.
    """
    attrs = lambda p: F.xpath("opf", F.lit(p))
    item = "//*[local-name()='item'][@id and @href]"
    folder = F.regexp_extract("opf_name", r"\A(.*/)?", 1)
    items = F.arrays_zip(attrs(item + "/@id").alias("id"), attrs(item + "/@href").alias("href"), attrs(item + "/@media-type").alias("kind"))
    spine = opf.select("path", folder.alias("folder"), items.alias("items"), F.posexplode(attrs("//*[local-name()='itemref']/@idref")).alias("pos", "id"))
    listed = spine.select("path", "folder", "pos", F.explode(F.filter("items", lambda x: (x["id"] == F.col("id")) & x["kind"].rlike("html"))).alias("x"))
    read = listed.select("path", "pos", F.concat("folder", "x.href").alias("name"), "x.href").join(parts, ["path", "name"])
    text = tx.squeeze(tx.unescape(tx.strip_html(F.col("text"))))
    # Exploded where there is text, as a filter on the text would be pushed down and make it a second time.
    own = read.select("path", "pos", "href", tx.html_title(F.col("text")).alias("title"), F.explode(F.filter(F.array(text), lambda x: x != "")).alias("text"))
    own = own.withColumn("text", F.when(F.length("text") > chapter_chars, F.concat(F.left("text", F.lit(chapter_chars)), F.lit(CUT))).otherwise(F.col("text"))).withColumn("char_count", F.length("text"))
    before = F.coalesce(F.sum("char_count").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("before", before).filter(F.col("before") < total_chars).drop("before")


def summary(found: DataFrame) -> DataFrame:
    """path, chapters, chars, titles (the first fifty)."""
    titles = F.transform(F.sort_array(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("pos", "title")))), lambda x: x["title"])
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("chapters"), F.sum("char_count").alias("chars"), F.slice(titles, 1, 50).alias("titles"))


def to_books(parts: DataFrame, opf: DataFrame) -> DataFrame:
    """path, markdown: the spine's pages as Markdown, one after another."""
    attrs = lambda p: F.xpath("opf", F.lit(p))
    item = "//*[local-name()='item'][@id and @href]"
    pages = opf.select("path", F.regexp_extract("opf_name", r"\A(.*/)?", 1).alias("folder"), F.explode(F.arrays_zip(attrs(item + "/@id").alias("id"), attrs(item + "/@href").alias("href"))).alias("x"))
    spine = opf.select("path", F.posexplode(attrs("//*[local-name()='itemref']/@idref")).alias("pos", "id"))
    read = spine.join(pages.select("path", "x.id", F.concat("folder", "x.href").alias("name")), ["path", "id"]).join(parts, ["path", "name"]).select("path", "pos", "text")

    def convert(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [to_markdown(main_content(tree(t.as_py() or ""))) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["path", "pos", "md"])

    rows = map_batches(read, convert, "path string, pos int, md string").filter(F.col("md") != "")
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))


def anchor_headings(books: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """doc_id, body: books whose contents links name chapters that have no heading get one before each such anchor."""
    links = books.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(r"(\[(?:[^\[\]]|\[[^\]]*\])+\]\(#[^)\s]+\))"), 1)).alias("pos", "link"))
    title = F.regexp_replace(F.regexp_extract("link", r"\*{2,3}([^*\n]+?)\*{2,3}", 1), r"\A[ *\\]+|[ *\\]+\z", "")
    sub = F.regexp_replace(F.regexp_extract(F.substr("link", F.lit(2)), r"\[([^\]\n]+?)\]\{\.\w+\}", 1), r"\A[ *\\]+|[ *\\]+\z", "")
    named = links.select(key, "pos", F.regexp_extract("link", r"\(#([^)\s]+)\)\z", 1).alias("anchor"), title.alias("title"), sub.alias("sub")).filter(F.length("title").between(1, 120))
    whole = F.when((F.col("sub") != "") & (F.lower("sub") != F.lower("title")) & (F.length("sub") <= 120), F.concat("title", F.lit(": "), "sub")).otherwise(F.col("title"))
    toc = named.groupBy(key, "anchor").agg(F.min_by(whole, "pos").alias("heading"))
    lines = books.select(key, F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line")).withColumn("anchor", F.regexp_extract("line", r"\A\[\]\{#([^}\s]+)\}[ \t]*\z", 1))
    marked = lines.join(toc, [key, "anchor"], "left").withColumn("line", F.when(F.col("heading").isNotNull(), F.concat(F.lit("# "), "heading", F.lit("\n\n"), "line")).otherwise(F.col("line")))
    return marked.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias(body))
