"""The smaller steps around a page or file: bodies as they were sent, images in the text, articles over several pages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import markdown as md
from docmill.functions import text as tx
from docmill.functions import urls
from docmill.operators.batches import BATCH_BYTES, map_batches
from docmill.sources.html import _named

MOST_BODY = 256 << 20
PAGE_BREAK = "\n\n---\n\n"


def _inflated(body: bytes, window: int) -> bytes:
    """At most one byte more than ``MOST_BODY``; an error if the body ends early."""
    opened = zlib.decompressobj(window)
    out = opened.decompress(body, MOST_BODY + 1)
    if len(out) <= MOST_BODY and not opened.eof:
        raise zlib.error("the body ends early")
    return out


def decoded(body: bytes | None, encoding: str | None) -> bytes | None:
    """A body without its content encoding; None if it is damaged, too large or of an unknown one."""
    if body is None:
        return None
    try:
        for name in reversed([e.strip().lower() for e in (encoding or "").split(",")]):
            if name in ("", "identity"):
                continue
            if name == "zstd":
                body = zstandard.ZstdDecompressor().stream_reader(body).read(MOST_BODY + 1)
            elif name in ("gzip", "x-gzip", "deflate"):
                try:
                    body = _inflated(body, 31 if "gzip" in name else 15)
                except zlib.error:
                    if "gzip" in name:
                        return None
                    body = _inflated(body, -15)  # deflate without its header
            else:
                return None
            if len(body) > MOST_BODY:
                return None
    except (zlib.error, zstandard.ZstdError):
        return None
    return body


def decode_bodies(rows: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Rows (key, body binary, encoding) as (key, html), and the keys of those that can't be decoded."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Bodies inflate to many times a batch's size, so that a piece goes out at ``BATCH_BYTES``."""
        first, held, out = 0, 0, []
        for n, (body, encoding) in enumerate(zip(batch.column(1), batch.column(2)), 1):
            plain = decoded(body.as_py(), encoding.as_py())
            out.append(None if plain is None else plain.decode("utf-8", "replace"))
            held += len(plain or b"")
            if held >= BATCH_BYTES or n == len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n - first), pa.array(out, pa.string())], [key, "html"])
                first, held, out = n, 0, []

    done = map_batches(rows.select(key, "body", "encoding"), run, f"{key} {kind}, html string")
    return done.filter(F.col("html").isNotNull()), done.filter(F.col("html").isNull()).select(key)


def paginated(pages: DataFrame) -> DataFrame:
    """base_url, markdown, pages: articles whose pages differ in their page parameter alone, in order, with a rule between.

    pages: url, markdown; a page without parameter is the first. Pages that are missing are left out.
    """
    param, number = urls.page_param(F.col("url")), urls.page_number(F.col("url"))
    pairs = F.filter(F.split(urls.query(F.col("url")), "&"), lambda p: (p != "") & ~F.coalesce(F.split_part(p, F.lit("="), F.lit(1)) == F.col("param"), F.lit(False)))
    rows = pages.select("markdown", "url", param.alias("param"), F.coalesce(number, F.lit(1)).alias("page"))
    base = F.concat(F.regexp_extract("url", r"\A([^?#]*)", 1), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))
    parts = rows.select(base.alias("base_url"), "page", "markdown").groupBy("base_url", "page").agg(F.min("markdown").alias("markdown"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"])
    return parts.groupBy("base_url").agg(F.array_join(ordered, PAGE_BREAK).alias("markdown"), F.count(F.lit(1)).alias("pages"))


def display_author(author: Column, shown: Column, url: Column) -> Column:
    """On blog hosts an author that is a url gives way to the name shown, else to the user name in it."""
    address = F.contains(author, F.lit("medium.com")) | author.startswith("http")
    user = F.initcap(F.nullif(F.regexp_extract(author, "@([a-zA-Z0-9_]+)", 1), F.lit("")))
    named = F.when(shown.isNotNull() & ~F.contains(shown, F.lit("medium.com")), shown)
    return F.when(urls.is_blog_post(url) & address, F.coalesce(named, user, author)).otherwise(author)


def article_images(images: Column, lead: Column) -> Column:
    """Of a page's images those of the article: the lead image always, others unless their text or address says otherwise."""
    return F.filter(
        images,
        lambda i: F.coalesce(i["url"] == lead, F.lit(False))
        | (~F.lower(F.coalesce(i["alt"], F.lit(""))).rlike("avatar|profile photo|logo|icon") & ~F.lower(i["url"]).rlike(r"1x1|pixel|tracking|beacon|stat\.")),
    )


#: Extensions of image types.
IMAGE_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/avif": ".avif"}


def figure_name(base: Column, number: Column, content_type: Column) -> Column:
    pairs = [x for k, v in IMAGE_TYPES.items() for x in (F.lit(k), F.lit(v))]
    kind = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.concat(base, F.lit(" - Figure "), number.cast("string"), F.coalesce(F.create_map(*pairs)[kind], F.lit(".jpg")))


def place_images(content: Column, images: Column) -> Column:
    """Text with each image (url, alt, local) under its local name; those that it doesn't refer to are appended."""

    def step(text, i):
        changed = F.replace(F.replace(text, F.concat(F.lit("]("), i["url"], F.lit(")")), F.concat(F.lit("]("), i["local"], F.lit(")"))), F.concat(F.lit('src="'), i["url"], F.lit('"')), F.concat(F.lit('src="'), i["local"], F.lit('"')))
        added = F.concat(changed, F.lit("\n\n!["), F.coalesce(F.nullif(i["alt"], F.lit("")), F.lit("Figure")), F.lit("]("), i["local"], F.lit(")\n"))
        return F.when(F.contains(changed, i["url"]) | F.contains(changed, i["local"]), changed).otherwise(added)

    return F.aggregate(images, content, step)


def layout_frontmatter(title, author, path, created, retrieved, minutes, pages, figures, tables, confidence, tool, last_tool, ocr, kind, version) -> Column:
    """YAML of a document that came as a page layout: the tool that was best, and the last one tried."""
    quoted = lambda n, c: F.concat(F.lit(f'{n}: "'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    lines = [
        quoted("title", F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(name, r"\.[^.]*\z", ""))), quoted("author", F.coalesce(F.nullif(author, F.lit("")), F.lit("Unknown"))), F.lit('source_type: "pdf"'), quoted("source_file", name),
        F.when(created != "", quoted("publication_date", tx.layout_date(created))), quoted("retrieved_date", retrieved), F.concat(F.lit("reading_time_minutes: "), minutes), F.concat(F.lit("page_count: "), pages),
        F.concat(F.lit("figures_extracted: "), figures), F.concat(F.lit("tables_extracted: "), tables), F.concat(F.lit("extraction_confidence: "), F.format_string("%.2f", confidence)), quoted("extraction_tool", tool),
        quoted("last_tool_tried", last_tool), F.concat(F.lit("ocr_applied: "), ocr.cast("string")), quoted("content_type", kind), quoted("converter_version", version),
    ]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def layout_documents(rows: DataFrame, retrieved: str, version: str) -> DataFrame:
    """file_name, document: frontmatter, outline of a paper and text of documents that came as page layouts.

    rows: title, author, path, created, minutes, pages, figures, tables, confidence, tool, last_tool, ocr, kind, markdown.
    """
    c = F.col
    front = layout_frontmatter(c("title"), c("author"), c("path"), c("created"), F.lit(retrieved), c("minutes"), c("pages"), c("figures"), c("tables"), c("confidence"), c("tool"), c("last_tool"), c("ocr"), c("kind"), F.lit(version))
    name = F.concat(F.concat_ws(" - ", F.nullif(tx.file_stem(c("author")), F.lit("")), F.coalesce(F.nullif(tx.file_stem(c("title")), F.lit("")), F.lit("Untitled"))), F.lit(".md"))
    body = md.without_page_lines(c("markdown"))
    contents = md.render_outline(md.paper_outline(body))
    return rows.select(name.alias("file_name"), F.concat_ws("\n", front, F.lit(""), contents, body).alias("document"))


def pages_with_tables(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page, markdown: a page's tables of two rows or more (doc_id, page, seq, md) before its text (doc_id, page, md)."""
    blocks = tables.filter(F.size(F.split("md", "\n")) >= 3).select("doc_id", "page", F.lit(0).alias("kind"), F.col("seq").cast("int").alias("seq"), "md")
    every = blocks.unionByName(texts.select("doc_id", "page", F.lit(1).alias("kind"), F.lit(0).alias("seq"), "md"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("kind", "seq", "md"))), lambda x: x["md"])
    return every.filter(tx.strip(F.col("md")) != "").groupBy("doc_id", "page").agg(F.array_join(ordered, "\n\n").alias("markdown"))


def lead_image() -> Column:
    """The page's own choice of an image, of a parse's meta."""
    return F.coalesce(*[F.get(F.filter("meta", _named(n)), F.lit(0))["value"] for n in ("og:image", "twitter:image")])
