"""Web pages: one tolerant parse for each page, in Arrow batches, then column expressions.

The parse emits what is in the page (metadata candidates in order of trust, headings, images, tags, Markdown of the main
content); choosing among candidates, cleaning and rendering are column expressions over it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import markdown as md
from docmill.functions import text as tx
from docmill.functions import urls
from docmill.operators.batches import map_batches
from docmill.sources import signals

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head".split())
BLOCKS = frozenset("p div section article main header footer aside nav ul ol li table tr blockquote pre figure h1 h2 h3 h4 h5 h6 form".split())
ASIDE = frozenset("nav footer aside form header".split())
#: Class and id words of parts that aren't the article.
CLUTTER = re.compile(r"\b(ad|ads|advert|promo|newsletter|subscribe|sidebar|cookie)\b", re.I)
IMAGE_SOURCES = ("src", "data-src", "data-lazy-src", "data-original", "data-lazy", "data-image", "data-url")
CHOSEN = ("article", "main", "role=main", "post-content", "entry-content", "article-body", "content")
#: Elements nested deeper than this become siblings.
DEEPEST = 150
LEAST_CHOSEN, LEAST_PARAGRAPHS, LEAST_PARAGRAPH = 500, 3, 50

PARSED = (
    "page_id long, url string, meta array<struct<name:string,value:string>>, ld array<string>, title_tag string, h1 string, authors array<string>, times array<string>, "
    "tags array<string>, images array<struct<url:string,alt:string,title:string,width:int,height:int>>, markdown string, text string, shown_title string, "
    "author_candidates array<struct<rule:string,text:string>>, minutes_candidates array<int>, tag_candidates array<struct<rule:string,text:string>>, contents array<struct<text:string,level:int>>"
)


_PAIRS = pa.list_(pa.struct([("rule", pa.string()), ("text", pa.string())]))
#: The blog host whose responses are taken away.
BLOG = re.compile(r"https?://(?:[^/?#]*\.)?medium\.com(?:[/?#:]|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.kids))

    def plain(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in SILENT:
                stack.extend(reversed(n.kids))
        return re.sub(r"\s+", " ", " ".join(out)).strip()

    def says(self) -> str:
        return f"{self.attrs.get('class') or ''} {self.attrs.get('id') or ''}"


class _Tree(HTMLParser):
    """Builds nodes; a closing tag closes up to its opening one, if there is one, and what never closes ends with its parent."""

    CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in self.CLOSED_BY and tag in self.CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID and self.depth() < DEEPEST:
            self.at = node

    def depth(self) -> int:
        n, d = self.at, 0
        while n.parent is not None:
            n, d = n.parent, d + 1
        return d

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            if n.tag in BLOCKS and tag not in BLOCKS:  # a stray inline end tag closes no block
                return
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _inline(n, base: str) -> str:
    if isinstance(n, str):
        return re.sub(r"\s+", " ", n)
    if n.tag in SILENT:
        return ""
    inner = "".join(_inline(k, base) for k in n.kids)
    text = inner.strip()
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        src = _source(n)
        return f"![{n.attrs.get('alt', '')}]({urljoin(base, src)})" if src else ""
    if not text:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if n.tag in ("b", "strong"):
        return f"{lead}**{text}**{tail}"
    if n.tag in ("i", "em"):
        return f"{lead}*{text}*{tail}"
    if n.tag == "code":
        return f"{lead}`{text}`{tail}"
    if n.tag == "a" and n.attrs.get("href"):
        return f"{lead}[{text}]({urljoin(base, n.attrs['href'])}){tail}"
    return inner


def to_markdown(n: Node, base: str = "", depth: int = 0) -> str:
    """Blocks with blank lines between them; inline markup stays where it is."""
    out, line = [], []

    def flush():
        text = re.sub(r"[ \t]+", " ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    for k in n.kids:
        if isinstance(k, str) or k.tag not in BLOCKS:
            if not isinstance(k, str) and any(isinstance(x, Node) and x.tag in BLOCKS for x in k.walk() if x is not k):
                flush()  # an inline element that holds blocks
                inner = to_markdown(k, base, depth)
                if inner:
                    out.append(inner)
            else:
                line.append(_inline(k, base))
            continue
        flush()
        if k.tag in SILENT:
            continue
        if k.tag[0] == "h" and k.tag[1:].isdigit():
            text = k.plain()
            if text:
                out.append("#" * int(k.tag[1]) + " " + text)
        elif k.tag in ("ul", "ol"):
            rows = []
            for i, li in enumerate((x for x in k.kids if isinstance(x, Node) and x.tag == "li"), 1):
                inner = to_markdown(li, base, depth + 1)
                if inner:
                    rows.append(("  " * depth) + ("- " if k.tag == "ul" else f"{i}. ") + inner.replace("\n\n", "\n"))
            if rows:
                out.append("\n".join(rows))
        elif k.tag == "blockquote":
            inner = to_markdown(k, base)
            if inner:
                out.append("\n".join(f"> {x}" if x else ">" for x in inner.split("\n")))
        elif k.tag == "pre":
            code = "".join(x for m in k.walk() for x in m.kids if isinstance(x, str))
            lang = next((w.split("-", 1)[1] for m in k.walk() for w in (m.attrs.get("class") or "").split() if w.startswith("language-")), "")
            out.append(f"```{lang}\n{code.strip(chr(10))}\n```")
        elif k.tag == "table":
            rows = [[c.plain().replace("|", "\\|") for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in k.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = len(rows[0])
                full = [(r + [""] * width)[:width] for r in rows]
                lines = ["| " + " | ".join(r) + " |" for r in full]
                out.append("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))
        else:
            inner = to_markdown(k, base, depth)
            if inner:
                out.append(inner)
    flush()
    return "\n\n".join(out)


def _trim(n: Node) -> None:
    """Without navigation, forms and clutter."""
    n.kids = [k for k in n.kids if isinstance(k, str) or not (k.tag in ASIDE or k.tag in SILENT or CLUTTER.search(k.says()))]
    for k in n.kids:
        if isinstance(k, Node):
            _trim(k)


def _fits(n: Node, what: str) -> bool:
    if "=" in what:
        key, value = what.split("=")
        return n.attrs.get(key) == value
    return n.tag == what if what in ("article", "main") else what in n.says().split()


def main_content(root: Node) -> Node:
    """What is marked as the article and long enough, else the div with the most paragraphs, else the body."""
    _trim(root)
    nodes = list(root.walk())
    for what in CHOSEN:
        for n in nodes:
            if _fits(n, what) and len(n.plain()) > LEAST_CHOSEN:
                return n
    best, most = None, LEAST_PARAGRAPHS - 1
    for n in nodes:
        if n.tag in ("div", "section"):
            k = sum(1 for c in n.kids if isinstance(c, Node) and c.tag == "p" and len(c.plain()) > LEAST_PARAGRAPH)
            if k > most:
                best, most = n, k
    return best or next((n for n in nodes if n.tag == "body"), root)


def _source(n: Node) -> str:
    candidates = [c.split() for c in (n.attrs.get("srcset") or "").split(",") if c.strip()]
    widest = max(candidates, key=lambda c: int(re.sub(r"\D", "", c[1]) or 0) if len(c) > 1 else 0, default=None)
    return next((n.attrs[a] for a in IMAGE_SOURCES if n.attrs.get(a) and not n.attrs[a].startswith("data:")), widest[0] if widest else "")


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isdigit() and len(x) < 9 else None


def parse(page_id: int | None, url: str | None, html: str | None) -> tuple:
    """A row of ``PARSED``. A null page is an empty one."""
    base, root = url or "", tree(html or "")
    meta, ld, images, tags, authors, times = [], [], [], [], [], []
    title_tag = h1 = None
    for n in root.walk():
        a = n.attrs
        if n.tag == "meta" and a.get("content"):
            name = (a.get("property") or a.get("name") or "").lower()
            if name:
                meta.append({"name": name, "value": a["content"].strip()})
        elif n.tag == "script" and "ld+json" in a.get("type", ""):
            ld.append("".join(k for k in n.kids if isinstance(k, str)))
        elif n.tag == "title" and title_tag is None:
            title_tag = re.sub(r"\s+", " ", "".join(k for k in n.kids if isinstance(k, str))).strip() or None
        elif n.tag == "h1" and h1 is None:
            h1 = n.plain() or None
        elif n.tag == "time" and a.get("datetime"):
            times.append(a["datetime"])
        elif n.tag == "img":
            src = _source(n)
            if src:
                images.append({"url": urljoin(base, src), "alt": a.get("alt", ""), "title": a.get("title", ""), "width": _number(a.get("width")), "height": _number(a.get("height"))})
        if "background" in a.get("style", "") and (m := re.search(r"url\(['\"]?([^'\")]+)", a["style"])):
            images.append({"url": urljoin(base, m[1]), "alt": "", "title": "", "width": None, "height": None})
        if a.get("rel") == "author" or re.search(r"\b(author|byline)\b", n.says()) or a.get("itemprop") == "author":
            authors.append(n.plain())
        if a.get("rel") == "tag" or re.search(r"\b(tag|topic|category)\b", n.says()):
            tags.append(n.plain())
    text = root.plain()
    blog = bool(BLOG.match(base))
    pairs = lambda found: [{"rule": r, "text": t} for r, t in found]
    shown = (
        signals.shown_title(root), pairs(signals.author_candidates(root, blog)), list(signals.minutes_candidates(root)),
        pairs(signals.tag_candidates(root)), [{"text": t, "level": n} for t, n in signals.contents(root)],
    )
    if blog:
        signals.drop_responses(root)
    body = to_markdown(main_content(root), base)
    return page_id, url, meta, ld, title_tag, h1, authors, times, tags, images, body, text, *shown


def parse_pages(pages: DataFrame) -> DataFrame:
    """A row of ``PARSED`` for each of pages (page_id, url, html)."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("meta", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("ld", pa.list_(pa.string())), ("title_tag", pa.string()),
            ("h1", pa.string()), ("authors", pa.list_(pa.string())), ("times", pa.list_(pa.string())), ("tags", pa.list_(pa.string())),
            ("images", pa.list_(pa.struct([("url", pa.string()), ("alt", pa.string()), ("title", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))),
            ("markdown", pa.string()), ("text", pa.string()), ("shown_title", pa.string()), ("author_candidates", _PAIRS), ("minutes_candidates", pa.list_(pa.int32())), ("tag_candidates", _PAIRS),
            ("contents", pa.list_(pa.struct([("text", pa.string()), ("level", pa.int32())]))),
        ]
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [parse(*(c[i].as_py() for c in batch.columns)) for i in range(len(batch))]
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_batches(pages.select("page_id", "url", "html"), run, PARSED)


# -- columns over a parse ------------------------------------------------------------------------------------


def _named(name: str):
    return lambda m: m["name"] == name


def meta_value(*names: str) -> Column:
    """The first of the names that the page has, in the order given."""
    return F.coalesce(*[tx.missing_to_null(F.get(F.filter("meta", _named(n)), F.lit(0))["value"]) for n in names])


#: Types of JSON-LD items that are articles.
ARTICLES = ("Article", "NewsArticle", "BlogPosting", "TechArticle", "ScholarlyArticle")


def ld_item() -> Column:
    """The first article among JSON-LD scripts, their arrays and graphs, as a variant."""
    several = lambda path: lambda v: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array(v))
    items = F.flatten(F.transform(F.transform("ld", F.try_parse_json), several("$")))
    lists = F.flatten(F.transform(items, several("$['@graph']")))
    kinds = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.get(F.filter(lists, lambda v: F.arrays_overlap(kinds(v), F.array(*map(F.lit, ARTICLES)))), F.lit(0))


def _ld(*paths: str) -> Column:
    return F.coalesce(*[tx.missing_to_null(F.try_variant_get("ld_item", p, "string")) for p in paths])


def metadata(parsed: DataFrame) -> DataFrame:
    """page_id, url and merged metadata, a row for each of ``parsed``."""
    return _with_item(parsed).select("page_id", "url", *metadata_columns())


def _with_item(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("ld_item", ld_item())


def metadata_columns() -> list[Column]:
    """Over a parse with its ld_item: JSON-LD before OpenGraph, Twitter and standard tags, before the page's structure."""
    host_label = F.replace(urls.host(F.col("url")), F.lit("www."))
    author = F.coalesce(signals.author(), F.get(F.filter("authors", tx.name_like), F.lit(0)))
    title = F.coalesce(F.when(F.length("shown_title").between(6, 299), F.col("shown_title")), tx.longest_title_part(F.col("title_tag")))
    minutes = F.coalesce(signals.minutes(), tx.missing_to_null(F.regexp_extract("text", r"(?i)\b(\d{1,2})\s*(?:-\s*)?min(?:ute)?s?\s+read", 1)).try_cast("int"))
    clean = lambda c: tx.unescape(tx.strip(c))
    return [
        clean(F.coalesce(_ld("$.headline", "$.name"), meta_value("og:title", "twitter:title"), title)).alias("title"),
        clean(F.coalesce(_ld("$.author.name", "$.author[0].name", "$.author"), meta_value("article:author", "author", "twitter:creator"), author)).alias("author"),
        tx.iso_date(F.coalesce(_ld("$.datePublished"), meta_value("article:published_time", "date", "publish-date"), F.get("times", F.lit(0)))).alias("publication_date"),
        tx.iso_date(F.coalesce(_ld("$.dateModified"), meta_value("article:modified_time"))).alias("modified_date"),
        clean(F.coalesce(_ld("$.description"), meta_value("og:description", "twitter:description", "description"))).alias("description"),
        clean(F.coalesce(_ld("$.publisher.name"), meta_value("og:site_name"), host_label)).alias("source_name"),
        F.coalesce(_ld("$.url"), meta_value("og:url"), F.col("url")).alias("canonical_url"),
        F.coalesce(_ld("$.image.url", "$.image[0].url", "$.image[0]", "$.image"), meta_value("og:image", "twitter:image")).alias("main_image"),
        F.when(minutes.between(1, 60), minutes).alias("page_minutes"),
        tag_list().alias("tags"),
    ]


def tag_list() -> Column:
    """Twenty distinct tags in code point order, of keywords, tags and topics."""
    ld_words = F.coalesce(F.try_variant_get("ld_item", "$.keywords", "array<string>"), F.split(F.coalesce(F.try_variant_get("ld_item", "$.keywords", "string"), F.lit("")), ","))
    words = F.flatten(F.transform(F.filter("meta", lambda m: m["name"].isin("keywords", "news_keywords")), lambda m: F.split(m["value"], ",")))
    article = F.transform(F.filter("meta", lambda m: m["name"] == "article:tag"), lambda m: m["value"])
    marked = F.filter("tags", lambda t: (F.length(t) < 50) & tx.valid_tag(t))
    every = F.transform(F.concat(ld_words, words, article, marked, signals.tags()), tx.strip)
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda t: (F.length(t) > 1) & ~t.startswith("#")))), 1, 20)


def content_images() -> Column:
    """The images of a page without pixels, icons and portraits; each url once."""
    shown = F.filter(
        "images",
        lambda i: ~F.lower(i["url"]).rlike(r"^data:|1x1|pixel") & ~F.lower(i["alt"]).rlike(r"avatar|profile|photo of|logo")
        & (F.coalesce(i["width"], F.lit(50)) >= 50) & (F.coalesce(i["height"], F.lit(50)) >= 50),
    )
    found = F.transform(shown, lambda i: i["url"])
    return F.filter(shown, lambda i, n: F.array_position(found, i["url"]) == n + 1)


def articles(pages: DataFrame, retrieved: str, version: str) -> DataFrame:
    """page_id, title, author, markdown (with frontmatter and outline), reading minutes, images: pages as documents.

    A row for each page, in one pass: rows that repeat a page_id or have none are articles of their own; a null page is
    an empty article; further columns are ignored.
    """
    body = md.clean_for_retrieval(F.col("markdown")).alias("body")
    rows = _with_item(parse_pages(pages)).select("page_id", "url", *metadata_columns(), body, content_images().alias("images"))
    rows = rows.withColumn("minutes", tx.reading_minutes(F.col("body"), F.col("page_minutes"))).withColumn("outline", md.outline(F.col("body")))
    front = md.article_frontmatter(
        F.col("title"), F.col("author"), F.col("source_name"), F.col("url"), F.col("publication_date"), F.lit(retrieved), F.col("minutes"), F.col("tags"),
        F.col("description"), F.size("outline") >= 3, F.lit(version),
    )
    document = F.concat_ws("\n", front, F.lit(""), md.render_outline(F.col("outline")), F.col("body"))
    return rows.select(
        "page_id", "title", "author", tx.article_file_name(F.col("author"), F.col("title"), F.col("source_name"), F.col("url")).alias("file_name"), "minutes",
        F.size("images").alias("n_images"), tx.content_valid(F.col("body")).alias("valid"), "body", document.alias("document"))
