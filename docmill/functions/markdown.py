"""Markdown cleaning, measuring and rendering as column expressions.

The order of the rewrites matters and is part of their meaning.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import CONTROLS, bound, count, is_upper, occurrences, strip, strip_bound, unescape

HTML_BLOCK = "``{=html}"
#: What is counted as an artefact, and what each costs per thousand lines.
ARTIFACTS = {
    "header_ids": r"(?md)^#{1,6}\s+.*\{#[^}]*\}",
    "citations": r"\[\[.*?\]\(#[^)]*\)\{\.biblioref[^}]*\}",
    "image_attrs": r"!\[.*?\]\(.*?\)\{[^}]+\}",
    "bracket_classes": r"\[[^\]]+\]\{[^}]+\}",
    "xhtml_links": r"\[.*?\]\(#\d+_[^)]*\.xhtml[^)]*\)",
    "blockquote_divs": r"(?md)^> ::: \{\}$",
}
#: Strings that every artefact of a kind holds.
ARTIFACT_SIGNS = {"header_ids": "{#", "citations": "{.biblioref", "image_attrs": "){", "bracket_classes": "]{", "xhtml_links": ".xhtml", "blockquote_divs": "> ::: {}"}
PENALTIES = {"header_ids": 0.5, "html_blocks": 2.0, "citations": 0.2, "image_attrs": 0.1, "bracket_classes": 0.3, "xhtml_links": 0.1, "blockquote_divs": 0.05}
HEADING = r"(?md)^#{1,6}\s+"
GOOD_ENOUGH = 85.0


def line_total(md: Column) -> Column:
    return occurrences(md, "\n") + 1


def artifact_counts(md: Column) -> dict[str, Column]:
    held = lambda k, p: F.when(~F.contains(md, F.lit(ARTIFACT_SIGNS[k])), F.lit(0).cast("long")).otherwise(count(md, p))
    return {"line_count": line_total(md), "html_blocks": occurrences(md, HTML_BLOCK), **{k: held(k, p) for k, p in ARTIFACTS.items()}}


def optimization_score(counts: dict[str, Column]) -> Column:
    def of(lines: Column) -> Column:
        score = F.lit(100.0)
        for name, price in PENALTIES.items():
            score = score - counts[name] / (lines / F.lit(1000.0)) * price
        return F.when(lines == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), score))

    return bound(counts["line_count"], of)


def heading_total(md: Column) -> Column:
    return count(md, HEADING)


def quality_signals(md: Column) -> list[Column]:
    counts = artifact_counts(md)
    return [
        F.round(optimization_score(counts), 2).alias("optimization_score"),
        *[c.alias(k) for k, c in counts.items()],
        heading_total(md).alias("heading_count"),
        F.length(md).cast("long").alias("md_char_count"),
    ]


def precheck_counts(md: Column) -> dict[str, Column]:
    """What a converted book is judged by before it is cleaned."""
    lines = F.split(md, "\n", -1)
    n = lambda test: F.size(F.filter(lines, test)).cast("long")
    return {
        "lines": line_total(md),
        "headings": n(lambda x: strip(x).startswith("#")),
        "html_blocks": occurrences(md, HTML_BLOCK),
        "calibre_markers": n(lambda x: F.contains(x, F.lit("{.calibre")) & strip(x).startswith("[")),
        "caps_lines": n(lambda x: (F.length(strip(x)) > 10) & is_upper(strip(x)) & ~strip(x).startswith("#")),
        "anchor_markers": count(md, r"(?md)^\[\]\{#[^}\s]+\}[ \t]*$"),
        "role_attrs": occurrences(md, "role="),
        "bracket_classes": count(md, ARTIFACTS["bracket_classes"]),
    }


def precheck(c: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Score, issues and recommendation from the counts of :func:`precheck_counts`."""
    long_ = c["lines"] > 1000
    no_heads = long_ & (c["headings"] == 0)
    few_heads = long_ & (c["headings"] > 0) & (c["headings"] < 10)
    cases = [
        (no_heads & (c["calibre_markers"] > 50), 15, F.concat(F.lit("Fixable: "), c["calibre_markers"], F.lit(" styled lines become headings"))),
        (no_heads & (c["calibre_markers"] <= 50) & (c["anchor_markers"] >= 3), 15, F.concat(F.lit("Fixable: "), c["anchor_markers"], F.lit(" anchored sections become headings"))),
        (no_heads & (c["calibre_markers"] <= 50) & (c["anchor_markers"] < 3) & (c["caps_lines"] > 30), 30, F.concat(F.lit("Warning: "), c["caps_lines"], F.lit(" lines in capitals may be headings"))),
        (no_heads & (c["calibre_markers"] <= 50) & (c["anchor_markers"] < 3) & (c["caps_lines"] <= 30), 40, F.concat(F.lit("Critical: no heading in "), c["lines"], F.lit(" lines"))),
        (few_heads, 20, F.concat(F.lit("Warning: "), c["headings"], F.lit(" headings only"))),
        (c["html_blocks"] > 200, 25, F.concat(F.lit("Major: "), c["html_blocks"], F.lit(" HTML blocks"))),
        ((c["html_blocks"] > 100) & (c["html_blocks"] <= 200), 15, F.concat(F.lit("Warning: "), c["html_blocks"], F.lit(" HTML blocks"))),
        (c["role_attrs"] > 50, 10, F.concat(F.lit("Warning: "), c["role_attrs"], F.lit(" role attributes"))),
        (c["bracket_classes"] > 500, 10, F.concat(F.lit("Warning: "), c["bracket_classes"], F.lit(" bracket classes"))),
    ]
    score = F.lit(100.0)
    for test, price, _ in cases:
        score = score - F.when(test, F.lit(float(price))).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), score)
    issues = F.filter(F.array(*[F.when(test, text) for test, _, text in cases]), lambda x: x.isNotNull())
    return score, issues, F.when(score >= 70, "proceed").otherwise("skip")


def _rewrite(md: Column, *steps: tuple[str, ...]) -> Column:
    """Steps (pattern, replacement, a string that every match holds, if there is one): only texts with the string are searched."""

    def step(pattern: str, to: str, sign: str):
        return lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, to)).otherwise(x)

    for pattern, to, *sign in steps:
        md = bound(md, step(pattern, to, *sign)) if sign else F.regexp_replace(md, pattern, to)
    return md


def _without_html_blocks(md: Column) -> Column:
    return F.array_join(F.filter(F.split(md, "\n", -1), lambda x: ~F.contains(x, F.lit(HTML_BLOCK)) | (strip(x) != HTML_BLOCK)), "\n")


def deep_clean(md: Column) -> Column:
    """Header attributes, HTML blocks, citations, image attributes, bracket classes, internal links, quote divs,
    empty headers, endnotes and section numbers, in this order."""
    md = _rewrite(md, (r"(?md)^(#{1,6})\s+\[\]\{[^}]*\}(.+)$", "$1 $2", "[]{"), (r"(?md)^(#{1,6}\s+.+?)\s*\{[^}]*\}.*$", "$1", "{"))
    return _rewrite(
        _without_html_blocks(md),
        (r"\[\[([^\]]*)\]\(#[^)]*\)\{[^}]*\}\]", "[$1]", "](#"),
        (r"(!\[[^\]]*\]\([^)]*\))\{[^}]*\}", "$1", "){"),
        (r"(\[[^\]]+\])\{[^}]+\}", "$1", "]{"),
        (r"\[([^\]]*)\]\(#\d+_[^)]*\.xhtml[^)]*\)", "[$1]", ".xhtml"),
        (r"(?md)^> ::: \{\}$", "", "> ::: {}"),
        (r"(?md)^> :::$", "", "> :::"),
        (r"(?md)^#{1,6}[ \t]*\[\][ \t]*$", "", "[]"),
        (r"\[\\\[(\d+)\\\]\]\([^)]*\)\{[^}]*\}", "[$1]", "[\\["),
        (r"(?md)^(#{1,6}\s*)\[([\d.]+)\s*\]", "$1$2. ", "["),
        (r"\n{3,}", "\n\n", "\n\n\n"),
    )


def bold_heading(line: Column) -> Column:
    """A line that is bold as a whole becomes a heading if it looks like one."""
    text = F.when(line.startswith("**"), F.regexp_extract(line, r"\A\*\*([^*]+)\*\*\z", 1)).otherwise("")
    caps = is_upper(text)
    first = F.left(text, F.lit(1))
    to = F.when(caps & (F.length(text) < 30), F.concat(F.lit("# "), text)).when(
        caps | ((F.length(text) < 60) & is_upper(first)), F.concat(F.lit("## "), text)
    )
    return F.when(text != "", F.coalesce(to, line)).otherwise(line)


def standard_clean(md: Column, compat: bool = False) -> Column:
    """The clean-up of a converted book. ``compat``: a navigation section goes up to the next top heading, and
    divs go with their content, and closing tags of tables go; otherwise sections end at the next heading of their
    level, divs are unwrapped and tables stay whole."""
    until = r"(?=^#[^#]|\z)" if compat else r"(?=^#{1,2}[^#]|\z)"
    md = _rewrite(
        md,
        (r"(?md)^##\s+(?:Pages|Guide|Landmarks)\s*\n\n[\s\S]*?" + until, "", "##"),
        (r"\{\.[\w-]+\}", "", "{."),
        (r"(?md)^(#{1,6})\s+\[([^\]]+)\][ \t]*$", "$1 $2", "["),
        (r"\\(['\"&])", "$1", "\\"),
        (r"\[\]\{#[^}]+\}", "", "[]{#"),
        (r"\{#[\w-]+\}", "", "{#"),
        (r"(?md)^:{3,}.*$", "", ":::"),
        (r"(?s)<div[^>]*>.*?</div>", "", "<div") if compat else (r"</?div[^>]*>", "", "div"),
        (r"(?s)<figure[^>]*>.*?</figure>", "[Image removed]", "<figure"),
        (r"!\[.*?\]\(\.?/images/[^)]+\)", "[Image removed]", "/images/"),
        (r"(?i)!\[\]\([^)]*\.(?:jpg|jpeg|png|gif|svg)\)", "[Image removed]", "![]("),
        (r"(?s)<!--.*?-->", "", "<!--"),
    )
    md = F.array_join(F.transform(F.split(md, "\n", -1), bold_heading), "\n")
    md = _rewrite(md, (r"(?md)^[ \t]*::: (?:ItemNumber|ItemContent|ClearBoth|booksection|section|chapter).*\n", "", "::: "), (r"(?md)^[ \t]*:::[ \t]*\n", "", ":::"))
    return _rewrite(
        _without_html_blocks(md),
        (r"\n{3,}", "\n\n", "\n\n\n"),
        (r"(?md)[ \t]+$", ""),
        (r"<(?!table|tr|td|th|thead|tbody)[^>]+>" if compat else r"<(?!/?(?:table|tr|td|th|thead|tbody)\b)[^>]+>", "", "<"),
        (r"(?md)^#{1,6}[ \t]*$", "", "#"),
        (r"\n{3,}", "\n\n", "\n\n\n"),
    )


def cleaned_book(md: Column, compat: bool = False) -> Column:
    """Books that score well are left alone, others get both clean-ups."""
    good = lambda x: optimization_score(artifact_counts(x)) >= GOOD_ENOUGH
    return bound(md, lambda x: F.when(good(x), x).otherwise(standard_clean(deep_clean(x), compat)))


#: Titles that are parts of a book.
BOOK_PARTS = ("DEDICATION", "INTRODUCTION", "CONCLUSION", "GLOSSARY", "REFERENCES", "RESOURCES", "APPENDIX", "FOREWORD", "PREFACE", "ACKNOWLEDGMENTS", "ABOUT THE AUTHOR", "TABLE OF CONTENTS", "INDEX")


def styled_heading(line: Column) -> Column:
    """A line of styled text becomes a heading whose level follows its words, weight and length."""
    pattern = r"\A\[(\*\*)?(.*?)(\*\*)?\]\{\.calibre\d+\}(.*)\z"
    bold, text, rest = F.regexp_extract(line, pattern, 1) != "", strip(F.regexp_extract(line, pattern, 2)), F.regexp_extract(line, pattern, 4)
    top = F.upper(text).rlike(r"CHAPTER\s+\d+") | F.upper(text).rlike(r"PART\s+[IVX0-9]+") | F.upper(text).isin(*BOOK_PARTS)
    level = F.when(top, "# ").when(bold & (F.length(text) > 35), "## ").when(bold, "### ").otherwise("#### ")
    skip = ~line.rlike(pattern) | (text == "") | text.isin(":", "-", "*", "**")
    return F.when(skip, line).otherwise(F.concat(level, text, rest))


def styled_headings(md: Column) -> Column:
    return F.array_join(F.transform(F.split(md, "\n", -1), styled_heading), "\n")


#: Lines that begin promotion, tried on stripped lines without regard to case.
PROMOTION = (
    r"^#+\s*subscribe", r"^#+\s*sign\s*up", r"^#+\s*join\s*(our|the)", r"^#+\s*get\s*(our|the|updates)", r"^#+\s*stay\s*(updated|informed|ahead)", r"^#+\s*newsletter",
    r"^#+\s*(related|more|other|similar)\s*(posts?|articles?|content|reading)", r"^#+\s*you\s*(might|may)\s*(also\s*)?(like|enjoy)", r"^#+\s*recommended", r"^#+\s*from\s+the\s+(library|blog|archive)", r"^#+\s*content\s+from", r"^#+\s*(also|more)\s+on",
    r"^#+\s*share\s+this", r"^#+\s*follow\s+us", r"^#+\s*connect\s+with", r"^#+\s*about\s+the\s+author",
    r"^\*?do you have.*share with our community", r"^\*?join our contributor", r"^\*?we want to hear from you",
    r"^#+?\s*responses?\s*\(\d+\)", r"^responses?\s*\(\d+\)", r"^\*?\*?responses?\*?\*?\s*\(\d+\)",
    r"subscribe\s+here\.?\s*$", r"(million|thousand)\s+people\s+have\s+(used|read)", r"work with the best (designers|developers)",
    r"^bravo!", r"^well said", r"^thank you", r"^i (very much )?(appreciate|agree|love)",
)


#: Strings of which a text that any of these patterns fits holds one, in lower case.
PROMOTION_SIGNS = (
    "#", "do you have", "join our contributor", "we want to hear from you", "response", "subscribe", "people", "work with the best", "bravo!", "well said", "thank you", "i appreciate", "i agree", "i love", "i very much",
)


def without_promotion(md: Column) -> Column:
    """Up to the first line that begins promotion, unless less than half of the lines were left."""
    low, possible = F.lower(md), F.lit(False)
    for sign in PROMOTION_SIGNS:
        possible = possible | F.contains(low, F.lit(sign))
    return F.when(possible, _cut_at_promotion(md)).otherwise(md)


def _cut_at_promotion(md: Column) -> Column:
    def begins(x: Column) -> Column:
        possible = lambda low: reduce(or_, [F.contains(low, F.lit(sign)) for sign in PROMOTION_SIGNS])
        return bound(F.lower(x), possible) & strip_bound(x).rlike("(?i)" + "|".join(f"(?:{p})" for p in PROMOTION))

    def cut(lines: Column) -> Column:
        kept = lambda hit: F.when((hit > 0) & (hit - 1 >= F.size(lines) * 0.5), F.slice(lines, F.lit(1), (hit - 1).cast("int"))).otherwise(lines)
        return F.array_join(bound(F.array_position(F.transform(lines, begins), True), kept), "\n")

    return bound(F.split(md, "\n", -1), cut)


def noise_line(line: Column) -> Column:
    """Five characters or more of which less than 30 % are ASCII letters and digits."""
    noisy = lambda size: (size >= 5) & (F.regexp_count(line, F.lit("[a-zA-Z0-9]")) / size < 0.3)
    return bound(F.length(strip_bound(line)), noisy)


def clean_for_retrieval(md: Column, keep_tables: bool = True) -> Column:
    """Promotion, garbage characters, runs and lines, blank runs, heading spacing, empty links and images, entities.
    ``keep_tables``: rows of tables aren't noise."""
    md = F.regexp_replace(without_promotion(md), r"[^\n\r\t\x20-\x7E\x{A0}-\x{1FFF}\x{2010}-\x{FFFF}]", "")
    md = F.regexp_replace(md, r"(.)\1{10,}", "$1$1$1")
    noise = lambda x: noise_line(x) & ~x.rlike(r"\A\s*(?:\|.*\||[\s:|-]*---[\s:|-]*)\s*\z") if keep_tables else noise_line(x)
    md = F.array_join(F.filter(F.split(md, "\n", -1), lambda x: ~noise(x)), "\n")
    md = F.regexp_replace(md, r"\n{3,}", "\n\n")
    md = _rewrite(
        md,
        (r"(?U)[\s&&[^\n]]++(?=\n|\z)", ""),
        (r"([^\n])\n(#{1,6}\s)", "$1\n\n$2"),
        (r"(?md)^#{1,6}[ \t]*$", ""),
        (r"\[([^\]]+)\]\(\s*\)", "$1"),
        (r"\[([^\]]+)\]\(#[^)]*\)", "$1"),
        (r"!\[\s*\]\([^)]+\)", ""),
    )
    return F.concat(strip(unescape(md)), F.lit("\n"))


#: Lines that a page layout leaves in the text.
PAGE_LINES = (r"\A#*\s*\d{1,4}\s*\z", r"\A#*\s*[A-Z]\.\s*[A-Z][a-z]+\s+et\s+al\.\s*/\s*Journal", r"\A#*\s*Journal\s+of\s+.+\d{4}.+\d+[–-]\d+\s*\z", r"Elsevier Science|0092-6566", r"\A#*\s*(?i:doi:)")


def page_line(line: Column) -> Column:
    return strip(line).rlike("|".join(f"(?:{p})" for p in PAGE_LINES))


def without_page_lines(md: Column) -> Column:
    return F.array_join(F.filter(F.split(md, "\n", -1), lambda x: ~page_line(x)), "\n")


def without_first_page_matter(lines: Column) -> Column:
    """Lines of a paper's first page without masthead, addresses and footnotes (from ``q `` or ``*`` to a blank line or ``1.``)."""
    start = F.struct(F.lit(False).alias("note"), F.array().cast("array<string>").alias("kept"))

    def step(acc, line):
        text = strip(line)
        opens = text.rlike(r"\A(?:q |\*)")
        ends = (text == "") | text.startswith("1.")
        note = F.when(opens, True).when(acc["note"] & ends, False).otherwise(acc["note"])
        drop = note | text.rlike(r"(?i)\A(?:www\.|https?://|journal of |available online)")
        return F.struct(note.alias("note"), F.when(drop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    return F.aggregate(lines, start, step, lambda acc: acc["kept"])


#: What a heading of promotion, of noise and of a paper's section says.
PROMOTION_WORDS = ("subscribe", "newsletter", "sign up", "follow us", "related", "more from", "you might", "recommended", "share this", "about the author", "join our", "connect with")
NOISE_STARTS = ("Note.", "Note:", "Table", "Figure", "ðN", "Mean", "SD", "BFI", "TIPI", "FIPI", "NEO", "Extraversion", "Agreeableness", "Conscientiousness", "Emotional", "Openness")
PAPER_SECTIONS = ("abstract", "introduction", "background", "methods", "method", "methodology", "results", "discussion", "conclusion", "conclusions", "references", "acknowledgments", "appendix", "related work", "evaluation", "limitations")


def outline(md: Column) -> Column:
    """array<struct<text, level>> of all headings but those of promotion; code fences aren't looked at."""
    heads = F.filter(F.split(md, "\n", -1), lambda x: x.rlike(r"\A#{1,6}\s+.+"))
    entries = F.transform(
        heads, lambda x: F.struct(strip(F.regexp_extract(x, r"\A#{1,6}\s+(.+)\z", 1)).alias("text"), F.length(F.regexp_extract(x, r"\A(#{1,6})", 1)).alias("level"))
    )
    return F.filter(entries, lambda e: (F.length(e["text"]) >= 2) & ~F.lower(e["text"]).rlike("|".join(PROMOTION_WORDS)))


def outline_noise(text: Column) -> Column:
    """Headings that a page layout makes of numbers, running heads, table labels and authors."""
    starts = F.lit(False)
    for s in NOISE_STARTS:
        starts = starts | text.startswith(s)
    author = text.rlike(r"\A[A-Z][a-z]+,?\s+[A-Z]") & ~F.contains(text, F.lit("(")) & (F.size(F.split(text, r"\s+")) <= 10)
    return text.rlike(r"\A[\d.\-]+\z") | text.rlike(r"Journal of|et al\.") | (F.length(text) < 5) | (starts & (F.length(text) < 30)) | author


def paper_outline(md: Column) -> Column:
    """The outline of a paper: numbered, known or long top headings; null if fewer than three are left."""
    found = F.filter(
        F.filter(outline(md), lambda e: ~outline_noise(e["text"])),
        lambda e: e["text"].rlike(r"\A\d+(\.\d+)*\.?\s") | F.lower(e["text"]).isin(*PAPER_SECTIONS) | ((F.length(e["text"]) > 10) & (e["level"] <= 2)),
    )
    return F.when(F.size(found) >= 3, found)


def render_outline(entries: Column) -> Column:
    """A list, indented by level from the highest one; null if there are fewer than three entries."""
    top = F.array_min(F.transform(entries, lambda e: e["level"]))
    rows = F.transform(entries, lambda e: F.concat(F.repeat(F.lit("  "), (e["level"] - top).cast("int")), F.lit("- "), e["text"]))
    return F.when(F.size(entries) >= 3, F.concat(F.lit("## Table of Contents\n\n"), F.array_join(rows, "\n"), F.lit("\n")))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _field(name: str, x: Column) -> Column:
    """name: "x"; null if x is null or empty."""
    return F.when(x != "", F.concat(F.lit(f"{name}: "), _quoted(x)))


def article_frontmatter(title, author, source, url, published, retrieved, minutes, tags, description, has_outline, version) -> Column:
    """YAML of a web article. All are columns; ``retrieved`` is a parameter, so that the text doesn't change by itself."""
    told = F.regexp_replace(F.replace(F.replace(description, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), "\r", "")
    told = F.when(F.length(told) > 500, F.concat(F.left(told, F.lit(497)), F.lit("..."))).otherwise(told)
    return F.concat_ws(
        "\n",
        F.lit("---"),
        _field("title", F.coalesce(title, F.lit("Untitled"))),
        _field("author", F.coalesce(author, F.lit("Unknown"))),
        F.concat(F.lit('source_name: "'), source, F.lit('"')),
        F.concat(F.lit('source_url: "'), url, F.lit('"')),
        _field("publication_date", published),
        _field("retrieved_date", retrieved),
        F.concat(F.lit("reading_time_minutes: "), minutes),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), _quoted(t))), "\n"))),
        F.when(told != "", F.concat(F.lit('description: "'), told, F.lit('"'))),
        F.when(has_outline, F.lit("has_toc: true")),
        F.lit('content_type: "web_article"'),
        _field("converter_version", version),
        F.lit("---"),
    )


def book_frontmatter(title, author, year, version, processed) -> Column:
    """YAML of a book; empty if nothing is known of it."""
    known = F.concat_ws("\n", _field("title", title), _field("author", author), F.when(year != "", F.concat(F.lit("year: "), year)))
    return F.when(known == "", F.lit("")).otherwise(
        F.concat_ws("\n", F.lit("---"), known, _field("converter_version", version), _field("processed_date", processed), F.lit("---"), F.lit(""))
    )


def split_frontmatter(md: Column) -> tuple[Column, Column]:
    """Frontmatter and body; a fence counts at the very start only, and this applies once."""
    pattern = r"(?s)\A---[ \t]*\n(.*?)(?<=\n)---[ \t]*(?:\n|\z)\n*(.*)\z"
    found = md.rlike(pattern)
    return F.when(found, F.regexp_extract(md, pattern, 1)), F.when(found, F.regexp_extract(md, pattern, 2)).otherwise(md)


def frontmatter_value(front: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(front, rf'(?md)^{name}:[ \t]*"?(.*?)"?[ \t]*$', 1), F.lit(""))


def document_meta(front: Column, stem: Column) -> Column:
    """struct<title, author, year> from frontmatter, else from a stem ``Title - Author YYYY``."""
    pattern = r"\A(.+?) - (.+?)(?: (\d{4}))?\z"
    from_stem = lambda i: F.nullif(F.regexp_extract(stem, pattern, i), F.lit(""))
    year = F.coalesce(frontmatter_value(front, "year"), F.nullif(F.regexp_extract(F.coalesce(frontmatter_value(front, "publication_date"), F.lit("")), r"(\d{4})", 1), F.lit("")), from_stem(3))
    return F.struct(
        F.coalesce(frontmatter_value(front, "title"), from_stem(1), stem).alias("title"),
        F.coalesce(frontmatter_value(front, "author"), from_stem(2)).alias("author"),
        year.alias("year"),
    )


def render_table(rows: Column) -> Column:
    """Markdown of array<array<string>>: the first row is the header, others are padded or cut to its width."""
    plain = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def ruled(given: Column, width: Column) -> Column:
        full = lambda r: F.transform(F.transform(F.sequence(F.lit(0), width - 1), lambda i: plain(F.get(r, i))), strip_bound)
        under = lambda lines: F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
        return F.when((F.size(given) >= 1) & (width > 0), F.array_join(bound(F.transform(given, lambda r: line(full(r))), under), "\n"))

    return bound(rows, lambda given: bound(F.size(F.try_element_at(given, F.lit(1))), lambda width: ruled(given, width)))


def conversion_score(md: Column, chars: Column, pages: Column, tables: Column) -> dict[str, Column]:
    """How well Markdown keeps what a layout analysis found; an empty text has no readability."""
    kept = F.length(F.regexp_replace(md, r"(?U)\s+", ""))
    heads = count(md, r"(?md)^#{1,6}\s+.+$")
    found = F.floor(count(md, r"(?md)^\|.+\|$") / 3)
    garbage = F.when(F.length(md) > 0, count(md, CONTROLS) / F.length(md)).otherwise(F.lit(0.0))
    runs = count(md, r"(.)\1{5,}")
    completeness = F.when(chars > 0, F.least(F.lit(1.0), kept / (chars * 0.8))).otherwise(F.lit(0.5))
    structure = F.least(F.lit(1.0), heads / F.greatest(F.lit(3), F.floor(pages / 5)))
    integrity = F.when(tables > 0, F.least(F.lit(1.0), found / tables)).otherwise(F.lit(1.0))
    readable = F.when(F.length(md) > 0, F.greatest(F.lit(0.0), 1 - garbage * 10)).otherwise(F.lit(0.0)) * F.when(runs > 10, 0.8).otherwise(1.0)
    issues = F.filter(
        F.array(
            F.when(completeness < 0.5, "text may be missing"),
            F.when(heads < 2, "few or no headings"),
            F.when((tables > 0) & (found < tables), "tables may be missing"),
            F.when(garbage > 0.01, "garbage characters"),
            F.when(runs > 10, "repeated characters"),
        ),
        lambda x: x.isNotNull(),
    )
    return {
        "overall": completeness * 0.35 + structure * 0.20 + integrity * 0.25 + readable * 0.20,
        "completeness": completeness, "structure": structure, "table_integrity": integrity, "readability": readable, "issues": issues,
    }


def document_kind(chars: Column, pages: Column, tables: Column, figures: Column) -> Column:
    return (
        F.when((chars / pages <= 100) & (figures > 0), "scanned")
        .when(figures > pages * 0.5, "image_heavy")
        .when(tables > pages * 0.3, "table_heavy")
        .when((tables > 0) | (figures > 0), "mixed_layout")
        .otherwise("text_heavy")
    )


#: Extraction tools in the order they are tried.
TOOL_ORDER = {
    "scanned": ("ocr_marker", "ocr_pymupdf"), "text_heavy": ("pymupdf", "marker", "pdfplumber"), "table_heavy": ("pdfplumber", "marker", "pymupdf"),
    "image_heavy": ("marker", "pymupdf", "pdfplumber"), "mixed_layout": ("marker", "pdfplumber", "pymupdf"),
}


def tool_order(kind: Column) -> Column:
    pairs = [x for k, tools in TOOL_ORDER.items() for x in (F.lit(k), F.array(*map(F.lit, tools)))]
    return F.create_map(*pairs)[kind]
