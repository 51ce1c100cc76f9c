"""Text, URL and Markdown functions on hand-computed cases."""

import hashlib
import re
import time

import pytest

from pyspark.sql import functions as F

from docmill.functions import markdown as md
from docmill.functions import text as tx
from docmill.functions import urls
from docmill.operators import companion

pytestmark = pytest.mark.usefixtures("interpreted")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def each(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    return [r["x"] for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_numerals(spark):
    got = each(spark, tx.numerals, ["2008-2009 pp. 45-52 and -52, 10−12", "1,234.5 and 90%. 3.1997 x −42", "no", "5. 7,"])
    assert got == [["-52", "10", "12", "2008", "2009", "45", "52"], ["-42", "1234.5", "3.1997", "90"], [], ["5", "7"]]
    assert each(spark, tx.years, ["3.1997 in 2001, 20012 and 3000"]) == [["1997", "2001"]]


def test_numerals_match_a_python_model(spark):
    import random

    rng = random.Random(4)
    cases = ["".join(rng.choice("0123456789-−,.% ab\n") for _ in range(40)) for _ in range(300)]

    def model(t):
        found = (n.replace(",", "").rstrip("%").rstrip(".") for n in re.findall(r"(?<!\d)-?\d[\d,]*\.?\d*%?", t.replace("−", "-")))
        return sorted({n for n in found if n and n != "-"})

    assert each(spark, tx.numerals, cases) == [model(c) for c in cases]


def test_reading_time_rounds_half_to_even(spark):
    texts = [" ".join(["ab"] * n) for n in (0, 1, 337, 338, 563, 562)] + ["a b c", "été no"]
    assert each(spark, tx.reading_minutes, texts) == [1, 1, 1, 2, 3, 2, 1, 1]
    assert each(spark, tx.word_total, ["été no a", "ab_c d1e xy"]) == [1, 1]


def test_validity_names_and_tags(spark):
    good = "word " * 30
    assert each(spark, tx.content_valid, [good, "word " * 5, "中文" * 100, "\x01\x02\x03" * 100 + good, None]) == [True, False, False, False, False]
    assert each(spark, tx.name_like, ["Ann Lee", "x", "@ann", "http://x", "12 34", "Follow", "中文名", None]) == [True, False, False, False, False, False, False, False]
    assert each(spark, tx.valid_tag, ["databases", "ab", "Home page", "one two three four five", None]) == [True, False, False, False, False]
    assert each(spark, tx.academic_paper, ["Abstract of a University Department", "abstract only"]) == [True, False]


def test_file_names(spark):
    assert each(spark, tx.file_stem, ['a<b>: "c"/d__e', "x" * 90 + " " + "y" * 30, ""]) == ["ab cd e", "x" * 90, ""]
    row = spark.createDataFrame([("A: B (x)", "C. D", "1999", "3rd Edition")], "t string, a string, y string, e string")
    assert row.select(tx.book_file_name(F.col("t"), F.col("a"), F.col("y"), F.col("e"), F.lit("s"))).first()[0] == "A B x - C. D 1999 3rd Ed.md"
    web = spark.createDataFrame([(None, None, None, "https://www.site.org/a/my-first_post/"), ("", "T", "Paper", "http://x/")], "a string, t string, s string, u string")
    got = [r[0] for r in web.select(tx.article_file_name(F.col("a"), F.col("t"), F.col("s"), F.col("u"))).collect()]
    assert got == ["Unknown Author - My First Post - Site.md", "Unknown Author - T - Paper.md"]
    assert each(spark, tx.companion_path, ["/a/b.md", "/a.x/b"]) == ["/a/b.rag.md", "/a.x/b.rag.md"]


def test_dates(spark):
    cases = ["2020-03-04T23:30:00-05:00", "2020-03-04T01:02:03Z", "2020-03-04", "March 4, 2020", "Mar 4, 2020", "4 March 2020", "03/04/2020", "25/12/2020", "on 2020-01-02!", "soon", ""]
    assert each(spark, tx.iso_date, cases) == ["2020-03-04"] * 6 + ["2020-03-04", "2020-12-25", "2020-01-02", "soon", None]
    assert each(spark, tx.layout_date, ["D:20210203120000Z"]) == ["2021-02-03"]


def test_small_text_functions(spark):
    assert each(spark, tx.question_shape, ["Why", "Why?!.", "Why?", None]) == ["Why?", "Why?", "Why?", "?"]
    assert each(spark, lambda c: tx.subject_first(c, F.lit("S")), ["It is", "Item", "These are", "Theses"]) == ["S: It is", "Item", "S: These are", "Theses"]
    assert each(spark, tx.section_key, ["**Pages**", "# Guide:", "Intro"]) == ["pages", "guide", "intro"]
    assert each(spark, tx.strip_fences, ['```json\n{"a":1}\n```', " {} "]) == ['{"a":1}', "{}"]
    assert each(spark, lambda c: tx.preview(c, F.lit("pipe")), ["| a | b |\n| c |", "|", "x" * 50]) == ["a | b", "pipe", "x" * 40 + "…"]
    assert each(spark, tx.longest_title_part, ["A | A longer part | B", "one - two", "plain"]) == ["A longer part", "one", "plain"]
    assert each(spark, tx.html_title, ["<title>t</title><h1> a <b>b</b></h1>", "<h2>x</h2>", "<p>"]) == ["a b", "x", None]
    assert each(spark, tx.tidy, ["a  \n\n\n\nb\n\n"]) == ["a\n\nb\n"]
    assert each(spark, tx.cut_by_paywall, ["... Already a Subscriber? ...", "free", None]) == [True, False, False]
    assert one(spark, tx.keep_order_distinct(F.array(*map(F.lit, (" b", "A", "a", "", "B ", "c"))))) == ["b", "A", "c"]
    assert one(spark, tx.redact(F.lit("key k1 failed"), "k1")) == "key ••• failed"


def test_distinct_in_order_takes_long_lists(spark):
    """Twenty thousand spellings of ten thousand words take seconds; looking each up in the list took its square."""
    begun = time.monotonic()
    items = F.expr("transform(sequence(0, 19999), i -> if(i % 3 = 0, concat(' W', i % 10000), concat('w', i % 10000)))")
    got = one(spark, tx.keep_order_distinct(items))
    assert got == [f"{'W' if i % 3 == 0 else 'w'}{i}" for i in range(10_000)] and time.monotonic() - begun < 20
    assert one(spark, tx.keep_order_distinct(F.array(*map(F.lit, ("b", None, "B"))))) == ["b"]
    assert one(spark, tx.keep_order_distinct(F.lit(None).cast("array<string>"))) is None


def test_retries(spark):
    df = spark.createDataFrame([(1, None), (2, 40.0), (3, 90.0), (4, None)], "n int, asked double")
    assert [r[0] for r in df.select(tx.backoff(F.col("n"), F.col("asked"))).collect()] == [2.0, 40.0, 60.0, None]
    assert each(spark, tx.retry_after, ["{'retryDelay': '17s'}", "no"]) == [17.0, None]
    assert one(spark, tx.final_error(F.lit(403), F.lit("x"))) and not one(spark, tx.final_error(F.lit(503), F.lit("busy")))


def test_signature_is_the_same_for_every_chapter(spark):
    df = spark.createDataFrame([("ordering", True, 'Chapter 3: "Fig. 12" isn’t there!')], "c string, s boolean, t string")
    got = df.select(tx.signature(F.col("c"), F.col("s"), F.col("t"))).first()[0]
    assert got == hashlib.sha256(b"ordering|True|chapter fig isnt there").hexdigest()[:16]


def test_urls(spark):
    page = lambda u: (urls.page_param(u), urls.page_number(u))
    cases = ["http://a/?p=2&page=3", "http://a/?pg=4", "http://a/?page=x&paged=5", "http://a/?page=1&page=7", "http://a/", "http://a/?page="]
    assert each(spark, lambda u: page(u)[0], cases) == ["page", "pg", "paged", "page", None, None]
    assert each(spark, lambda u: page(u)[1], cases) == [3, 4, 5, 7, None, None]
    assert each(spark, lambda u: urls.page_url(u, F.lit("page"), F.lit(9)), ["http://a/x?b=1&page=2#f", "http://a/?b=1"]) == ["http://a/x?b=1&page=9#f", "http://a/?b=1&page=9"]
    hosts = ["https://old.Reddit.com/x", "http://notreddit.com", "https://redd.it/a", "not a url", None]
    assert each(spark, urls.is_thread, hosts) == [True, False, True, False, False]
    assert each(spark, urls.is_gift, ["http://x/?test=1", "http://x/?a=1"]) == [True, False]
    assert each(spark, urls.is_paywalled, ["https://www.ft.com/", "https://left.com/"]) == [True, False]


CLEAN = '---\ntitle: "T"\n---\n# One\n\ntext\n\n## Two\n\n- a\n- b\n'
DIRTY = "# One {#a .b}\n``{=html}\n[x]{.c} [y]{.d}\n> ::: {}\n![i](a.png){width=3}\n"


def test_scores(spark):
    def scored(t):
        return one(spark, md.optimization_score(md.artifact_counts(F.lit(t))))

    assert scored(CLEAN) == 100.0 and scored("") == 100.0
    counts = {k: one(spark, c) for k, c in md.artifact_counts(F.lit(DIRTY)).items()}
    assert counts == {"line_count": 6, "html_blocks": 1, "header_ids": 1, "citations": 0, "image_attrs": 1, "bracket_classes": 2, "xhtml_links": 0, "blockquote_divs": 1}
    assert scored(DIRTY) == 0.0 and scored("``{=html}\n" * 500) == 0.0
    assert scored(CLEAN * 20 + DIRTY) < scored(CLEAN * 20) - 5  # the gate has teeth


def test_cleaning(spark):
    dirty = "# []{#x}[A]{.t}\n``{=html}\n[[12](#c){.biblioref}]\n![i](a.png){w=1}\n[t]{.c}\n[z](#3_a.xhtml)\n> ::: {}\n# []\n## [1.2] S\n"
    assert one(spark, md.deep_clean(F.lit(dirty))) == "# [A]\n[12]\n![i](a.png)\n[t]\n[z]\n\n## 1.2.  S\n"
    text = "## Pages\n\n1. [i](#p)\n\n## Kept\n\n**CHAPTER ONE**\n\n**A Title**\n\n**lower**\n\nIt\\'s <div id='x'>in</div> <span>y</span><table></table>\n::: {.x}\n[]{#a}# \n# Top\n<div>out</div>z"
    assert one(spark, md.standard_clean(F.lit(text))) == "## Kept\n\n# CHAPTER ONE\n\n## A Title\n\n**lower**\n\nIt's in y<table></table>\n\n# Top\noutz"
    assert one(spark, md.standard_clean(F.lit(text), compat=True)) == "# Top\nz"


def test_retrieval_cleaning(spark):
    text = "Intro\n# Head\n" + "a" * 20 + "\n%%%% ---- $$$$\n| a | b |\n|---|---|\nfish &amp; chips \U0001f600\u200b!  \n\n\n\nsome [x]() words [y](#z) here ![](q.png)\n## \n## Newsletter\nbuy"
    assert one(spark, md.clean_for_retrieval(F.lit(text))) == "Intro\n\n# Head\naaa\n| a | b |\n|---|---|\nfish & chips !\n\nsome x words y here\n"
    assert "|" not in one(spark, md.clean_for_retrieval(F.lit(text), keep_tables=False))
    early = "## Subscribe\n" + "x\n" * 10
    assert one(spark, md.without_promotion(F.lit(early))) == early  # more than half would go


def test_styled_lines_and_page_lines(spark):
    assert each(spark, md.styled_heading, ["[**Part IV**]{.calibre2}", "[x]{.calibre3} y", "[-]{.calibre1}", "plain"]) == ["# Part IV", "#### x y", "[-]{.calibre1}", "plain"]
    assert each(spark, md.page_line, ["# 12", "12345", "DOI: 10", "J. Smith et al. / Journal of A", "text"]) == [True, False, True, True, False]
    got = one(spark, md.without_first_page_matter(F.array(*map(F.lit, ("Title", "www.x.org", "* note", "more note", "", "Body", "q foot", "1. Intro")))))
    assert got == ["Title", "", "Body", "1. Intro"]


def test_outlines(spark):
    entries = one(spark, md.outline(F.lit("# A b\n## Follow us\n### C\nx\n#nospace\n## Dd")))
    assert [(e["text"], e["level"]) for e in entries] == [("A b", 1), ("Dd", 2)]
    text = "# 1 Methods\n# 12\n# Table 1\n# Smith, J\n# Introduction\n## A long section title here\n"
    assert [e["text"] for e in one(spark, md.paper_outline(F.lit(text)))] == ["1 Methods", "Introduction", "A long section title here"]
    assert one(spark, md.paper_outline(F.lit("# Introduction"))) is None


def test_frontmatter(spark):
    body = '---\ntitle: "A"\nyear: 1999\n---\n\n---\npage'
    front, rest = md.split_frontmatter(F.lit(body))
    assert one(spark, front) == 'title: "A"\nyear: 1999\n' and one(spark, rest) == "---\npage"
    assert one(spark, md.split_frontmatter(F.lit("x\n---\n"))[0]) is None
    m = one(spark, md.document_meta(F.lit(""), F.lit("Some Title - An Author 2004")))
    assert tuple(m) == ("Some Title", "An Author", "2004")
    null = F.lit(None).cast("string")
    assert one(spark, md.book_frontmatter(null, null, null, F.lit("1"), F.lit("d"))) == ""
    assert one(spark, md.book_frontmatter(F.lit('A "b"'), null, F.lit("2001"), F.lit("1"), F.lit("d"))) == '---\ntitle: "A \\"b\\""\nyear: 2001\nconverter_version: "1"\nprocessed_date: "d"\n---\n'


def test_tables_and_conversion(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1\n2"), F.lit(None), F.lit("x")))
    assert one(spark, md.render_table(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 2 |  |"
    s = md.conversion_score(F.lit("# A\n# B\n# C\n" + "word " * 40), F.lit(100), F.lit(3), F.lit(0))
    assert one(spark, s["overall"]) == pytest.approx(1.0) and one(spark, s["issues"]) == []
    empty = md.conversion_score(F.lit(""), F.lit(100), F.lit(3), F.lit(1))
    assert one(spark, empty["readability"]) == 0.0 and len(one(spark, empty["issues"])) == 3
    assert one(spark, md.document_kind(F.lit(50), F.lit(1), F.lit(0), F.lit(1))) == "scanned"
    assert one(spark, md.tool_order(F.lit("table_heavy"))) == ["pdfplumber", "marker", "pymupdf"]


def test_precheck(spark):
    counts = {k: one(spark, c) for k, c in md.precheck_counts(F.lit("# A {x}\nALL CAPITALS HERE\n[b]{.calibre1}\n[]{#a}\nrole=x")).items()}
    assert (counts["headings"], counts["caps_lines"], counts["calibre_markers"], counts["anchor_markers"], counts["role_attrs"]) == (1, 1, 1, 1, 1)
    lit = {"lines": 2000, "headings": 0, "calibre_markers": 0, "anchor_markers": 0, "caps_lines": 0, "html_blocks": 201, "role_attrs": 51, "bracket_classes": 501}
    score, issues, what = md.precheck({k: F.lit(v) for k, v in lit.items()})
    assert one(spark, score) == 15.0 and len(one(spark, issues)) == 4 and one(spark, what) == "skip"


def test_long_values_are_made_once(spark):
    """Rendering, splitting and cleaning hold what they use in several places; each was made anew for every element."""
    begun = time.monotonic()
    rows = F.expr("transform(sequence(0, 3000), i -> array(concat(' a', i), 'b|c'))")
    table = one(spark, md.render_table(rows)).split("\n")
    assert len(table) == 3002 and table[:2] == ["| a0 | b\\|c |", "| --- | --- |"] and table[-1] == "| a3000 | b\\|c |"
    words = [f"w{i}." for i in range(60_000)]
    pieces = each(spark, companion.split_block, [" ".join(words), "\n".join(words)])
    assert [len(p) for p in pieces] == [120, 120] and " ".join(pieces[0]).split() == words and "\n".join(pieces[1]).split("\n") == words
    lines = [f"plain line {i}" for i in range(3000)]
    kept = each(spark, md.without_promotion, ["\n".join([*lines, "## Subscribe", "x"]), "\n".join(["## Subscribe", *lines])])
    assert kept == ["\n".join(lines), "\n".join(["## Subscribe", *lines])]
    assert time.monotonic() - begun < 60


def test_signs_are_in_all_that_their_patterns_match(spark):
    text = "# A {#p .x}\n\n[[12](#c1){.biblioref}] ![a](b){w=3} [n]{.s} [x](#3_a.xhtml#q)\n> ::: {}\n"
    got = one(spark, F.struct(*[c.alias(k) for k, c in md.artifact_counts(F.lit(text)).items()]))
    assert [got[k] for k in md.ARTIFACTS] == [1, 1, 1, 1, 1, 1] and got["line_count"] == 5
    assert one(spark, md.artifact_counts(F.lit(None).cast("string"))["citations"]) is None
