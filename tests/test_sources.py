import gzip
import io
import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.sources import epub, extras, files, html, signals
from docmill.streaming import ledger as streams

PAGE = """<html><head><title>Site | A good long title</title><meta property="og:title" content="OG &amp; title"><meta name="author" content="Ann Lee"><meta name="keywords" content="beta, alpha">
<script type="application/ld+json">[{"@type": "Person"}, {"@graph": [{"@type": ["NewsArticle"], "headline": "LD", "datePublished": "2020-03-04T10:00:00Z", "author": [{"name": "Bo"}]}]}]</script></head>
<body><nav><a href="/n">nav</a></nav><div class="ad">ad</div><article><h1>Head</h1><p>Some <b>bold <a href="/x">link</a></b> text<br>next %s</p><ul><li>one<ul><li>in</li></ul><li>two</ul>
<pre><code class="language-py">a
  b</code></pre><blockquote><p>q</p></blockquote><table><tr><th>h<td>i</tr><tr><td>1|2</tr></table><b>unclosed</article><img src="/a.png" alt="A" width="300"><img src="/p.gif" width="1"><footer>foot</footer></body>""" % ("word " * 120)


def test_markdown_of_a_page():
    row = dict(zip(("page_id", "url", "meta", "ld", "title_tag", "h1", "authors", "times", "tags", "images", "markdown", "text"), html.parse(1, "http://s.org/d/", PAGE)))
    m = row["markdown"]
    assert "# Head" in m and "Some **bold [link](http://s.org/x)** text" in m and "- one\n  - in\n- two" in m and "```py\na\n  b\n```" in m and "> q" in m
    assert "| h | i |\n| --- | --- |\n| 1\\|2 |  |" in m and "**unclosed**" in m and "nav" not in m and "foot" not in m and "\nad" not in m
    assert [i["url"] for i in row["images"]] == ["http://s.org/a.png", "http://s.org/p.gif"]


@pytest.mark.parametrize("text", [None, "", "<", "<p>a<p>b</i></div>c", "<table><tr><td>x", "&amp; plain", "<a " * 500, "<b>" * 3000])
def test_any_page_parses(text):
    assert isinstance(html.parse(1, None, text)[10], str)


def test_metadata_priority(spark):
    pages = spark.createDataFrame([(1, "http://www.s.org/d/", PAGE), (2, "http://t.org/", PAGE.replace("ld+json", "x")), (3, "http://t.org/", "<title>A | The longest part</title>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.metadata(html.parse_pages(pages)).collect()}
    assert (got[1]["title"], got[1]["author"], got[1]["publication_date"], got[1]["source_name"]) == ("LD", "Bo", "2020-03-04", "s.org")
    assert (got[2]["title"], got[2]["author"]) == ("OG & title", "Ann Lee") and got[2]["tags"] == ["alpha", "beta"]
    assert (got[3]["title"], got[3]["author"]) == ("The longest part", None)
    out = html.articles(pages, "2024-01-01", "1").filter("page_id = 1").first()
    assert out["n_images"] == 1 and out["valid"] and out["document"].startswith('---\ntitle: "LD"\nauthor: "Bo"') and out["file_name"] == "Bo - LD - s.org.md"


def test_articles_of_repeated_and_null_ids(spark):
    rows = [(1, "http://a.org/", PAGE), (1, "http://a.org/", PAGE), (1, "http://b.org/", "<h1>Another head</h1>"), (None, "http://c.org/", PAGE), (None, None, None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, body string, title string")
    out = html.articles(pages, "2024-01-01", "1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan
    got = [(r["page_id"], r["title"], r["n_images"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "LD", 1), (1, "LD", 1), (1, "Another head", 0), (None, "LD", 1), (None, None, 0)]))


def test_articles_of_no_pages(spark):
    assert html.articles(spark.createDataFrame([], "page_id long, url string, html string"), "d", "1").count() == 0


def book(path, spine="c2 c1", extra=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container xmlns="u"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        refs = "".join(f'<itemref idref="{i}"/>' for i in spine.split())
        z.writestr("O/c.opf", f'<package xmlns="p" xmlns:dc="d"><metadata><dc:title>T, Third Edition</dc:title><dc:creator>W</dc:creator><dc:date>2020</dc:date></metadata><manifest><item id="c1" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="x/ncx"/></manifest><spine>{refs}</spine></package>')
        z.writestr("O/a.xhtml", "<html><body><h1>First</h1><p>one &amp; two</p></body></html>")
        z.writestr("O/b.xhtml", f"<html><head><title>Second</title><style>x</style></head><body><p>{'long ' * 30}{extra}</p></body></html>")


def test_epub(spark, tmp_path):
    book(tmp_path / "good.epub", "c2 missing n c1")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_text("x")
    parts = epub.members(epub.scan(spark, str(tmp_path)))
    opf = epub.packages(parts)
    assert tuple(epub.metadata(opf).first())[1:] == ("T, Third Edition", "W", "2020", "Third Edition")
    rows = epub.chapters(parts, opf).orderBy("pos").collect()
    assert [(r["title"], r["href"]) for r in rows] == [("Second", "b.xhtml"), ("First", "a.xhtml")] and rows[1]["text"].endswith("one & two")
    cut = epub.chapters(parts, opf, chapter_chars=50, total_chars=40).collect()
    assert len(cut) == 1 and cut[0]["text"].endswith(epub.CUT)
    assert epub.summary(epub.chapters(parts, opf)).first()["titles"] == ["Second", "First"]
    assert epub.to_books(parts, opf).first()["markdown"].endswith("# First\n\none & two")
    assert opf.count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\ny")
    (tmp_path / "a.rag.md").write_text("z")
    assert [r["body"] for r in files.markdown_files(spark, str(tmp_path)).collect()] == ["x\ny"]
    (tmp_path / "l.json").write_text('{"n": 1}\n{broken\n')
    good, bad = files.json_table(spark, str(tmp_path / "l.json"), "n int")
    assert [r["n"] for r in good.collect()] == [1] and [r["text"] for r in bad.collect()] == ["{broken"]
    fits, others = files.gather(spark.createDataFrame([("b.epub",), ("a.EPUB",), ("b.epub",), ("c.pdf",), (None,)], "path string"))
    assert [r["path"] for r in fits.collect()] == ["a.EPUB", "b.epub"] and others.count() == 2
    names = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "a (1).md"), (4, "b")], "pos int, name string")
    made = [r["made"] for r in files.distinct_names(names).collect()]
    assert len(set(made)) == 4 and "a.md" in made
    docs = spark.createDataFrame([("web", "d1"), ("epub", "d2")], "source_kind string, document string")
    files.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    files.write_texts(docs, str(tmp_path / "txt"))
    assert any("d1" in p.read_text() for p in (tmp_path / "txt").glob("part-*"))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"signature": s}) for s in "aab"))
    stream = spark.readStream.schema("signature string").json(str(src))
    seen = []
    q = streams.upserts(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"))
    q.awaitTermination()
    assert seen == [(0, 3)]
    books = tmp_path / "books"
    books.mkdir()
    book(books / "b.epub")
    parts = epub.members(streams.arriving_files(spark, str(books)))
    assert streams.drain(parts.select("name"), str(tmp_path / "members"), str(tmp_path / "c2")).count() == 4
    counted = streams.occurrences(stream)
    streams.drain(counted, str(tmp_path / "occ"), str(tmp_path / "c3"))
    (src / "2.json").write_text("\n".join(json.dumps({"signature": s}) for s in "aaabc"))
    out = streams.drain(counted, str(tmp_path / "occ"), str(tmp_path / "c3")).collect()
    assert sorted(tuple(r) for r in out) == [("a", 1, 2, 1, 1, 0), ("a", 3, 5, 0, 0, 3), ("b", 1, 1, 1, 0, 0), ("b", 2, 2, 0, 1, 0), ("c", 1, 1, 1, 0, 0)]


def test_a_stream_stops_when_asked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    query = spark.readStream.schema("n int").json(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    asked = []
    assert streams.stop_when(query, lambda: asked.append(1) or len(asked) > 1, every=0.2) and not query.isActive


BLOG = """<article><h1><span>x</span><span data-br="1">A balanced title</span></h1><p>body text</p><section class="responses"><p>noise one</p></section>
<div>Responses (3) <p>noise two</p></div><p>Thank you so much</p><div class="postMeta">9 followers 3 following</div><p>Subscribe here.</p><p>noise three</p></article>
<div><a href="https://medium.com/@annlee">annlee</a> <a href="https://medium.com/@annlee">Ann Lee</a></div><span>4 min read</span><a href="/tag/data">Data</a><a href="/tag/data">Data</a><a href="/x?query=Hiring">Hiring</a><a href="/x?query=z">See all jobs</a>"""


def test_blog_responses_go_and_signals_stay(spark):
    pages = spark.createDataFrame([(1, "https://medium.com/@a/b", BLOG), (2, "https://other.org/b", BLOG), (3, None, None)], "page_id long, url string, html string")
    parsed = html.parse_pages(pages)
    got = {r["page_id"]: r for r in parsed.select("page_id", "markdown", "shown_title", signals.author().alias("a"), signals.minutes().alias("m"), signals.tags().alias("t")).collect()}
    assert "body text" in got[1]["markdown"] and not any(x in got[1]["markdown"] for x in ("noise", "Thank you", "followers", "Subscribe"))
    assert "noise one" in got[2]["markdown"] and "noise three" in got[2]["markdown"]
    assert (got[1]["shown_title"], got[1]["a"], got[1]["m"], got[1]["t"]) == ("A balanced title", "Ann Lee", 4, ["Data", "Hiring"])
    assert got[2]["a"] is None and got[3]["m"] is None and got[3]["t"] == []


@pytest.mark.parametrize(("page", "name"), [
    ('<li><img alt="Photo of Bo Chen"><span>Photo by</span><span>Bo Chen</span></li>', "Bo Chen"), ('<p class="authorName">Written by Kim Ode</p>', "Kim Ode"), ('<a href="/team/x">Lu Xun</a>', "Lu Xun"), ("<p>none</p>", None),
])
def test_author_signals(spark, page, name):
    pages = spark.createDataFrame([(1, "http://a.org/", page)], "page_id long, url string, html string")
    assert html.parse_pages(pages).select(signals.author()).first()[0] == name


def test_contents_of_a_page():
    marked = html.parse(1, None, '<h1>T</h1><div class="TOC"><a>One</a><a></a><a>Two</a></div><h2>U</h2>')[-1]
    plain = html.parse(1, None, f"<h1>Out</h1><main><h2>In</h2><h3>{'x' * 200}</h3><h5>no</h5></main>")[-1]
    assert [(c["text"], c["level"]) for c in marked] == [("One", 2), ("Two", 2)] and [(c["text"], c["level"]) for c in plain] == [("In", 2)]


def test_bodies_beyond_the_limit(monkeypatch):
    import gzip
    import zlib

    from docmill.sources import extras

    monkeypatch.setattr(extras, "MOST_BODY", 1000)
    for size, want in ((1000, b"a" * 1000), (1001, None), (100_000, None)):
        assert extras.decoded(gzip.compress(b"a" * size), "gzip") == extras.decoded(zlib.compress(b"a" * size), "deflate") == want
    assert extras.decoded(gzip.compress(b"abc" * 50)[:-12], "gzip") is None


def test_files_and_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a.md", "ä"), ("b.md", None), (None, "x")], "file_name string, document string")
    for _ in range(2):
        assert [tuple(r) for r in files.write_files(rows, folder).collect()] == [("a.md", 2)]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.md"] and (tmp_path / "out" / "a.md").read_text() == "ä"
    ledger = f"file://{tmp_path}/ledger"
    assert files.load_version(spark, ledger, "n long").count() == 0
    for n in range(12):
        files.save_version(files.load_version(spark, ledger, "n long").unionByName(spark.createDataFrame([(n,)], "n long")), ledger)
    assert files.load_version(spark, ledger, "n long").count() == 12


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "docmill"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    copy = tmp_path / "docmill"
    copy.mkdir()
    for p in (root / "docmill").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (copy / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    entry = tmp_path / "__spark_entry__.py"
    entry.unlink()
    entry.write_text((root / "__spark_entry__.py").read_text())
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) > 50


def test_text_functions_take_nulls(spark):
    df = spark.createDataFrame([(None,)], "s string")
    for f in (tx.numerals, tx.years, tx.token_estimate, tx.iso_date, tx.html_title, tx.tidy, tx.unescape):
        assert df.select(f(F.col("s")).alias("x")).first()["x"] is None


def test_bodies_decode(spark):
    import gzip
    import zlib

    import zstandard

    from docmill.sources.extras import decoded

    raw = b"<p>x</p>" * 50
    assert decoded(gzip.compress(raw), "gzip") == decoded(zlib.compress(raw), "deflate") == decoded(zlib.compress(raw, wbits=-15), "deflate") == raw
    assert decoded(zstandard.compress(raw), "zstd") == decoded(raw, None) == decoded(gzip.compress(zlib.compress(raw)), "deflate, gzip") == raw
    assert decoded(b"broken", "gzip") is decoded(b"broken", "zstd") is decoded(raw, "br") is decoded(None, "gzip") is None


def test_images_and_frontmatter(spark):
    from docmill.sources import extras

    image = lambda u, a: F.struct(F.lit(u).alias("url"), F.lit(a).alias("alt"))
    images = F.array(image("http://x/lead-logo.png", "Logo"), image("http://x/icon.png", "an icon"), image("http://x/1x1.gif", ""), image("http://x/a.png", "A"))
    got = spark.range(1).select(F.transform(extras.article_images(images, F.lit("http://x/lead-logo.png")), lambda i: i["url"])).first()[0]
    assert got == ["http://x/lead-logo.png", "http://x/a.png"]
    front = extras.layout_frontmatter(*map(F.lit, ("", "", "/d/My File.pdf", "D:20200102", "2024-01-01", 3, 9, 1, 2, 0.876, "marker", "pymupdf")), F.lit(False), F.lit("mixed_layout"), F.lit("1"))
    text = spark.range(1).select(front).first()[0]
    assert 'title: "My File"' in text and 'publication_date: "2020-01-02"' in text and "extraction_confidence: 0.88" in text and "ocr_applied: false" in text
    tables = spark.createDataFrame([(1, 0, 1, "| a |\n| - |\n| b |"), (1, 0, 2, "| x |")], "doc_id int, page int, seq int, md string")
    texts = spark.createDataFrame([(1, 0, "text")], "doc_id int, page int, md string")
    assert extras.pages_with_tables(texts, tables).first()["markdown"] == "| a |\n| - |\n| b |\n\ntext"


def test_progress_and_appended_runs(spark, tmp_path):
    from docmill.operators import ledger

    said = []
    listener = streams.Progress(said.append)
    spark.streams.addListener(listener)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text('{"n": 1}')
    streams.drain(spark.readStream.schema("n int").json(str(tmp_path / "s")), str(tmp_path / "p"), str(tmp_path / "c"))
    spark.streams.removeListener(listener)
    runs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "run int, ts int")
    ledger.append_runs(runs, str(tmp_path / "ledger"))
    assert sorted(r["run"] for r in ledger.append_runs(runs.selectExpr("run + 3 AS run", "ts + 30 AS ts"), str(tmp_path / "ledger"), keep=4).collect()) == [3, 4, 5, 6]


def test_python_steps_see_small_batches(spark):
    """What a worker holds at once follows neither the partition nor 10,000 rows."""
    from docmill.operators import chunks
    from docmill.operators.batches import BATCH_BYTES, BATCH_CONF, map_batches

    long = spark.range(0, 30, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a.b").alias("url"), F.repeat(F.lit("x"), 1_000_000).alias("html"))
    sizes = lambda batch: iter([pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])])
    assert max(r["n"] for r in map_batches(long, sizes, "n long").collect()) < BATCH_BYTES + 2_000_000
    packed = spark.createDataFrame([(i, gzip.compress(b"y" * 3_000_000), "gzip") for i in range(6)], "page_id long, body binary, encoding string")
    for step in (lambda: html.parse_pages(long), lambda: chunks.pack(long, 500, "html", "page_id"), lambda: extras.decode_bodies(packed)[0], lambda: epub.members(spark.createDataFrame([], "path string, content binary"))):
        spark.conf.set(BATCH_CONF, 64 << 20)
        step()
        assert int(spark.conf.get(BATCH_CONF)) == BATCH_BYTES
    assert [len(r["html"]) for r in extras.decode_bodies(packed)[0].orderBy("page_id").collect()] == [3_000_000] * 6


def test_members_know_their_package(spark):
    def book(container):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", container)
            for n in ("a.opf", "b.opf"):
                z.writestr(n, f"<package><metadata><title>{n}</title></metadata></package>")
        return out.getvalue()

    books = [("one", book('<rootfile full-path="b.opf"/>')), ("none", book("<x/>")), ("bad", b"no archive")]
    parts = epub.members(spark.createDataFrame(books, "path string, content binary"))
    assert [tuple(r) for r in epub.packages(parts).select("path", "opf_name").collect()] == [("one", "b.opf")]
    plan = epub.packages(parts)._jdf.queryExecution().toString()
    assert "Join" not in plan  # a package is found in its archive, so that no member is unzipped twice or shuffled
