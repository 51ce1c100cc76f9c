"""Retrieval companions: digests of chunks, rolled up, assembled and checked against their source.

A distiller turns a chunk into a digest as JSON. It is a plain callable on (heading path, text), run in Arrow batches,
so that a model client fits as well as the deterministic one below, which needs no network.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import evidence
from docmill.operators.batches import map_batches
from docmill.operators.chunks import bin_starts, slices
from docmill.operators.lineage import cut

Distiller = Callable[[list[str], str], str]

DIGEST = (
    "struct<summary:string,keywords:array<string>,claims:array<string>,facts_numeric:array<string>,terms:array<struct<term:string,definition:string>>,"
    "qa:array<struct<q:string,a:string>>,entities:array<struct<name:string,kind:string,one_liner:string>>>"
)
ROLLUP = (
    "struct<executive_summary:string,thesis:array<string>,themes:array<struct<theme:string,synthesis:string,keywords:array<string>>>,"
    "glossary:array<struct<term:string,definition:string>>,question_bank:array<struct<q:string,a:string>>,entity_index:array<struct<name:string,kind:string,one_liner:string>>>"
)
FAILED = "(This part could not be distilled.)"
MOST_WORDS, MOST_KEYWORDS, MOST_QA, MOST_BANK, MOST_ROWS = 500, 10, 5, 60, 40
GROUP, GROUP_ABOVE_TOKENS = 10, 150_000
MOST_FAILED = 0.30
NONE = "_None found in this document._"

_STOP = frozenset("the a an and or of to in on for with by is are was were be this that it as at from".split())


def extractive(path: list[str], text: str) -> str:
    """A digest without a model: first sentences, frequent words, sentences with numbers."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    words = Counter(w for w in re.findall(r"[^\W\d_]{4,}", text.lower()) if w not in _STOP)
    top = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]]
    facts = [s for s in sentences if re.search(r"\d", s)][:5]
    return json.dumps(
        {
            "summary": " ".join(sentences[:2]), "keywords": top, "claims": sentences[:3], "facts_numeric": facts,
            "terms": [{"term": w, "definition": next((s for s in sentences if w in s.lower()), "")} for w in top[:2]],
            "qa": [{"q": f"What does {path[-1] if path else 'this part'} say", "a": sentences[0]}] if sentences else [],
            "entities": [{"name": w, "kind": "term", "one_liner": f"{n} mentions"} for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:1]],
        }
    )


def digests(chunks: DataFrame, distiller: Distiller = extractive, key: str = "doc_id") -> DataFrame:
    """doc_id, idx, heading_path, digest, failed for chunks (doc_id, idx, heading_path, text).

    A reply that isn't an object with a known field of its type fails, and leaves a placeholder.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        replies = []
        for path, text in zip(batch.column(2).to_pylist(), batch.column(3)):
            try:
                replies.append(distiller(path or [], text.as_py() or ""))
            except Exception:  # noqa: BLE001  a model's failure is this chunk's, not the job's
                replies.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(replies, pa.string())], [key, "idx", "heading_path", "reply"])

    replies = map_batches(chunks.select(key, "idx", "heading_path", "text"), run, f"{key} {kind}, idx int, heading_path array<string>, reply string")
    return replies.select(key, "idx", "heading_path", *read_digest(F.col("reply")))


def read_digest(reply: Column) -> list[Column]:
    """digest and failed from a reply; fields of a wrong type take their defaults."""
    v = F.try_parse_json(tx.strip_fences(reply))
    get = lambda p, kind: F.try_variant_get(v, p, kind)
    fields = {
        "summary": "string", "keywords": "array<string>", "claims": "array<string>", "facts_numeric": "array<string>", "terms": "array<struct<term:string,definition:string>>",
        "qa": "array<struct<q:string,a:string>>", "entities": "array<struct<name:string,kind:string,one_liner:string>>",
    }
    found = {n: get(f"$.{n}", kind) for n, kind in fields.items()}
    failed = ~F.coalesce(F.greatest(*[x.isNotNull() for x in found.values()]), F.lit(False))
    parts = [
        F.coalesce(x, F.when(failed, F.lit(FAILED)).otherwise("") if n == "summary" else F.array().cast(fields[n])).alias(n) for n, x in found.items()
    ]
    return [F.struct(*parts).cast(DIGEST).alias("digest"), failed.alias("failed")]


def chunk_prompt(title: Column, path: Column, text: Column) -> Column:
    """What a model is asked about a chunk."""
    return F.concat(
        F.lit("Summarise this part of the document for retrieval. Reply with one JSON object with the fields summary, keywords, claims, facts_numeric, terms, qa and entities. Copy numbers exactly; add none.\n\nDocument: "),
        F.coalesce(title, F.lit("unknown")), F.lit("\nPart: "), F.array_join(path, " > "), F.lit("\n\n"), text,
    )


def rollup_prompt(title: Column, digests_json: Column) -> Column:
    """What a model is asked about all digests of a document."""
    return F.concat(
        F.lit("Combine these digests of one document. Reply with one JSON object with the fields executive_summary, thesis, themes, glossary, question_bank and entity_index. Use only what the digests say.\n\nDocument: "),
        F.coalesce(title, F.lit("unknown")), F.lit("\n\n"), digests_json,
    )


def group_prompt(title: Column, digests_json: Column) -> Column:
    """What a model is asked about ten digests of a large document, before all of it is combined."""
    return F.concat(
        F.lit("Merge these digests of neighbouring parts of one document into one digest with the same fields. Drop repetitions; add nothing.\n\nDocument: "), F.coalesce(title, F.lit("unknown")), F.lit("\n\n"), digests_json
    )


def too_many_failures(d: DataFrame, key: str = "doc_id", accuracy_critical: bool = False) -> DataFrame:
    """doc_id of documents to give up: more than 30 % of their chunks failed, or one where accuracy is critical."""
    share = F.count_if("failed") / F.count(F.lit(1))
    return d.groupBy(key).agg(share.alias("share")).filter(F.col("share") > (0.0 if accuracy_critical else MOST_FAILED)).select(key)


def _in_order(d: DataFrame, field: str, key: str) -> DataFrame:
    return d.select(key, "idx", F.posexplode(f"digest.{field}").alias("pos", "x"))


def keywords(d: DataFrame, field: str = "keywords", key: str = "doc_id") -> DataFrame:
    """doc_id, items: distinct without regard to case, in order; the first spelling stays."""
    rows = _in_order(d, field, key).withColumn("x", tx.strip(F.col("x"))).filter(F.col("x") != "")
    first = rows.groupBy(key, F.lower("x").alias("k")).agg(F.min(F.struct("idx", "pos", "x")).alias("f"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["x"]).alias("items"))


def glossary(d: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, term, definition: the first definition of each exact term."""
    rows = _in_order(d, "terms", key).select(key, "idx", "pos", tx.strip(F.col("x.term")).alias("term"), tx.strip(F.coalesce("x.definition", F.lit(""))).alias("definition"))
    return rows.filter(F.col("term") != "").groupBy(key, "term").agg(F.min_by("definition", F.struct("idx", "pos")).alias("definition"))


def entities(d: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, seq, name, kind, one_liner: the first entity of each name without regard to case."""
    rows = _in_order(d, "entities", key).filter(F.col("x.name") != "")
    first = rows.groupBy(key, F.lower("x.name").alias("k")).agg(F.min(F.struct("idx", "pos", "x")).alias("f"))
    return first.select(key, (F.col("f.idx") * 1000 + F.col("f.pos")).alias("seq"), "f.x.name", "f.x.kind", "f.x.one_liner")


def merged_digest(ds: Column) -> Column:
    """One digest of several, in order."""
    flat = lambda n: F.flatten(F.transform(ds, lambda x: x[n]))
    return F.struct(
        F.array_join(F.transform(ds, lambda x: x["summary"]), "\n").alias("summary"), tx.keep_order_distinct(flat("keywords")).alias("keywords"), flat("claims").alias("claims"),
        tx.keep_order_distinct(flat("facts_numeric")).alias("facts_numeric"), flat("terms").alias("terms"), flat("qa").alias("qa"), flat("entities").alias("entities"),
    )


def ordered_digests(d: DataFrame, above: int = GROUP_ABOVE_TOKENS, key: str = "doc_id") -> DataFrame:
    """doc_id, ds: a document's digests in order; those of large documents merged by tens, a level of a tree before the last reduction."""
    one = F.struct("idx", F.to_json("digest").alias("j"))
    rows = d.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("rows"), F.sum(tx.token_estimate(F.to_json("digest"))).alias("size"))
    read = rows.select(key, "size", F.transform("rows", lambda x: F.from_json(x["j"], DIGEST)).alias("ds"))
    tens = F.transform(F.sequence(F.lit(0), F.ceil(F.size("ds") / GROUP).cast("int") - 1), lambda n: merged_digest(F.slice("ds", n * GROUP + 1, F.lit(GROUP))).cast(DIGEST))
    return read.select(key, F.when(F.col("size") > above, tens).otherwise(F.col("ds")).alias("ds"))


def split_block(text: Column, most: int = MOST_WORDS) -> Column:
    """Pieces of at most so many words, at lines if there are several, else at sentences; a longer sentence is cut."""
    words = lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")).cast("long")

    def at(parts: Column, sep: str) -> Column:
        packed = lambda own: slices(own, bin_starts(F.transform(own, words), most))
        return F.transform(tx.bound(parts, packed), lambda some: F.array_join(some, sep))

    def cut(p: Column) -> Column:
        some = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(w, i * most + 1, F.lit(most)), " "))
        return tx.bound(F.filter(F.split(p, r"(?U)\s+"), lambda x: x != ""), lambda w: F.when(F.size(w) > most, some(w)).otherwise(F.array(p)))

    def pieces(own: Column) -> Column:
        lines, sentences = at(F.split(own, "\n", -1), "\n"), F.flatten(F.transform(at(F.split(own, r"(?<=[.!?])\s+", -1), " "), cut))
        return F.when(words(own) <= most, F.array(own)).when(F.contains(own, F.lit("\n")), lines).otherwise(sentences)

    return tx.bound(text, pieces)


def footer(title: Column, author: Column, year: Column, loc: Column) -> Column:
    who = F.concat(F.coalesce(title, F.lit("Unknown title")), F.coalesce(F.concat(F.lit(" — "), author), F.lit("")), F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")))
    return F.concat(F.lit("*[Source: "), who, F.lit(", "), loc, F.lit("]*"))


def _unit(d: DataFrame, sec: int | Column, unit: Column, title: Column, body: Column, loc: Column, heading: Column | None = None, heading_llm: bool = True, llm: bool = True, placeholder: Column | None = None) -> DataFrame:
    return d.select(
        "doc_id", (F.lit(sec) if isinstance(sec, int) else sec).cast("long").alias("sec_no"), unit.cast("long").alias("unit_no"), title.alias("title"),
        (F.lit(None).cast("string") if heading is None else heading).alias("heading"), body.alias("body"), loc.alias("loc"), F.lit(heading_llm).alias("heading_llm"), F.lit(llm).alias("llm"),
        (F.lit(False) if placeholder is None else placeholder).alias("placeholder"),
    ).filter(F.col("body") != "")


#: Places of the sections that frame the chunks' own, whose place is CHUNKS and their number.
CHUNKS, LAST = 1_000, 1_000_000_000


def sections(meta: DataFrame, d: DataFrame, rolled: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Section titles (doc_id, sec_no, title) and units in a fixed order: summary, thesis, facts, glossary, a section for
    each chunk, synthesis, questions, entities, verbatim tables.

    meta: doc_id, title, author, year; d: digests; rolled: doc_id, rollup; tables: doc_id, seq, kind, near, raw.
    """
    base = meta.select("doc_id", F.coalesce("title", F.lit("this book")).alias("book"))
    r = rolled.join(base, "doc_id")
    overall, zero = F.lit("overall"), F.lit(0)
    about = F.concat(F.lit("What is *"), "book", F.lit("* about?"))
    kw = keywords(d).select("doc_id", F.slice("items", 1, MOST_KEYWORDS).alias("kw"))
    with_kw = lambda body, words: F.when((body != "") & (F.size(words) > 0), F.concat(body, F.lit("\n\n**Keywords:** "), F.array_join(words, ", "))).otherwise(body)
    summary = tx.strip(F.coalesce("rollup.executive_summary", F.lit("")))
    units = [_unit(r.join(kw, "doc_id", "left"), 1, zero, about, tx.subject_first(with_kw(summary, F.coalesce("kw", F.array())), F.col("book")), overall)]
    thesis = F.filter(F.transform("rollup.thesis", tx.strip), lambda t: t != "")
    units.append(_unit(r, 2, zero, F.lit("Core Thesis and Argument Map"), F.array_join(F.transform(thesis, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n"), overall))
    facts = keywords(d, "facts_numeric")
    units.append(_unit(facts, 3, zero, F.lit("Key Facts and Figures"), F.array_join(F.transform("items", lambda f: F.concat(F.lit("- "), f)), "\n"), overall))
    given = r.select("doc_id", F.posexplode("rollup.glossary").alias("pos", "x")).filter(F.col("x.term") != "")
    given = given.groupBy("doc_id", tx.strip(F.col("x.term")).alias("term")).agg(F.min_by(tx.strip(F.coalesce("x.definition", F.lit(""))), "pos").alias("definition"))
    terms = given.unionByName(glossary(d).join(given.select("doc_id").distinct(), "doc_id", "left_anti"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.lower("term").alias("k"), "term", "definition"))), lambda t: F.concat(F.lit("- **"), t["term"], F.lit("** — "), t["definition"]))
    units.append(_unit(terms.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("b")), 4, zero, F.lit("Concept Glossary"), F.col("b"), overall))

    c = d.join(base, "doc_id").withColumn("ch", F.element_at("heading_path", -1)).withColumn("loc", F.array_join("heading_path", " > "))
    c = c.withColumn("subject", F.coalesce(F.nullif(F.get("digest.entities", zero)["name"], F.lit("")), "book"))
    sec = F.col("idx") + CHUNKS
    own = F.when(F.col("failed"), F.col("digest.summary")).otherwise(with_kw(tx.subject_first(tx.strip(F.col("digest.summary")), F.col("subject")), tx.keep_order_distinct(F.col("digest.keywords"))))
    units.append(_unit(c, sec, zero, F.col("ch"), own, F.col("loc"), placeholder=F.col("failed")))
    claims = F.filter(F.transform("digest.claims", tx.strip), lambda x: x != "")
    units.append(_unit(c, sec, F.lit(1), F.col("ch"), F.array_join(F.transform(claims, lambda x: F.concat(F.lit("- "), x)), "\n"), F.col("loc"), F.concat(F.lit('What are the key claims of "'), "ch", F.lit('"?')), heading_llm=False))
    qa = c.select("*", F.posexplode(F.slice("digest.qa", 1, MOST_QA)).alias("pos", "x")).filter((F.col("x.q") != "") & (F.col("x.a") != ""))
    units.append(_unit(qa, sec, F.col("pos") + 2, F.col("ch"), tx.subject_first(tx.strip(F.col("x.a")), F.col("subject")), F.col("loc"), tx.question_shape(F.col("x.q"))))

    th = r.select("doc_id", "book", F.posexplode("rollup.themes").alias("pos", "x")).filter(F.col("x.synthesis") != "")
    theme = tx.strip(F.coalesce("x.theme", F.lit("")))
    asked = F.when(theme.endswith("?"), theme).otherwise(F.concat(F.lit("What does *"), "book", F.lit("* say about "), theme, F.lit("?")))
    units.append(_unit(th, LAST, F.col("pos"), F.lit("Cross-Chapter Synthesis"), with_kw(tx.subject_first(tx.strip(F.col("x.synthesis")), F.col("book")), tx.keep_order_distinct(F.coalesce("x.keywords", F.array()))), overall, asked))
    bank = r.select("doc_id", "book", F.posexplode(F.slice("rollup.question_bank", 1, MOST_BANK)).alias("pos", "x")).filter((F.col("x.q") != "") & (F.col("x.a") != ""))
    units.append(_unit(bank, LAST + 1, F.col("pos"), F.lit("Question Bank"), tx.subject_first(tx.strip(F.col("x.a")), F.col("book")), overall, tx.question_shape(F.col("x.q"))))
    named = r.select("doc_id", F.posexplode("rollup.entity_index").alias("seq", "x")).filter(F.col("x.name") != "").select("doc_id", F.col("seq").cast("long").alias("seq"), "x.name", "x.kind", "x.one_liner")
    named = named.unionByName(entities(d).join(named.select("doc_id").distinct(), "doc_id", "left_anti"))
    line = lambda e: F.concat(F.lit("- **"), e["name"], F.lit("** ("), F.coalesce(e["kind"], F.lit("entity")), F.lit(") — "), F.coalesce(e["one_liner"], F.lit("")))
    index = named.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name", "kind", "one_liner"))), line), "\n").alias("b"))
    units.append(_unit(index, LAST + 2, zero, F.lit("Entity Index"), F.col("b"), overall))
    label = F.when(F.col("kind") == "figure", "Figure").otherwise("Table")
    units.append(_unit(tables, LAST + 3, F.col("seq"), F.lit("Verbatim Tables and Figures (source-exact)"), F.col("raw"), F.col("near"), F.concat(label, F.lit(": "), tx.preview(F.col("raw"), F.col("kind")), F.lit(' (from "'), "near", F.lit('")')), heading_llm=False, llm=False))

    fixed = F.array(*[F.struct(F.lit(n).cast("long").alias("sec_no"), t.alias("title")) for n, t in (
        (1, about), (2, F.lit("Core Thesis and Argument Map")), (3, F.lit("Key Facts and Figures")), (4, F.lit("Concept Glossary")), (LAST, F.lit("Cross-Chapter Synthesis")),
        (LAST + 1, F.lit("Question Bank")), (LAST + 2, F.lit("Entity Index")), (LAST + 3, F.lit("Verbatim Tables and Figures (source-exact)")))])
    titles = base.select("doc_id", F.explode(fixed).alias("x")).select("doc_id", "x.*").unionByName(c.select("doc_id", sec.cast("long").alias("sec_no"), F.col("ch").alias("title")))
    every = units[0]
    for u in units[1:]:
        every = every.unionByName(u)
    return titles, every


def appendix(regions: DataFrame, accuracy_critical: bool = False) -> DataFrame:
    """Regions worth repeating: all where accuracy is critical, else those of forty rows or fewer. Adds seq and near."""
    rows = F.when(F.col("kind") == "pipe", F.size(F.split("raw", "\n", -1))).when(F.col("kind") == "html", F.greatest(tx.count(F.lower("raw"), "<tr"), F.lit(1))).otherwise(1)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    near = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("document"))
    return regions.filter(F.lit(accuracy_critical) | (rows <= MOST_ROWS)).select("doc_id", seq.alias("seq"), "kind", near.alias("near"), "raw")


def render(meta: DataFrame, titles: DataFrame, units: DataFrame, front: Column) -> DataFrame:
    """doc_id, text: frontmatter, a note on the file, and the sections in order. ``front``: a column of meta."""
    u = units.filter(~F.col("dropped") & (tx.strip(F.col("body")) != "")).join(meta.select("doc_id", F.col("title").alias("book"), "author", "year"), "doc_id")
    foot = footer(F.col("book"), F.col("author"), F.col("year"), F.col("loc"))
    prose = F.array_join(F.transform(split_block(F.col("body")), lambda p: F.concat(p, F.lit("\n\n"), foot)), "\n\n")
    block = F.concat_ws("\n\n", F.concat(F.lit("### "), "heading"), F.when(F.col("llm"), prose).otherwise(F.col("body")))
    bodies = u.groupBy("doc_id", "sec_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_no", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("b"))
    secs = titles.join(bodies, ["doc_id", "sec_no"], "left").select("doc_id", "sec_no", F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("b", F.lit(NONE))).alias("s"))
    whole = secs.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sec_no", "s"))), lambda x: x["s"]), "\n\n").alias("s"))
    note = F.concat(F.lit("> **About this file:** A machine-made companion to *"), F.coalesce("title", F.lit("a document")), F.lit("* by "), F.coalesce("author", F.lit("an unknown author")), F.lit(", for retrieval. Tables are copied from the source, never generated."))
    return meta.join(whole, "doc_id").select("doc_id", F.concat(F.concat_ws("\n\n", front, note, F.col("s")), F.lit("\n")).alias("text"))


def rollup(d: DataFrame, above: int = GROUP_ABOVE_TOKENS) -> DataFrame:
    """doc_id, rollup without a model: summaries, first claims and questions of the chunks in order."""
    g = ordered_digests(d.filter(~F.col("failed")), above)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return g.select(
        "doc_id",
        F.struct(
            F.array_join(F.slice(F.transform("ds", lambda x: x["summary"]), 1, 3), " ").alias("executive_summary"),
            F.slice(F.flatten(F.transform("ds", lambda x: F.slice(x["claims"], 1, 1))), 1, 5).alias("thesis"),
            empty("struct<theme:string,synthesis:string,keywords:array<string>>").alias("themes"), empty("struct<term:string,definition:string>").alias("glossary"),
            F.flatten(F.transform("ds", lambda x: x["qa"])).alias("question_bank"), empty("struct<name:string,kind:string,one_liner:string>").alias("entity_index"),
        ).cast(ROLLUP).alias("rollup"),
    )


def companions(documents: DataFrame, chunks: DataFrame, regions: DataFrame, inventory: DataFrame, generated: str, version: str, accuracy_critical: bool = False, distiller: Distiller = extractive) -> DataFrame:
    """doc_id, text, outcome, table_numerals_total, table_numerals_present: documents (doc_id, meta struct, source, kind, text)
    through digests, rollup, assembly, firewall, rendering and the check of tables."""
    # Each section reads the digests anew, and the distiller is the costly part: it runs once.
    d = cut(digests(chunks, distiller))
    failed = too_many_failures(d, accuracy_critical=accuracy_critical)
    meta = documents.select("doc_id", "meta.title", "meta.author", "meta.year", "source", "kind", tx.token_estimate(F.col("text")).alias("tokens"))
    kept = cut(meta.join(failed, "doc_id", "left_anti"))
    tables = cut(appendix(regions, accuracy_critical))
    good = d.join(failed, "doc_id", "left_anti")
    titles, units = sections(kept, good, cut(rollup(good)), tables)
    checked = cut(evidence.firewall(cut(units), inventory, accuracy_critical))
    field = lambda n, c: F.when(c != "", F.concat(F.lit(f'{n}: "'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"')))
    front = F.concat_ws(
        "\n", F.lit("---"), field("title", F.col("title")), field("author", F.col("author")), F.concat(F.lit("year: "), "year"), F.lit('document_type: "rag_distillate"'),
        field("source_document", F.col("source")), field("source_kind", F.col("kind")), F.lit(f"accuracy_critical: {str(accuracy_critical).lower()}"),
        F.concat(F.lit("source_tokens_estimate: "), "tokens"), field("converter_version", F.lit(version)), field("generated", F.lit(generated)), F.lit("---"))
    done = evidence.surviving_tables(cut(render(kept, titles, checked, front)), tables).withColumn("outcome", F.lit("ok"))
    return done.unionByName(failed.select("doc_id", F.lit("too_many_failures").alias("outcome")), allowMissingColumns=True)
