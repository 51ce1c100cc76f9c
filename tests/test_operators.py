"""DataFrame operators on hand-computed cases and small models."""

import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docmill.functions.text import numerals, years
from docmill.operators import chunks, companion, evidence, findings, layout, ledger, lines, threads

pytestmark = pytest.mark.usefixtures("interpreted")


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")


# -- lines

HAZARD = "# A\ntext\n```\n# fenced\n| x |\n| y |\n```\n#### Orphan\n| a | 1,234.5 |\n|---|---|\n| b | 90% |\n<table>\n# inside\n</table>\n---\n## B\nlast\n# Figures\nfig 1\nfig 2\n# C\n| lone |"


def test_breadcrumbs_and_pages(spark):
    got = lines.breadcrumbs(lines.to_lines(bodies(spark, HAZARD))).orderBy("line_no").collect()
    path = {r["line"]: (r["path"], r["page"]) for r in got}
    assert path["text"] == (["A"], 1) and path["# fenced"] == (["A"], 1) and path["| a | 1,234.5 |"] == (["A", "Orphan"], 1)
    assert path["# inside"][0] == ["A", "Orphan"] and path["last"] == (["A", "B"], 2) and path["fig 1"][0] == ["Figures"]


def test_breadcrumbs_equal_a_stack(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["x", "# a", "## b", "### c", "#### d"]) for _ in range(25)) for _ in range(60)]
    got = {(r["doc_id"], r["line_no"]): r["path"] for r in lines.breadcrumbs(lines.to_lines(bodies(spark, *texts))).collect()}
    for i, t in enumerate(texts):
        stack = []
        for n, line in enumerate(t.split("\n")):
            if line.startswith("#"):
                level, title = len(line.split()[0]), line.split()[1]
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, title))
            assert got[i, n] == [s for _, s in stack]


def line_states(text):
    """One line after the other, with what is open."""
    out, inside = [], ""
    for line in text.split("\n"):
        x = line.strip().lower()
        fence, now = x.startswith(("```", "~~~")), inside
        if not now:
            now = "fence" if fence else "table" if x.startswith("<table") else "figure" if x.startswith("<figure") else ""
        out.append(now)
        if now == "fence":
            inside = "" if inside and fence else "fence"
        else:
            inside = "" if not now or f"</{now}>" in x else now
    return out


def test_states_equal_a_loop(spark):
    rng = random.Random(3)
    some = ["x", "", "```", "  ```py", "<table>", "</table>", " <Figure a>", "</figure>", "~~~", "<table></table>", "a <table>", "\u00a0<table>", "b</TABLE> c", "\r"]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randrange(1, 20))) for _ in range(300)] + ["", "\n", "```", "\n```\n"]
    got = {r["doc_id"]: r["s"] for r in bodies(spark, *texts).select("doc_id", lines.states(F.col("body")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == line_states(t), t


def test_a_long_document_stays_linear(spark):
    text = "\n".join(["# A", "x" * 30, "", "```", "# no", "```", "<table>", "</table>"] * 12_500)
    began = time.monotonic()
    assert lines.breadcrumbs(lines.to_lines(bodies(spark, text))).count() == 100_000
    assert chunks.pack(bodies(spark, text), 100).count() > 1000
    assert chunks.plan_chunks(bodies(spark, text), target=100).count() == chunks.CAP
    assert chunks.overlapping(bodies(spark, text), 100).count() > 1000
    assert time.monotonic() - began < 60


def test_regions_and_excision(spark):
    crumbs = lines.breadcrumbs(lines.to_lines(bodies(spark, HAZARD)))
    found = lines.regions(crumbs)
    got = [(r["kind"], r["raw"]) for r in found.orderBy("start").collect()]
    assert got == [("pipe", "| a | 1,234.5 |\n|---|---|\n| b | 90% |"), ("html", "<table>\n# inside\n</table>"), ("figure", "# Figures\nfig 1\nfig 2")]
    body = lines.excise(crumbs, found).first()["body"]
    assert body.count("[TABLE: ") == 3 and "1,234.5" in body and "fig 2" not in body and "| lone |" in body and "| x |" in body
    inventory = lines.numeral_inventory(bodies(spark, HAZARD).withColumnRenamed("body", "text"), found).first()
    assert "1234.5" in inventory["table_numerals"] and "90" in inventory["numerals"]


# -- chunks


def packed(text, target):
    held, size = [], 0
    for p in [p for p in re.split("\n\n+", text) if p.strip()]:
        if held and size + len(p) // 4 > target:
            yield "\n\n".join(held), size
            held, size = [], 0
        held, size = [*held, p], size + len(p) // 4
    if held:
        yield "\n\n".join(held), size


def test_packing_equals_a_loop(spark):
    rng = random.Random(4)
    texts = ["\n\n".join("p" * rng.randrange(1, 900) for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["", "\n\n \n\n", None]
    got = chunks.pack(bodies(spark, *texts), 150).collect()
    for i, t in enumerate(texts):
        assert [(r["text"], r["tokens"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["idx"])] == list(packed(t or "", 150))


def test_overlapping_windows(spark):
    body = "\n".join(f"para {i} " + "x" * 40 + ("\n---" if i % 3 == 2 else "\n") for i in range(12))
    got = chunks.overlapping(bodies(spark, body, "", "one\n\ntwo"), 40).orderBy("doc_id", "idx").collect()
    first = [r for r in got if r["doc_id"] == 0]
    assert first[0]["heading_path"] == ["Pages ~1–1"] and len(first) > 2
    for a, b in zip(first, first[1:]):
        assert a["text"].split("\n\n")[-1] == b["text"].split("\n\n")[0]
    assert [r["heading_path"] for r in got if r["doc_id"] == 2] == [["Section 1"]] and not [r for r in got if r["doc_id"] == 1]


def nested(text):
    """The outline as nested dicts, line by line."""
    root = {"level": 0, "title": "", "own": [], "sub": []}
    open_, count = [root], 0
    for line, state in zip(text.split("\n"), line_states(text)):
        m = None if state else re.fullmatch(r"(#{1,4})\s+(.+)", line)
        if m is None:
            open_[-1]["own"].append(line)
            continue
        count += 1
        open_ = [n for n in open_ if n["level"] < len(m[1])]
        node = {"level": min(len(m[1]), open_[-1]["level"] + 1), "title": m[2].strip(), "own": [], "sub": []}
        open_[-1]["sub"].append(node)
        open_.append(node)
    return root, count


def modelled(text, target, most, least, cap):
    """The plan from its rules, on nested dicts and strings, all of it made again after every change."""
    root, count = nested(text)

    def prune(n):
        n["sub"] = [prune(s) for s in n["sub"] if s["title"].strip("*_`:#").strip().lower() not in lines.NAVIGATION]
        return n

    def render(n):
        return "\n\n".join(x for x in ["\n".join(n["own"]).strip(), *(y for s in n["sub"] for y in ("#" * s["level"] + " " + s["title"], render(s)))] if x)

    def spread(n, path, lead):
        whole = "\n\n".join(x for x in (lead, render(n)) if x)
        if len(whole) // 4 > target and n["sub"]:
            lead = "\n\n".join(x for x in (lead, "\n".join(n["own"]).strip()) if x)
            return [c for k, s in enumerate(n["sub"]) for c in spread(s, [*path, s["title"]], lead if k == 0 else "")]
        name = path or ["Document"]
        if not whole:
            return []
        if len(whole) // 4 <= most:
            return [(name, whole, len(whole) // 4)]
        return [([*name[:-1], f"{name[-1]} (part {k + 1})"], t, size) for k, (t, size) in enumerate(packed(whole, target))]

    def flat():
        paras, now, page, ruled = [], [], 1, False
        for line, state in [*zip(text.split("\n"), line_states(text)), ("", "")]:
            if state == "" and line.strip() in ("", "---"):
                if "\n".join(now).strip():
                    paras.append(("\n".join(now).strip(), page))
                now, ruled, page = [], ruled or line.strip() == "---", page + (line.strip() == "---")
            else:
                now.append(line)
        out, held = [], []
        for p in paras:
            if held and sum(len(t) // 4 for t, _ in held) + len(p[0]) // 4 > target:
                out.append(held)
                held = held[-1:]
            held = [*held, p]
        out += [held] if held else []
        texts = ["\n\n".join(t for t, _ in h) for h in out]
        return [([f"Pages ~{h[0][1]}–{h[-1][1]}" if ruled else f"Section {k + 1}"], t, len(t) // 4) for k, (h, t) in enumerate(zip(out, texts))]

    join = lambda a, b: ([*a[0][:-1], f"{a[0][-1]} + {b[0][-1]}"], a[1] + "\n\n" + b[1], a[2] + b[2])
    prune(root)
    for tries in range(6):
        got = []
        for c in spread(root, [], "") if count >= 3 else flat():
            got[-1:] = [join(got[-1], c)] if got and count >= 3 and got[-1][2] + c[2] < least else [*got[-1:], c]
        if len(got) <= cap or tries == 5:
            break
        target = max(target + 1, math.ceil(max(1, sum(c[2] for c in got)) / cap))
        most = max(most, target * 4 // 3)
    while len(got) > cap:
        sums = [a[2] + b[2] for a, b in zip(got, got[1:])]
        k = sums.index(min(sums))
        got[k : k + 2] = [join(got[k], got[k + 1])]
    return got


def test_plans_equal_a_model(spark):
    rng = random.Random(8)
    some = ["# A", "## B", "### C", "#### D", "# *Toc*", "##  Index:", "#none", "##### five", "x" * 90, "word " * 30, "", "", "---", "```", "# in", "<table>", "</table>", "| a |"]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    for limits in (dict(target=60, most=90, least=25, cap=5), dict(target=20, most=25, least=1, cap=40), dict(target=5, most=8, least=0, cap=3), dict(target=400, most=500, least=100, cap=40)):
        for t in texts:
            assert [tuple(c) for c in chunks.plan(t, **limits)] == modelled(t, **limits), (limits, t)
    limits = dict(target=60, most=90, least=25, cap=5)
    got = chunks.plan_chunks(bodies(spark, *texts[:60]), **limits).collect()
    for i, t in enumerate(texts[:60]):
        assert [(r["heading_path"], r["text"], r["tokens"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["idx"])] == modelled(t, **limits)


def test_heading_plan():
    text = "lead\n# A\n" + "a" * 400 + "\n## A1\n" + "b" * 400 + "\n#### Deep\n" + "c" * 400 + "\n## Toc\nnav\n# B\nshort\n# C\ntiny"
    plan = chunks.plan(text, target=150, most=400, least=20, cap=40)
    assert [c.path for c in plan] == [["A", "A1", "Deep"], ["B + C"]]
    joined = "\n".join(c.text for c in plan)
    assert "nav" not in joined and "a" * 400 in joined and "c" * 400 in joined and "lead" in joined
    assert chunks.plan("# A\n# B\nx") == [(["Section 1"], "# A\n# B\nx", 2)]
    long = chunks.plan("# A\n" + "\n\n".join("y" * 400 for _ in range(6)) + "\n# B\nz\n# C\nz", target=200, most=250, least=1, cap=40)
    assert [c.path for c in long[:3]] == [["A (part 1)"], ["A (part 2)"], ["A (part 3)"]]


def test_plan_takes_all_documents(spark):
    rows = [(0, "# A\nx\n# B\ny\n# C\nz"), (1, "flat text"), (2, "```\n# a\n# b\n# c\n```"), (3, None), (None, "one"), (None, "two"), (1, "flat text"), (4, "# Toc\n# Index\n# Guide")]
    got = chunks.plan_chunks(spark.createDataFrame(rows, "doc_id long, body string"), least=0, target=1).collect()
    assert sorted((str(r["doc_id"]), r["heading_path"], r["idx"]) for r in got) == [
        ("0", ["A"], 0), ("0", ["B"], 1), ("0", ["C"], 2), ("1", ["Section 1"], 0), ("1", ["Section 1"], 0), ("2", ["Section 1"], 0), ("None", ["Section 1"], 0), ("None", ["Section 1"], 0),
    ]
    assert chunks.plan_chunks(bodies(spark).limit(0)).count() == 0


# -- ledgers


def test_prices(spark):
    calls = spark.createDataFrame([("gemini-3.6-flash", 1_000_000, 100_000), ("gemini-2.5-pro", 199_000, 16_125), ("gemini-2.5-pro", 201_000, 21_300), ("gemini-2.5-flash", 300_000, 0), ("new", 1, 1)], "model string, prompt_tokens long, output_tokens long")
    got = [r["cost_usd"] for r in ledger.priced(calls).collect()]
    assert got[:4] == pytest.approx([2.25, 0.41, 0.822, 0.09]) and got[4] is None


def test_totals_and_caps(spark):
    rows = [(1, 1, 10, 5, 1, 0.5), (1, 2, 10, 5, 1, 1.6), (1, 3, 1, 1, 1, 0.1), (2, 1, 7, 1, 0, None), (2, 2, 7, 1, 0, 1.0)]
    calls = spark.createDataFrame(rows, "run long, seq long, prompt_tokens long, candidate_tokens long, thought_tokens long, cost_usd double")
    runs = {r["run"]: r for r in ledger.run_totals(calls).collect()}
    assert runs[1]["cost_usd"] == 2.2 and runs[1]["output_tokens"] == 14 and runs[2]["cost_usd"] is None and runs[2]["estimate_only"]
    life = ledger.lifetime(ledger.run_totals(calls)).first()
    assert (life["cost_usd"], life["uncosted_calls"], life["calls"]) == (2.2, 2, 5)
    kept = [(r["run"], r["seq"], r["stopped"]) for r in ledger.until_cap(calls.filter("run = 1"), 2.0).orderBy("seq").collect()]
    assert kept == [(1, 1, False), (1, 2, True)]
    many = spark.range(130).select(F.col("id").alias("run"), F.col("id").alias("ts"))
    assert sorted(r["run"] for r in ledger.latest(many).collect()) == list(range(30, 130))


def test_estimates(spark):
    rows = spark.createDataFrame([(1, 100)], "doc_id long, tokens long")
    got = ledger.estimate(rows, "gemini-3.6-flash", "gemini-2.5-pro").first()
    assert (got["chunks"], got["est_input_tokens"], got["est_output_tokens"]) == (1, 500, 4000)
    assert got["est_cost_usd"] == pytest.approx((500 * 1.5 + 4000 * 7.5) / 1e6 + (4000 * 1.25 + 4000 * 10) / 1e6, abs=5.1e-5)
    assert ledger.estimate(rows, "new", "gemini-2.5-pro").first()["est_cost_usd"] is None
    assert ledger.within_estimate(ledger.estimate(rows, "gemini-3.6-flash", "gemini-2.5-pro"), 0.01).count() == 0
    line = spark.range(1).select(ledger.usage_line(F.lit(18), F.lit(412300), F.lit(28100), F.lit(0.5), F.lit(1.239), F.lit(0))).first()[0]
    assert line == "LLM usage: 18 calls, 412,300 in / 28,100 out tok, $0.5000 this run — lifetime $1.24"


# -- findings

FIELDS = "seq int, severity string, category string, title string, evidence string, suggested_fix string, is_systemic boolean, confidence double"


def test_findings_merge_and_file(spark):
    rows = [
        (1, "major", "ordering", "Chapter 1 lost", "e", "f", True, 0.7), (2, "major", "ordering", "Chapter 22 lost!", "e", "f", True, 0.9), (3, "nit", "ordering", "small", "e", "f", False, 0.9),
        (4, "nit", "ordering", "small two", "e", "f", True, 0.9), (5, "major", "metadata", "weak", "e", "f", True, 0.5), (6, "huge", "ordering", "bad", "e", "f", True, 0.9), (7, "critical", "other", "x", "e", "f", False, 1.0), (8, "major", "encoding", "y", "e", "f", False, 0.6),
    ]
    merged = findings.merge(spark.createDataFrame(rows, FIELDS))
    assert sorted(r["seq"] for r in merged.collect()) == [2, 4, 7, 8]
    assert "signature" in findings.issue_text(merged).first()["issue_body"]
    known = merged.filter("seq = 4").select("signature", F.lit("open").alias("state"), F.lit("finding").alias("label"), F.lit("d0").alias("first_seen"), F.lit("d0").alias("last_seen"), F.lit(1).alias("occurrences"))
    decided = findings.outcomes(merged, known, filed_today=6)
    assert {r["seq"]: r["outcome"] for r in decided.collect()} == {2: "filed", 4: "escalated_hold", 7: "filed", 8: "capped_day"}
    assert {r["seq"]: r["outcome"] for r in findings.outcomes(merged, known, run_cap=1).collect()} == {2: "filed", 4: "escalated_hold", 7: "capped_run", 8: "capped_run"}
    after = {r["signature"]: r for r in findings.updated_ledger(known, decided, "d1").collect()}
    old = known.first()["signature"]
    assert len(after) == 3 and after[old]["label"] == "hold" and after[old]["occurrences"] == 2 and after[old]["last_seen"] == "d1"


def test_samples_and_slices(spark):
    rows = spark.createDataFrame([(1, p, c) for p, c in enumerate([1, 5, 9, 9, 2, 7, 1])], "doc_id int, pos int, chars int")
    assert sorted(r["pos"] for r in findings.sample_chapters(rows, most=4).collect()) == [0, 2, 3, 6]
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    got = spark.createDataFrame([(text,)], "t string").select(*[findings.aligned_slice(F.col("t"), F.lit(i), F.lit(5)) for i in range(5)]).first()
    assert list(got) == [text[max(0, i * 2000 - 1500) : min(10_000, (i + 1) * 2000 + 1500)] for i in range(5)]


def test_floors(spark):
    s = spark.createDataFrame([("a", 91.0, 100, 1000)], "book string, optimization_score double, heading_count int, md_char_count int")
    floors = findings.new_floors(s)
    assert findings.below_floor(s, floors).count() == 0
    worse = s.withColumn("heading_count", F.lit(10))
    assert [(r["metric"], r["value"], r["floor"]) for r in findings.below_floor(worse, floors).collect()] == [("heading_count", 10.0, 90.0)]


# -- evidence


def units(spark, *texts, **over):
    base = {"sec_no": 1, "heading": None, "heading_llm": True, "placeholder": False, "llm": True} | over
    rows = [(1, base["sec_no"], i, base["heading"], t, base["heading_llm"], base["placeholder"], base["llm"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, sec_no int, unit_no int, heading string, body string, heading_llm boolean, placeholder boolean, llm boolean")


def source(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, t string").select("doc_id", numerals(F.col("t")).alias("numerals"), years(F.col("t")).alias("years"))


def test_firewall(spark):
    src = source(spark, "In 3.1997 there were 45 of 1,200")
    u = units(spark, "1. first 45\n2. then 1200 and 7", "says 99.5 and 13", "in 1997 and 1998", "fine")
    got = {r["unit_no"]: r for r in evidence.firewall(u, src).collect()}
    assert [got[i]["flagged"] for i in range(4)] == [None, ["13", "99.5"], ["1998"], None]
    assert got[1]["body"].endswith("⚠ unverified figure: 13, 99.5")
    assert [r["unit_no"] for r in evidence.firewall(u, src, accuracy_critical=True).filter("dropped").collect()] in ([1, 2], [2, 1])
    for kw in ({"placeholder": True}, {"llm": False}):
        assert evidence.firewall(units(spark, "99", **kw), src).first()["flagged"] is None
    assert evidence.firewall(units(spark, "x", heading="Pages 77"), src).first()["flagged"] == ["77"]
    assert evidence.firewall(units(spark, "x", heading="Pages 77", heading_llm=False), src).first()["flagged"] is None


def test_table_survival(spark):
    tables = spark.createDataFrame([(1, 1, "pipe", "T", "| 55 | 66 |"), (1, 2, "pipe", "T", "| 77 |")], "doc_id long, seq int, kind string, near string, raw string")
    text = spark.createDataFrame([(1, "has 55 and 66"), (2, "no tables")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in evidence.surviving_tables(text, tables).collect()}
    assert (got[1]["table_numerals_total"], got[1]["table_numerals_present"]) == (3, 3)
    assert "| 77 |" in got[1]["text"] and "| 55 | 66 |" not in got[1]["text"] and got[2]["text"] == "no tables"


# -- companions


def planned(spark):
    rows = [(1, 0, ["A"], "Alpha grows. It has 45 parts.", 8), (1, 1, ["B", "C"], "Beta shrinks! Why not?", 6)]
    return spark.createDataFrame(rows, "doc_id long, idx int, heading_path array<string>, text string, tokens long")


def test_digests_take_bad_replies(spark):
    replies = {"A": '```json\n{"summary": "s", "keywords": 5, "claims": ["c"]}\n```'}
    got = {r["idx"]: r for r in companion.digests(planned(spark), lambda path, text: replies.get(path[-1], "nonsense")).collect()}
    assert not got[0]["failed"] and got[0]["digest"]["summary"] == "s" and got[0]["digest"]["keywords"] == [] and got[0]["digest"]["claims"] == ["c"]
    assert got[1]["failed"] and got[1]["digest"]["summary"] == companion.FAILED
    assert [r["doc_id"] for r in companion.too_many_failures(companion.digests(planned(spark), lambda *a: 1 / 0)).collect()] == [1]


def test_rollups(spark):
    def d(path, text):
        return json.dumps({"summary": text, "keywords": ["One", path[-1]], "terms": [{"term": "T", "definition": path[-1]}, {"term": "b", "definition": "x"}], "entities": [{"name": "E" if path[-1] == "A" else "e", "kind": "k", "one_liner": path[-1]}]})

    digests = companion.digests(planned(spark), d)
    assert companion.keywords(digests).first()["items"] == ["One", "A", "C"]
    assert {(r["term"], r["definition"]) for r in companion.glossary(digests).collect()} == {("T", "A"), ("b", "x")}
    assert [(r["name"], r["one_liner"]) for r in companion.entities(digests).collect()] == [("E", "A")]
    many = spark.range(25).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.array(F.lit("H")).alias("heading_path"), F.lit("t").alias("text"))
    of = lambda above: companion.ordered_digests(companion.digests(many, d), above).first()["ds"]
    assert [len(x["claims"]) for x in of(1)] == [0, 0, 0] and [x["summary"].count("t") for x in of(1)] == [10, 10, 5] and len(of(10**9)) == 25
    assert companion.rollup(companion.digests(many, d), above=1).first()["rollup"]["executive_summary"].count("t") == 25


def test_blocks_split(spark):
    cases = ["a b", " ".join(["w."] * 1100), "\n".join(" ".join(["w"] * 300) for _ in range(3)), " ".join(["w"] * 1200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", companion.split_block(F.col("t")).alias("p"))
    got = {r["i"]: [len(p.split()) for p in r["p"]] for r in df.collect()}
    assert got == {0: [2], 1: [500, 500, 100], 2: [300, 300, 300], 3: [500, 500, 200]}


def test_companion_end_to_end(spark):
    text = "# A\nAlpha grows. It has 45 parts.\n| k | 1,234 |\n|---|---|\n# B\nBeta shrinks.\n# C\nend 2001"
    docs = bodies(spark, text)
    found = lines.regions(lines.breadcrumbs(lines.to_lines(docs)))
    inventory = docs.select("doc_id", numerals(F.col("body")).alias("numerals"), years(F.col("body")).alias("years"))
    rows = docs.select("doc_id", F.struct(F.lit("Book").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("2001").alias("year")).alias("meta"), F.lit("b.md").alias("source"), F.lit("epub").alias("kind"), F.col("body").alias("text"))
    plan = chunks.plan_chunks(docs, least=0, target=10, most=20)
    out = companion.companions(rows, plan, found, inventory, "2024-01-01", "1").first()
    assert out["outcome"] == "ok" and out["table_numerals_total"] == out["table_numerals_present"] == 1
    heads = [x for x in out["text"].split("\n") if x.startswith("## ")]
    assert heads[:4] == ["## What is *Book* about?", "## Core Thesis and Argument Map", "## Key Facts and Figures", "## Concept Glossary"] and heads[-4:] == ["## Cross-Chapter Synthesis", "## Question Bank", "## Entity Index", "## Verbatim Tables and Figures (source-exact)"]
    assert "| k | 1,234 |" in out["text"] and "*[Source: Book (2001), overall]*" in out["text"] and "unverified" not in out["text"] and companion.NONE in out["text"]

    def liar(path, text):
        return json.dumps({"summary": "There are 987 of them."})

    assert "⚠ unverified figure: 987" in companion.companions(rows, plan, found, inventory, "d", "1", distiller=liar).first()["text"]
    assert "987" not in companion.companions(rows, plan, found, inventory, "d", "1", accuracy_critical=True, distiller=liar).first()["text"]


# -- threads and layouts


def listing(*kids):
    return {"data": {"children": list(kids)}}


def said(body, *replies, **data):
    return {"kind": "t1", "data": {"body": body, "author": "u", "score": 3, "replies": listing(*replies) if replies else ""} | data}


def test_threads(spark):
    post = {"data": {"title": "T", "author": "op", "subreddit_name_prefixed": "r/x", "score": 5, "num_comments": 2, "selftext": " hi ", "created_utc": 1700000000, "is_self": False, "url": "http://l/", "media_metadata": {"a": {"s": {"u": "http://i/?a=1&amp;b=2"}}}}}
    deep = said("one", said("[deleted]", said("three\nlines", score="x")))
    rows = [(1, json.dumps([listing(post), listing(deep, {"kind": "more"}, said("two", author=None))])), (2, "not json"), (3, json.dumps([listing(post)]))]
    got = {r["doc_id"]: r for r in threads.render_threads(spark.createDataFrame(rows, "doc_id long, json string")).collect()}
    assert set(got) == {1, 3} and got[1]["publication_date"] == "2023-11-14" and got[1]["images"] == ["http://i/?a=1&b=2"]
    assert got[1]["markdown"] == (
        "# T\n\n*Posted in r/x • by u/op • 5 points • 2 comments*\n\n**Link:** http://l/\n\nhi\n\n## Comments\n\n> **u/u** (3 points)\n> \n> one\n\n"
        "> > > **u/u**\n> > > \n> > > three\n> > > lines\n\n> **u/[deleted]** (3 points)\n> \n> two"
    )
    assert "Comments" not in got[3]["markdown"]
    wide = spark.createDataFrame([(1, json.dumps([listing(post), listing(*[said(f"c{i}") for i in range(60)])]))], "doc_id long, json string")
    assert threads.render_threads(wide).first()["markdown"].count("**u/u**") == 40


def test_layouts(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 50.0), (1, 0, 1, 200.0, 20.0, 300.0, 60.0), (1, 0, 2, 120.0, 100.0, 200.0, 160.0), (1, 1, 3, 400.0, 0.0, 500.0, 50.0)], "doc_id int, page int, pos int, x0 double, y0 double, x1 double, y1 double")
    assert [r["pos"] for r in layout.side_by_side(boxes).collect()] == [0]
    got = spark.createDataFrame([(1,), (3,), (40,)], "n int").select(layout.sampled_pages(F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got] == [[0], [0, 1, 2], [0, 10, 20, 30, 39]]
    assert spark.range(1).select(layout.caption(F.lit("x\nFigure 3: A thing.\nFig. 4. B"))).first()[0] == "Figure 3: A thing."
    assert "Confidence: high (93%)" in spark.range(1).select(layout.render_figure(F.lit("F1"), F.lit("t"), F.lit(0.93), F.lit("d"))).first()[0]
    t, a = layout.first_page_meta(F.array(*map(F.lit, ("Journal of Things", "A long enough title of a paper", "Ann B. Lee, Bob Ray"))), F.lit("info"), F.lit("who"))
    assert tuple(spark.range(1).select(t, a).first()) == ("A long enough title of a paper", "Ann B. Lee, Bob Ray")


def test_excision_brings_lines_and_marks_together_once(spark):
    body = "a\n| x |\n| y |\nb\n| lone |\n<table>\n1\n</table>\nc\n| p |\n| q |"
    docs = spark.createDataFrame([(1, body), (2, "no table"), (3, "| only |\n| these |")], "doc_id long, body string")
    crumbs = lines.breadcrumbs(lines.to_lines(docs))
    out = lines.excise(crumbs, lines.regions(crumbs))
    assert {r["doc_id"]: r["body"] for r in out.collect()} == {1: "a\n[TABLE: | x | … ]\nb\n| lone |\n[TABLE: <table> … ]\nc\n[TABLE: | p | … ]", 2: "no table", 3: "[TABLE: | only | … ]"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
