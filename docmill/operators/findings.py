"""Findings of a judge: kept, merged by signature, and filed under caps and a ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import signature, strip_fences

#: What a finding may say of itself.
SEVERITIES = ("critical", "major", "minor", "nit")
CATEGORIES = ("missing_content", "heading_structure", "artifact_noise", "ordering", "formatting", "metadata", "encoding", "other")
ALWAYS = ("critical", "major")
FLOOR = 0.6
RUN_CAP, DAY_CAP, ESCALATES_AT = 3, 8, 2
SAMPLE, ALIGN_CHARS = 12, 1500


def worth_keeping() -> Column:
    """Valid, confident, and grave or systemic."""
    valid = F.col("severity").isin(*SEVERITIES) & F.col("category").isin(*CATEGORIES) & F.col("confidence").between(FLOOR, 1.0)
    return F.coalesce(valid & (F.col("severity").isin(*ALWAYS) | F.col("is_systemic")), F.lit(False))


def merge(findings: DataFrame) -> DataFrame:
    """The most confident finding of each signature, the first of equals. Needs seq; adds signature."""
    kept = findings.filter(worth_keeping()).withColumn("signature", signature(F.col("category"), F.col("is_systemic"), F.col("title")))
    order = Window.partitionBy("signature").orderBy(F.col("confidence").desc(), F.col("seq"))
    return kept.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def outcomes(merged: DataFrame, ledger: DataFrame, filed_today: int = 0, run_cap: int = RUN_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """What becomes of each finding, in the order of seq, with its occurrences.

    An open issue of the ledger (signature, state, label, occurrences) takes the finding in and goes on hold at the second
    occurrence; new ones are filed until the run's or the day's cap. Both caps count the findings filed so far, so
    the smaller of what they leave decides.
    """
    joined = merged.join(ledger.select("signature", "state", "label", F.col("occurrences").alias("before")), "signature", "left")
    known = F.coalesce(F.col("state") == "open", F.lit(False))
    marked = joined.withColumn("known", known).withColumn("occurrences", F.when(known, F.col("before") + 1).otherwise(F.lit(1)))
    # The first new findings, as many as the caps leave, end with one row's seq; nothing is ranked over all rows.
    left = max(0, day_cap - filed_today)
    most = min(run_cap, left)
    last = marked.filter(~F.col("known")).select("seq").orderBy("seq").limit(most).agg(F.max("seq").alias("last_filed"))
    marked = marked.join(F.broadcast(last))  # one row
    new = F.when(F.coalesce(F.col("seq") <= F.col("last_filed"), F.lit(False)), "filed").otherwise(F.lit("capped_run" if run_cap <= left else "capped_day"))
    held = F.when((F.col("occurrences") >= ESCALATES_AT) & (F.coalesce(F.col("label"), F.lit("")) != "hold"), "escalated_hold").otherwise("deduped")
    return marked.withColumn("outcome", F.when(F.col("known"), held).otherwise(new)).select("seq", "signature", "occurrences", "outcome")


def updated_ledger(ledger: DataFrame, decided: DataFrame, day: str) -> DataFrame:
    """The ledger after a run: occurrences, labels and last_seen of the known, rows for the filed."""
    d = decided.select("signature", F.col("occurrences").alias("now"), "outcome")
    old = ledger.join(d.filter(F.col("outcome").isin("deduped", "escalated_hold")), "signature", "left").select(
        "signature", "state", F.when(F.col("outcome") == "escalated_hold", "hold").otherwise(F.col("label")).alias("label"),
        "first_seen", F.when(F.col("now").isNotNull(), F.lit(day)).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("now", "occurrences").alias("occurrences"))
    new = d.filter(F.col("outcome") == "filed").select("signature", F.lit("open").alias("state"), F.lit("finding").alias("label"), F.lit(day).alias("first_seen"), F.lit(day).alias("last_seen"), F.col("now").alias("occurrences"))
    return old.unionByName(new)


def issue_text(f: DataFrame) -> DataFrame:
    """Rendered title and body of each finding; sending them is not this engine's business."""
    title = F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("title"))
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("**Severity:** "), "severity", F.lit(" · **Confidence:** "), F.format_string("%.2f", "confidence")),
        F.concat(F.lit("**Evidence**\n"), "evidence"), F.concat(F.lit("**Suggested change**\n"), "suggested_fix"), F.concat(F.lit("<!-- signature: "), "signature", F.lit(" -->")))
    return f.select("*", title.alias("issue_title"), body.alias("issue_body"))


def sample_chapters(chapters: DataFrame, key: str = "doc_id", most: int = SAMPLE) -> DataFrame:
    """The first, the last and the largest chapters (doc_id, pos, chars), ``most`` of them; ties by position."""
    whole = Window.partitionBy(key)
    edge = (F.col("pos") == F.min("pos").over(whole)) | (F.col("pos") == F.max("pos").over(whole))
    ranked = chapters.withColumn("edge", edge)
    order = whole.orderBy(F.col("edge").desc(), F.col("chars").desc(), F.col("pos"))
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place", "edge")


def aligned_slice(md: Column, nth: Column, total: Column) -> Column:
    """The part of a text that a chapter takes by its place, with some characters on both sides."""
    n = F.length(md)
    start = F.greatest(F.lit(0), F.floor(nth * n / total) - ALIGN_CHARS)
    stop = F.least(n, F.floor((nth + 1) * n / total) + ALIGN_CHARS)
    return F.substr(md, (start + 1).cast("int"), (stop - start).cast("int"))


def below_floor(signals: DataFrame, floors: DataFrame) -> DataFrame:
    """Books whose signals miss a floor: book, metric, value, floor."""
    metrics = {"optimization_score": "min_optimization_score", "heading_count": "min_heading_count", "md_char_count": "min_md_chars"}
    joined = signals.join(floors, "book")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f).cast("double").alias("floor")) for m, f in metrics.items()])
    return joined.select("book", F.explode(rows).alias("x")).select("book", "x.*").filter(F.col("value") < F.col("floor"))


def new_floors(signals: DataFrame) -> DataFrame:
    """Floors from measured signals: somewhat below what was reached."""
    return signals.select("book", F.round(F.col("optimization_score") * 0.92, 1).alias("min_optimization_score"), F.floor(F.col("heading_count") * 0.9).alias("min_heading_count"), F.floor(F.col("md_char_count") * 0.9).alias("min_md_chars"))


# -- judging -------------------------------------------------------------------------------------------------

Judge = Callable[[str], str]

FINDING = "struct<severity:string,category:string,title:string,evidence:string,suggested_fix:string,confidence:double,is_systemic:boolean>"


def choose_engine(forced: Column, has_key: Column, has_command: Column) -> Column:
    """What a judge runs on: what is asked for, an interface with a key, a command, or nothing."""
    asked = F.lower(F.coalesce(forced, F.lit("")))
    return F.when(asked.isin("api", "cli"), asked).when(has_key, "api").when(has_command, "cli").otherwise("none")


def judge_prompt(title: Column, source: Column, converted: Column) -> Column:
    """What a judge is asked about a part of a book and what became of it."""
    return F.concat(
        F.lit("Compare a converted text with its source. Reply with one JSON object whose field findings is a list of objects with the fields severity ("), F.lit(", ".join(SEVERITIES)), F.lit("), category ("), F.lit(", ".join(CATEGORIES)),
        F.lit("), title, evidence, suggested_fix, confidence (0 to 1) and is_systemic. Report only what you can quote.\n\nBook: "), F.coalesce(title, F.lit("unknown")),
        F.lit("\n\nSource:\n"), source, F.lit("\n\nConverted:\n"), converted,
    )


def judged(prompts: DataFrame, judge: Judge, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Findings (key, seq, and the fields of FINDING) of prompts (key, idx, prompt), and the (key, idx) whose reply can't be read.

    ``judge`` is a plain callable on a prompt, run in Arrow batches, so that a client or a command fits.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for prompt in batch.column(2).to_pylist():
                try:
                    replies.append(judge(prompt or ""))
                except Exception:  # noqa: BLE001  a judge's failure is this part's, not the job's
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(replies, pa.string())], [key, "idx", "reply"])

    replies = prompts.select(key, F.col("idx").cast("long").alias("idx"), "prompt").mapInArrow(run, f"`{key}` {kind}, idx long, reply string")
    found = replies.select(key, "idx", F.try_variant_get(F.try_parse_json(strip_fences(F.col("reply"))), "$.findings", f"array<{FINDING}>").alias("found"))
    rows = found.select(key, "idx", F.posexplode("found").alias("pos", "f"))
    return rows.select(key, (F.col("idx") * 1000 + F.col("pos")).alias("seq"), "f.*"), found.filter(F.col("found").isNull()).select(key, "idx")
