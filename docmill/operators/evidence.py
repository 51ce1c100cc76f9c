"""Generated text against its source: numbers that the source doesn't have, and tables that didn't survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import numerals, preview

SMALL = 12


def exempt(n: Column, years: Column) -> Column:
    """Whole numbers from 0 to 12, and four-digit years that the source has anywhere."""
    value = n.try_cast("double")
    small = (value == F.floor(value)) & value.between(0, SMALL)
    return F.coalesce(small, F.lit(False)) | (n.rlike(r"\A[12]\d{3}\z") & F.coalesce(F.array_contains(years, n), F.lit(False)))


def scan_text(heading: Column, body: Column, heading_is_generated: Column) -> Column:
    """What a model wrote of a unit, without the numbers that only count a list."""
    text = F.concat(F.when(heading_is_generated, F.coalesce(heading, F.lit(""))).otherwise(F.lit("")), F.lit("\n"), body)
    return F.regexp_replace(text, r"(?md)^\s*\d+\.\s", "")


def unsupported(units: DataFrame, source_numerals: DataFrame, source_years: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and n: numbers in units (keys, scan) that their document's source hasn't.

    An anti join of exploded numbers on (doc_id, n); ``source_numerals``: (doc_id, n), ``source_years``: (doc_id, years).
    """
    asked = units.select(*keys, F.explode(numerals(F.col("scan"))).alias("n"))
    missing = asked.join(source_numerals.select("doc_id", "n").distinct(), ["doc_id", "n"], "left_anti")
    return missing.join(source_years.select("doc_id", "years"), "doc_id", "left").filter(~exempt(F.col("n"), F.col("years"))).select(*keys, "n")


def firewall(units: DataFrame, source: DataFrame, accuracy_critical: bool = False) -> DataFrame:
    """Units (doc_id, sec_no, unit_no, heading, body, heading_llm, placeholder, llm) with flagged numbers.

    ``source``: doc_id, numerals, years. Units with unsupported numbers are annotated, or dropped where accuracy is
    critical. Placeholders and units that no model wrote aren't scanned. Adds flagged and dropped.
    """
    keys = ["doc_id", "sec_no", "unit_no"]
    scanned = units.filter(F.col("llm") & ~F.col("placeholder")).select(*keys, scan_text(F.col("heading"), F.col("body"), F.col("heading_llm")).alias("scan"))
    numbers = source.select("doc_id", F.explode("numerals").alias("n"))
    found = unsupported(scanned, numbers, source, keys).groupBy(*keys).agg(F.array_sort(F.collect_set("n")).alias("flagged"))
    out = units.join(found, keys, "left")
    if accuracy_critical:
        return out.withColumn("dropped", F.col("flagged").isNotNull())
    note = F.concat(F.col("body"), F.lit("\n\n⚠ unverified figure: "), F.array_join("flagged", ", "))
    return out.withColumn("body", F.when(F.col("flagged").isNotNull(), note).otherwise(F.col("body"))).withColumn("dropped", F.lit(False))


def surviving_tables(companions: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, text, table_numerals_total, table_numerals_present: companions (doc_id, text) with every table
    (doc_id, seq, kind, near, raw) appended that owns a number which the text has lost."""
    numbers = tables.select("doc_id", "seq", F.explode(numerals(F.col("raw"))).alias("n"))
    has = companions.select("doc_id", F.explode(numerals(F.col("text"))).alias("n"))
    lost = numbers.join(has, ["doc_id", "n"], "left_anti")
    again = tables.join(lost.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi")
    block = F.concat(F.lit("\n\n### Table: "), preview(F.col("raw"), F.col("kind")), F.lit(' (from "'), F.col("near"), F.lit('") — re-appended by verification repair\n\n'), F.col("raw"), F.lit("\n"))
    added = again.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "").alias("added"))
    totals = numbers.groupBy("doc_id").agg(F.count_distinct("n").alias("table_numerals_total"))
    mended = companions.join(added, "doc_id", "left").select("doc_id", F.concat("text", F.coalesce("added", F.lit(""))).alias("text"))
    now = mended.select("doc_id", F.explode(numerals(F.col("text"))).alias("n"))
    kept = numbers.select("doc_id", "n").distinct().join(now, ["doc_id", "n"], "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("table_numerals_present"))
    return mended.join(totals, "doc_id", "left").join(kept, "doc_id", "left").na.fill(0, ["table_numerals_total", "table_numerals_present"])
