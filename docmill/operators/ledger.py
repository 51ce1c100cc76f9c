"""Model calls: what they cost, when a run must stop, and what has been spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dollars for a million tokens in and out, and above the prompt size of the high tier.
PRICES = (
    ("gemini-3.6-flash", 1.50, 7.50, None, None),
    ("gemini-3.5-flash", 1.50, 9.00, None, None),
    ("gemini-3.5-flash-lite", 0.30, 2.50, None, None),
    ("gemini-2.5-flash", 0.30, 2.50, None, None),
    ("gemini-2.5-pro", 1.25, 10.00, 2.50, 15.00),
    ("gemini-3.1-pro-preview", 2.00, 12.00, 4.00, 18.00),
)
HIGH_TIER = 200_000
OVERHEAD_TOKENS, OUTPUT_SHARE, LEAST_OUTPUT = 400, 0.25, 4_000
RUNS_KEPT = 100


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, in_rate double, out_rate double, in_high double, out_high double")


def cost(prompt: Column, output: Column) -> Column:
    """Dollars of a call beside its prices; null without prices."""
    high = (prompt > HIGH_TIER) & F.col("in_high").isNotNull()
    rate = lambda n: F.when(high, F.col(f"{n}_high")).otherwise(F.col(f"{n}_rate"))
    return (prompt * rate("in") + output * rate("out")) / F.lit(1e6)


def priced(calls: DataFrame) -> DataFrame:
    """Calls (model, prompt_tokens, output_tokens) with cost_usd; null for models without a price."""
    known = F.broadcast(prices(calls.sparkSession))  # a fixed handful of rows
    return calls.join(known, "model", "left").withColumn("cost_usd", cost(F.col("prompt_tokens"), F.col("output_tokens"))).select(*calls.columns, "cost_usd")


def estimate(chunks: DataFrame, map_model: str, reduce_model: str, key: str = "doc_id") -> DataFrame:
    """doc_id, chunks, est_input_tokens, est_output_tokens, est_cost_usd of distilling chunks (doc_id, tokens)."""
    sums = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))
    share = lambda x: F.greatest(F.floor(x * OUTPUT_SHARE).cast("long"), F.lit(LEAST_OUTPUT))
    sized = sums.withColumn("est_input_tokens", F.col("tokens") + OVERHEAD_TOKENS * F.greatest("chunks", F.lit(1)))
    sized = sized.withColumn("est_output_tokens", share(F.col("est_input_tokens"))).withColumn("reduce_tokens", share(F.col("est_output_tokens")))
    rates = prices(chunks.sparkSession)
    for name, model, prompt, output in (("map", map_model, "est_input_tokens", "est_output_tokens"), ("reduce", reduce_model, "est_output_tokens", "reduce_tokens")):
        one = rates.filter(F.col("model") == model).drop("model")
        sized = sized.join(F.broadcast(one), F.lit(True), "left").withColumn(f"{name}_cost", cost(F.col(prompt), F.col(output))).drop(*one.columns)
    return sized.select(key, "chunks", "est_input_tokens", "est_output_tokens", F.round(F.col("map_cost") + F.col("reduce_cost"), 4).alias("est_cost_usd"))


def run_totals(calls: DataFrame, run: str = "run") -> DataFrame:
    """Totals by run of calls (prompt_tokens, candidate_tokens, thought_tokens, cost_usd); one unknown cost makes a run's unknown."""
    return calls.groupBy(run).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("input_tokens"),
        F.sum(F.col("candidate_tokens") + F.col("thought_tokens")).alias("output_tokens"),
        F.sum("thought_tokens").alias("thought_tokens"),
        F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.round(F.sum("cost_usd"), 6)).alias("cost_usd"),
        F.bool_or(F.col("cost_usd").isNull()).alias("estimate_only"),
    )


def lifetime(runs: DataFrame) -> DataFrame:
    """One row: runs, calls, tokens and known cost of all runs, and the calls without a price."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("calls").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("estimate_only"), F.col("calls"))), F.lit(0)).alias("uncosted_calls"),
    )


def latest(runs: DataFrame, time: str = "ts", most: int = RUNS_KEPT) -> DataFrame:
    """The newest runs; ties by run."""
    newest = runs.orderBy(F.col(time).desc(), F.col("run").desc()).limit(most)
    return newest


def append_runs(runs: DataFrame, path: str, keep: int = RUNS_KEPT) -> DataFrame:
    """Append runs to the ledger at ``path``; returns the newest of all. Earlier rows are never rewritten."""
    runs.write.mode("append").parquet(path)
    return latest(runs.sparkSession.read.parquet(path), most=keep)


def until_cap(calls: DataFrame, cap: float, run: str = "run", seq: str = "seq") -> DataFrame:
    """Calls up to and with the first that takes its run's cost above the cap, with spent and stopped."""
    order = Window.partitionBy(run).orderBy(seq)
    before = F.coalesce(F.sum("cost_usd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spent = F.sum("cost_usd").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return calls.select("*", before.alias("before"), spent.alias("spent")).filter(F.col("before") <= cap).withColumn("stopped", F.coalesce(F.col("spent") > cap, F.lit(False))).drop("before")


def within_estimate(estimates: DataFrame, cap: float) -> DataFrame:
    """Documents whose estimate is known not to pass the cap, before anything costly runs."""
    return estimates.filter(F.col("est_cost_usd").isNull() | (F.col("est_cost_usd") <= cap))


def usage_line(calls: Column, tokens_in: Column, tokens_out: Column, run_cost: Column, life_cost: Column, uncosted: Column) -> Column:
    spent = F.when(run_cost.isNull(), "cost unknown (unpriced model)").otherwise(F.concat(F.format_string("$%.4f", run_cost), F.lit(" this run")))
    spent = F.when(run_cost.isNull(), F.concat(spent, F.lit(" this run"))).otherwise(spent)
    more = F.when(uncosted > 0, F.concat(F.lit(" + "), uncosted, F.lit(" uncosted calls"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("LLM usage: "), calls, F.lit(" calls, "), F.format_number(tokens_in, 0), F.lit(" in / "), F.format_number(tokens_out, 0), F.lit(" out tok, "),
        spent, F.lit(" — lifetime "), F.format_string("$%.2f", F.coalesce(life_cost, F.lit(0.0))), more,
    )
