"""Token cost accounting: STR10, JOIN6, AGG17, FLT10, SRC8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_alias

# --- fixed values: price per million tokens (input, output), in listing order --------
# Two audio models list text and audio prices separately (nested entries).
PRICES = [
    ("gpt-4o", "text", 2.50, 10.00),
    ("gpt-4o-2024-11-20", "text", 2.50, 10.00),
    ("gpt-4o-2024-08-06", "text", 2.50, 10.00),
    ("gpt-4o-audio-preview", "text", 2.50, 10.00),
    ("gpt-4o-audio-preview", "audio", 100.00, 200.00),
    ("gpt-4o-audio-preview-2024-10-01", "text", 2.50, 10.00),
    ("gpt-4o-audio-preview-2024-10-01", "audio", 100.00, 200.00),
    ("gpt-4o-2024-05-13", "text", 5.00, 15.00),
    ("gpt-4o-mini", "text", 0.150, 0.600),
    ("gpt4omini", "text", 0.150, 0.600),
    ("gpt-4o-mini-2024-07-18", "text", 0.150, 0.600),
    ("o1-preview", "text", 15.00, 60.00),
    ("o1-preview-2024-09-12", "text", 15.00, 60.00),
    ("o1-mini", "text", 3.00, 12.00),
    ("o1-mini-2024-09-12", "text", 3.00, 12.00),
    ("claude-3.5-sonnet", "text", 3.00, 15.00),
    ("claude-3.5-haiku", "text", 1.00, 5.00),
    ("claude-3-opus", "text", 15.00, 75.00),
    ("claude-3-haiku", "text", 0.25, 1.25),
    ("claude-3-sonnet", "text", 3.00, 15.00),
]
NESTED_MODELS = ("gpt-4o-audio-preview", "gpt-4o-audio-preview-2024-10-01")
# ------------------------------------------------------------------------------------


def model_names() -> list[str]:
    seen: list[str] = []
    for m, *_ in PRICES:
        if m not in seen:
            seen.append(m)
    return seen


def prices(spark: SparkSession) -> DataFrame:
    """Price dimension (model, modality, input, output, nested)."""
    df = spark.createDataFrame(PRICES, "model string, modality string, input double, output double")
    return df.withColumn("nested", F.col("model").isin(*NESTED_MODELS))


def flat_prices(spark: SparkSession) -> DataFrame:
    """Prices a plain (model -> input/output) lookup can use: nested entries have none."""
    return prices(spark).filter(~F.col("nested")).select("model", "input", "output")


# The setting that holds a provider's key, and the repositories tasks come from.
CREDENTIALS = {"claude": "ANTHROPIC_API_KEY", "": "OPENAI_API_KEY"}
REPOSITORIES = ("mwaskom/seaborn", "pytest-dev/pytest")


def credential_name(model) -> Column:
    """Name of the setting with the key for a model, by the beginning of its name (SRC8)."""
    model = F.col(model) if isinstance(model, str) else model
    out = None
    for prefix, name in CREDENTIALS.items():
        out = F.when(model.startswith(prefix), name) if out is None else out.when(model.startswith(prefix), name)
    return out


def repositories(spark: SparkSession) -> DataFrame:
    """(idx, repo) of the supported repositories (SRC8): a fixed dimension."""
    return spark.createDataFrame(list(enumerate(REPOSITORIES)), "idx bigint, repo string")


def price_completions(completions: DataFrame, price_dim: DataFrame) -> DataFrame:
    """Cost per completion = (in * p_in + out * p_out) / 1e6 after model aliasing.

    The price table has a fixed, small number of rows, so it is broadcast.  Unknown
    models and nested entries get a NULL cost (the caller routes them to a reject table).
    ``cost_nano`` is the same cost as an exact integer count of 1e-9 dollars (prices have
    at most three decimals), so totals are exact whatever the summation order.
    """
    c = completions.withColumn("model", model_alias(F.col("model")))
    j = c.join(F.broadcast(price_dim), "model", "left")
    p_in = F.round(F.col("input") * 1000).cast("bigint")
    p_out = F.round(F.col("output") * 1000).cast("bigint")
    nano = F.col("input_tokens") * p_in + F.col("output_tokens") * p_out
    return j.withColumn("cost_nano", nano).withColumn("cost", F.col("cost_nano") / F.lit(1e9)).drop("input", "output")


def cost_by_model(priced: DataFrame) -> DataFrame:
    """Totals per model over completions (never per problem row: D15)."""
    return priced.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_completions"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("cost_nano") / F.lit(1e9)).alias("total_cost"),
        F.count_if(F.col("cost").isNull()).alias("n_unpriced"),
    )
