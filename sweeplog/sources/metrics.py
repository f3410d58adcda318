"""Stored metric scrapes and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counters kept from an exposition text.
COUNTERS = (
    "vllm:prompt_tokens_total",
    "vllm:generation_tokens_total",
    "vllm:request_success_total",
    "vllm:prefix_cache_queries_total",
    "vllm:prefix_cache_hits_total",
    "vllm:e2e_request_latency_seconds_count",
    "vllm:e2e_request_latency_seconds_sum",
    "vllm:time_to_first_token_seconds_count",
    "vllm:time_to_first_token_seconds_sum",
    "vllm:iteration_tokens_total_sum",
)


def parse_scrape(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Counter values per key and metric: labels dropped, label sets added up, unreadable values skipped.

    Values are added as decimals, so the sum does not depend on row order.
    """
    name = F.regexp_extract(text, r"^([^{ ]+)", 1)
    value = F.regexp_extract(text, r" ([^ ]+)$", 1).try_cast("decimal(38,12)")
    return (
        lines.select(*keys, name.alias("metric"), value.alias("value"))
        .filter(F.col("metric").isin(*COUNTERS) & F.col("value").isNotNull())
        .groupBy(*keys, "metric")
        .agg(F.sum("value").cast("double").alias("value"))
    )


def gpu_sample(text: Column) -> Column:
    """Utilisation, power and temperature from a comma list of three; `[N/A]` is absent, other shapes give null."""
    parts = F.split(text, ",")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    sample = F.struct(number(0).alias("gpu_util"), number(1).alias("gpu_power_w"), number(2).alias("gpu_temp_c"))
    return F.when(F.size(parts) == 3, sample)


def host_memory_gb(text: Column) -> Column:
    """Used memory from a memory report in kB: (total - available) / 1024 / 1024; null when either is missing."""
    field = lambda name: F.regexp_extract(text, rf"(?m)^{name}:\s+(\d+)", 1).try_cast("bigint")
    total, available = field("MemTotal"), field("MemAvailable")
    return F.when(total > 0, (total - available) / F.lit(1024) / F.lit(1024))
