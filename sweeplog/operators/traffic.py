"""DNS traffic: profiles, burst sessions, gap regularity, and who held an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplog.operators import ordered, ranges

FLOW = ["source", "domain"]


def registered_domain(query: Column) -> Column:
    """Last two labels of a name."""
    return F.substring_index(query, ".", -2)


def flows(dns: DataFrame) -> DataFrame:
    """Queries with source, domain, label in front of the domain, payload length and instant."""
    domain = registered_domain(F.col("query"))
    label = F.regexp_replace(F.left("query", F.length("query") - F.length(domain)), r"\.$", "")
    return dns.filter("query IS NOT NULL AND id_orig_h IS NOT NULL").select(
        F.col("id_orig_h").alias("source"),
        domain.alias("domain"),
        label.alias("label"),
        F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")).alias("ts"),
        "qtype_name",
        "rcode_name",
        F.coalesce(F.length(F.array_join("answers", ",")), F.lit(0)).alias("payload"),
        *[c for c in ("case_id", "file", "line_no") if c in dns.columns],
    )


def profile(traffic: DataFrame) -> DataFrame:
    """Per source, domain and query type: volume, success, distinct labels, label and payload length."""
    n = F.count("*")
    return traffic.groupBy(*FLOW, "qtype_name").agg(
        n.alias("queries"),
        (F.count_if(F.col("rcode_name") == "NOERROR") / n).alias("noerror_share"),
        F.countDistinct("label").alias("distinct_labels"),
        (F.sum(F.length("label")) / n).alias("mean_label_length"),
        F.max(F.length("label")).cast("bigint").alias("max_label_length"),
        (F.sum("payload") / n).alias("mean_payload"),
    )


def type_share(traffic: DataFrame) -> DataFrame:
    """Share of TXT queries and of answered queries per source and domain."""
    n = F.count("*")
    return traffic.groupBy(*FLOW).agg(
        n.alias("queries"),
        (F.count_if(F.col("qtype_name") == "TXT") / n).alias("txt_share"),
        (F.count_if(F.col("rcode_name") == "NOERROR") / n).alias("noerror_share"),
    )


def sessions(events: DataFrame, gap_s: float, keys: list[str] = FLOW, order: list[str] | None = None,
             partitions: int | None = None) -> DataFrame:
    """Bursts per key: a pause longer than `gap_s` opens the next session. Rows carry `ts` and the order columns."""
    return ranges.sessions(events, int(gap_s * 1_000_000), keys, order or ["ts", "line_no"], partitions)


def regularity(events: DataFrame, keys: list[str] = FLOW, order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Mean and spread of the gaps per key. A small coefficient of variation is a beacon, a large one bursts."""
    return ranges.gap_moments(events, keys, order or ["ts", "line_no"], partitions).select(
        *keys, "gaps",
        (F.col("mean_us") / F.lit(1e6)).alias("mean_s"),
        (F.sqrt(F.col("square_us") / F.col("gaps")) / F.lit(1e6)).alias("stddev_s"),
    ).withColumn("variation", F.try_divide(F.col("stddev_s"), F.col("mean_s")))


def attribute_hosts(rows: DataFrame, leases: DataFrame, width: int | None = None) -> DataFrame:
    """Host that held the address of each row: the latest lease at or before its time, if it had not run out.

    `rows`: ip, ts and an id column; `leases`: ip, ts, host, lease_s, line_no. Both are ordered together in time buckets
    of the address, so a busy address spreads over its buckets. Rows without an address or a time have no host; leases
    without these say nothing.
    """
    ids = [c for c in rows.columns if c not in ("ip", "ts")]
    lease = F.struct(F.col("ts").alias("since"), "host", "lease_s")
    left = rows.withColumn("_lease", F.lit(None).cast("struct<since:timestamp,host:string,lease_s:bigint>")).withColumn(
        "_kind", F.lit(1)
    ).withColumn("_line", F.lit(0).cast("bigint"))
    right = leases.filter("ip IS NOT NULL AND ts IS NOT NULL").select("ip", "ts", lease.alias("_lease"), F.lit(0).alias("_kind"), F.col("line_no").alias("_line"))
    both = left.unionByName(right, allowMissingColumns=True)
    bucketed = ordered.with_bucket(both, ["ip"], "ts", width)
    known = ordered.with_latest(bucketed, ["ip"], ["ts", "_kind", "_line"], "_lease", "_held").filter("_kind = 1")
    age = F.unix_micros("ts") - F.unix_micros("_held.since")
    valid = age <= F.col("_held.lease_s") * 1_000_000
    return known.select(
        *ids, "ip", "ts", F.when(valid, F.col("_held.host")).alias("host"), F.col("_held.since").alias("lease_since")
    )
