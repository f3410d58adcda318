"""Typed DNS logs, traffic profiles, sessions and host attribution over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplog.binding import views as V
from sweeplog.binding.registry import register
from sweeplog.operators import traffic as T
from sweeplog.session import materialize
from sweeplog.sources import typed

SESSION_GAP_S = 86_400

ADDRESS = "'10.0.' || (user_id // 250) || '.' || (user_id % 250)"

DNS = f"""
dns AS (
  SELECT event_id + 9 AS line_no, 'dns-' || (user_id % 4) || '.log' AS file, ts, epoch_us(ts) AS micros, {ADDRESS} AS source,
         CASE WHEN event_id % 41 <> 0 THEN CASE WHEN k % 4 <> 0 THEN left(digest, k % 24 + 8) || '.t' ELSE '' END END AS label,
         CASE WHEN event_id % 41 <> 0 THEN event_type || '-sync.net' END AS domain,
         CASE WHEN k % 5 < 3 THEN 'TXT' ELSE 'CNAME' END AS qtype_name,
         CASE WHEN event_id % 7 <> 0 THEN 'NOERROR' ELSE 'NXDOMAIN' END AS rcode_name,
         CASE WHEN k % 3 <> 0 THEN digest || ',x' END AS answers, k, event_id
  FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS digest, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def dns(spark, sf_dir):
    return typed.tab_separated(materialize(V.dns_lines(spark, sf_dir), "dns-log"))


@register("dns_records", f"""WITH {DNS}
SELECT file, line_no, micros AS ts_micros, source, CAST(event_id % 16384 + 49152 AS BIGINT) AS source_port, k / 1000.0::DOUBLE AS rtt,
       CASE WHEN label = '' THEN domain ELSE label || '.' || domain END AS query, qtype_name, rcode_name,
       answers, CASE WHEN answers IS NOT NULL THEN 90.5::DOUBLE END AS ttl_sum, event_id % 3 = 0 AS rejected, false AS malformed FROM dns""")
def dns_records(spark, sf_dir):
    return dns(spark, sf_dir).select(
        "file", "line_no", F.round(F.col("ts") * 1e6).cast("bigint").alias("ts_micros"), F.col("id_orig_h").alias("source"),
        F.col("id_orig_p").alias("source_port"), "rtt", "query", "qtype_name", "rcode_name",
        F.array_join("answers", ",").alias("answers"),
        F.aggregate("TTLs", F.lit(0.0), lambda n, v: n + v).alias("ttl_sum"), "rejected", "malformed",
    )


@register("traffic_profile", f"""WITH {DNS}
SELECT source, domain, qtype_name, count(*) AS queries, CAST(count(*) FILTER (WHERE rcode_name = 'NOERROR') AS DOUBLE) / count(*) AS noerror_share,
       count(DISTINCT label) AS distinct_labels, CAST(sum(length(label)) AS DOUBLE) / count(*) AS mean_label_length,
       max(length(label)) AS max_label_length, CAST(sum(coalesce(length(answers), 0)) AS DOUBLE) / count(*) AS mean_payload
FROM dns WHERE domain IS NOT NULL GROUP BY ALL""")
def traffic_profile(spark, sf_dir):
    return T.profile(T.flows(dns(spark, sf_dir)))


@register("query_type_share", f"""WITH {DNS}
SELECT source, domain, count(*) AS queries, CAST(count(*) FILTER (WHERE qtype_name = 'TXT') AS DOUBLE) / count(*) AS txt_share,
       CAST(count(*) FILTER (WHERE rcode_name = 'NOERROR') AS DOUBLE) / count(*) AS noerror_share
FROM dns WHERE domain IS NOT NULL GROUP BY ALL""")
def query_type_share(spark, sf_dir):
    return T.type_share(T.flows(dns(spark, sf_dir)))


GAPS = f"""{DNS},
gaps AS (SELECT *, micros - lag(micros) OVER (PARTITION BY source, domain ORDER BY micros, line_no) AS gap FROM dns WHERE domain IS NOT NULL)"""


@register("burst_sessions", f"""WITH {GAPS},
n AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > {SESSION_GAP_S} * 1000000::BIGINT THEN 1 ELSE 0 END)
             OVER (PARTITION BY source, domain ORDER BY micros, line_no) AS BIGINT) AS session_no FROM gaps)
SELECT source, domain, session_no, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS events FROM n GROUP BY ALL""")
def burst_sessions(spark, sf_dir):
    found = T.sessions(T.flows(dns(spark, sf_dir)), SESSION_GAP_S)
    return found.select(
        "source", "domain", "session_no", F.unix_micros("first_ts").alias("first_micros"),
        F.unix_micros("last_ts").alias("last_micros"), "events",
    )


@register("gap_regularity", f"""WITH {GAPS}
SELECT source, domain, count(*) AS gaps, CAST(sum(gap) AS DOUBLE) / count(*) / 1e6 AS mean_s,
       CAST(floor(stddev_pop(gap / 1e6) * 1000) AS BIGINT) AS stddev_ms FROM gaps WHERE gap IS NOT NULL GROUP BY ALL""")
def gap_regularity(spark, sf_dir):
    found = T.regularity(T.flows(dns(spark, sf_dir)))
    return found.select(
        "source", "domain", "gaps", "mean_s", F.floor(F.col("stddev_s") * 1000).cast("bigint").alias("stddev_ms")
    )


LEASES = f"""
leases AS (
  SELECT event_id + 1 AS line_no, date_trunc('second', ts) AS since, {ADDRESS} AS ip, 'wks-' || event_id AS host,
         CASE WHEN event_id % 2 = 0 THEN 'ACK' ELSE 'RENEW' END AS action,
         (CAST(json_extract(props, '$.k') AS BIGINT) + 1) * 3600 AS lease_s
  FROM events WHERE event_type = 'signup'
)"""


@register("lease_records", f"""WITH {LEASES}
SELECT line_no, epoch_us(since) AS ts_micros, action, ip, '00:1b:44:00:00:01' AS mac, host, lease_s FROM leases""")
def lease_records(spark, sf_dir):
    rows = typed.leases(V.lease_lines(spark, sf_dir))
    return rows.select("line_no", F.unix_micros("ts").alias("ts_micros"), "action", "ip", "mac", "host", "lease_s")


@register("host_attribution", f"""WITH {LEASES},
once AS (SELECT * FROM leases QUALIFY row_number() OVER (PARTITION BY ip, since ORDER BY line_no DESC) = 1),
e AS (SELECT event_id, {ADDRESS} AS ip, ts FROM events WHERE event_type <> 'signup')
SELECT e.event_id, e.ip, CASE WHEN epoch_us(e.ts) - epoch_us(l.since) <= l.lease_s * 1000000::BIGINT THEN l.host END AS host,
       epoch_us(l.since) AS since_micros
FROM e ASOF LEFT JOIN once l ON e.ip = l.ip AND e.ts >= l.since""")
def host_attribution(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").filter("event_type <> 'signup'").select(
        "event_id", V.address(F.col("user_id")).alias("ip"), F.col("ts").cast("timestamp").alias("ts")
    )
    held = T.attribute_hosts(rows, typed.leases(V.lease_lines(spark, sf_dir)))
    return held.select("event_id", "ip", "host", F.unix_micros("lease_since").alias("since_micros"))
