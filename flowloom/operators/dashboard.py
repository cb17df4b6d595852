"""Reports over the log table, as a console shows them.

Top lists order equal counts by latest appearance (highest ``id``).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import (
    DETECTION_SOURCES, LEGACY_RULE_ID, LOG_COLUMNS, NOTE_BLOCKLISTED, SEVERITY_RANK,
)
from ..functions import labels as lab, network as net
from ..functions.columns import filled, is_true


# --- row expressions --------------------------------------------------------

def _fallback_severity() -> Column:
    benign = is_true(F.lower("prediction").isin("normal", "benign"))
    return F.when(benign, "info").when(F.col("reason") == "high_packet_rate", "critical").otherwise("medium")


def shown_severity() -> Column:
    """Stored severity, or one derived from the row; unknown words are info."""
    word = F.lower(F.coalesce(filled("severity"), _fallback_severity()))
    return F.when(word.isin(*SEVERITY_RANK), word).otherwise("info")


def shown_rule() -> Column:
    return F.coalesce(filled("rule_id"), F.lit(LEGACY_RULE_ID))


def shown_signature() -> Column:
    return F.coalesce(filled("signature"), filled("prediction"), F.lit("Metadata baseline"))


def enrich(logs: DataFrame) -> DataFrame:
    """Fill severity, rule and signature of old or partial rows."""
    return logs.withColumns({
        "severity": shown_severity(), "rule_id": shown_rule(), "signature": shown_signature()})


def is_warning() -> Column:
    return is_true(F.col("action") == "warning") | is_true(F.lower("reason") == "model_uncertain_attack")


def is_threat() -> Column:
    blocked = is_true(F.col("action") == "blocked")
    return blocked | (~is_warning() & (shown_severity() != "info"))


def verdict() -> Column:
    return (
        F.when(F.col("action") == "blocked", "BLOCKED").when(is_warning(), "WARNING")
        .when(is_threat(), "MALICIOUS").otherwise("SAFE")
    )


def attack_label() -> Column:
    named = F.coalesce(filled("attack_label"), filled("prediction"), filled("signature"), F.lit("-"))
    return F.when(is_threat() | is_warning(), named).otherwise("-")


def severity_rank() -> Column:
    out = F
    for word, rank in SEVERITY_RANK.items():
        out = out.when(F.col("severity") == word, rank)
    return out.otherwise(0)


# --- reports ----------------------------------------------------------------

def _top(rows: DataFrame, value: Column, name: str, k: int) -> DataFrame:
    return (
        rows.select(value.alias(name), "id").groupBy(name)
        .agg(F.count(F.lit(1)).alias("count"), F.max("id").alias("last_id"))
        .orderBy(F.desc("count"), F.desc("last_id")).limit(k)
    )


def top_entities(logs: DataFrame, column: str = "source_ip", k: int = 6) -> DataFrame:
    """Most frequent sources or targets."""
    return _top(logs.filter(filled(column).isNotNull()), F.col(column), "entity", k)


def top_sources(logs: DataFrame, k: int = 6) -> DataFrame:
    """As ``top_entities``, with absent sources shown as a dash."""
    return _top(logs, F.coalesce(filled("source_ip"), F.lit("-")), "source", k)


def top_attacks(logs: DataFrame, k: int = 6) -> DataFrame:
    return _top(enrich(logs).filter(is_threat()), attack_label(), "attack", k)


def top_ports(logs: DataFrame, k: int = 7) -> DataFrame:
    """Most frequent destination ports; equal counts by port, ``Other`` last."""
    port = F.when(F.col("destination_port") != 0, F.col("destination_port"))
    counts = logs.groupBy(port.alias("number")).agg(F.count(F.lit(1)).alias("count"))
    return (
        counts.orderBy(F.desc("count"), F.asc_nulls_last("number")).limit(k)
        .select(F.coalesce(F.col("number").cast("string"), F.lit("Other")).alias("port"), "count")
    )


def protocol_mix(logs: DataFrame, k: int = 6, absent: str = "UNKNOWN") -> DataFrame:
    """Most frequent protocols with their rounded share of all rows."""
    counts = logs.groupBy(F.coalesce(filled("protocol"), F.lit(absent)).alias("protocol")).agg(
        F.count(F.lit(1)).alias("count"), F.max("id").alias("last_id"))
    total = counts.agg(F.sum("count")).scalar()
    share = F.floor(F.col("count") * F.lit(100.0) / total + F.lit(0.5)).cast("int")
    return counts.withColumn("pct", share).orderBy(F.desc("count"), F.desc("last_id")).limit(k)


def entity_count(logs: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct addresses over sources and targets."""
    both = logs.select(F.explode(F.array(filled("source_ip"), filled("destination_ip"))).alias("ip"))
    count = F.approx_count_distinct("ip") if approximate else F.count_distinct("ip")
    return both.filter(F.col("ip").isNotNull()).agg(count.alias("entities"))


def kpis(logs: DataFrame) -> DataFrame:
    """Headline counts and the busiest source, in one row."""
    talker = top_entities(logs, "source_ip", 1).select("entity").scalar()
    return logs.agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(is_threat()).alias("alerts"),
        F.count_if(F.col("encrypted_likely").cast("boolean")).alias("encrypted"),
        F.count_if(F.col("action") == "blocked").alias("blocked"),
        F.count_if(shown_severity() == "critical").alias("critical"),
    ).withColumn("top_talker", F.coalesce(talker, F.lit("-")))


def alert_queue(logs: DataFrame, k: int = 8) -> DataFrame:
    """Alerts grouped by signature, ends and severity, with their newest row."""
    alerts = enrich(logs).filter(is_threat() | is_warning())
    key = ["signature", "source_ip", "destination_ip", "severity"]
    grouped = alerts.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.max("id").alias("last_id"))
    ranked = grouped.orderBy(severity_rank().desc(), F.desc("count"), F.desc("last_id")).limit(k)
    # The newest rows of the k groups only; the k rows are broadcast.
    best = ranked.select(*[F.col(c).alias(f"_{c}") for c in key], "count", "last_id")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    newest = Window.partitionBy(*key).orderBy(F.desc("timestamp"), F.desc("id"))
    rows = alerts.select(*key, "id", "timestamp", "source_port", "destination_port").join(F.broadcast(best), same)
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1)
    return rows.orderBy(severity_rank().desc(), F.desc("count"), F.desc("last_id")).select(
        *key, "count", "last_id", F.col("id").alias("newest_id"),
        net.endpoint("source_ip", "source_port").alias("source"),
        net.endpoint("destination_ip", "destination_port").alias("destination"),
    )


def traffic_buckets(logs: DataFrame, now: dt.datetime, n: int = 12, step: int = 300) -> DataFrame:
    """Safe and threat counts around ``n`` centres, ``step`` seconds apart, the
    last at ``now`` cut to the minute. A row goes to the nearest centre, on a
    tie to the earlier; rows outside go to the end buckets."""
    last = now.replace(second=0, microsecond=0, tzinfo=now.tzinfo or dt.timezone.utc)
    first_us = (int(last.timestamp()) - (n - 1) * step) * 1_000_000
    step_us = step * 1_000_000
    offset = (F.unix_micros("timestamp") - F.lit(first_us)) * 2 + F.lit(step_us - 1)
    slot = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(offset / F.lit(2 * step_us)))).cast("int")
    threat = is_threat()
    counts = logs.groupBy(slot.alias("bucket")).agg(
        F.count_if(~threat).alias("safe"), F.count_if(threat).alias("threat"))
    slots = logs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return slots.join(counts, "bucket", "left").select(
        "bucket",
        F.timestamp_micros(F.lit(first_us) + F.col("bucket").cast("long") * F.lit(step_us)).alias("centre"),
        F.coalesce("safe", F.lit(0)).alias("safe"), F.coalesce("threat", F.lit(0)).alias("threat"))


def alert_timeline(logs: DataFrame, n: int = 10, which: str = "oldest") -> DataFrame:
    """Threats per minute: the ``oldest`` or the ``newest`` n minutes with any."""
    minute = F.date_trunc("minute", "timestamp")
    counts = logs.filter(is_threat()).groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("count"))
    order = F.col("minute").asc() if which == "oldest" else F.col("minute").desc()
    return counts.orderBy(order).limit(n).orderBy("minute")


def search_logs(logs: DataFrame, text: str = "", severity: str = "all", action: str = "all") -> DataFrame:
    """Rows whose shown texts contain ``text`` literally, whatever its case."""
    fields = [filled(c) for c in ("source_ip", "destination_ip", "protocol", "prediction", "reason")]
    hay = F.lower(F.concat_ws(" ", *fields, shown_signature(), shown_rule()))
    hits = logs
    if text:
        hits = hits.filter(F.contains(hay, F.lit(text.strip().lower())))
    if severity != "all":
        hits = hits.filter(shown_severity() == severity)
    if action != "all":
        hits = hits.filter(F.col("action") == action)
    return hits


def alerts(logs: DataFrame) -> DataFrame:
    """The enriched rows of threats and warnings with ``alert_key``, the identity of an alert.
    They are looked for among the columns as stored, each test once: filters on derived
    columns take copies of all that these are made of."""
    grave = F.lower(F.coalesce(filled("severity"), _fallback_severity())).isin(*[w for w in SEVERITY_RANK if w != "info"])
    rows = enrich(logs.filter(is_true(F.col("action") == "blocked") | is_warning() | is_true(grave)))
    label = F.coalesce(filled("attack_label"), filled("prediction"), filled("signature"), F.lit("-"))
    source = F.lower(F.coalesce(filled("source_ip"), F.lit("unknown")))
    return rows.filter(label != "-").withColumn("alert_key", F.concat_ws("|", source, F.lower(label)))


def first_alerts(logs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first row of each alert identity not in ``seen`` (column ``alert_key``)."""
    rows = alerts(logs)
    if seen is not None:
        rows = rows.join(seen.select("alert_key").distinct(), "alert_key", "left_anti")
    first = Window.partitionBy("alert_key").orderBy("id")
    best = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    return best.select("alert_key", *[c for c in logs.columns if c != "alert_key"])


def event_detail(logs: DataFrame, event_id: int) -> DataFrame:
    """All shown fields of one event."""
    row = enrich(logs).filter(F.col("id") == event_id)
    return row.select(
        *[c for c in LOG_COLUMNS if c not in ("source_ip", "source_port", "destination_ip", "destination_port",
                                              "encrypted_likely", "ml_confidence")],
        net.endpoint("source_ip", "source_port").alias("source"),
        net.endpoint("destination_ip", "destination_port").alias("destination"),
        F.when(F.col("encrypted_likely").cast("boolean"), "Likely").otherwise("No").alias("encrypted"),
        lab.confidence_band("ml_confidence").alias("model_certainty"),
    )


def rule_catalogue(spark) -> DataFrame:
    return spark.createDataFrame(list(DETECTION_SOURCES), "source_id string, name string, category string")


def rule_hits(logs: DataFrame) -> DataFrame:
    """Rows per detection source. A row on the blocklist counts for its rule and
    for the response source. The catalogue has five rows, hence the broadcast."""
    rule = shown_rule()
    ids = [s[0] for s in DETECTION_SOURCES]
    own = F.when(rule.startswith("ML-"), "ML-*").when(rule.isin(*ids), rule)
    listed = F.when(F.col("response_note") == NOTE_BLOCKLISTED, "RESPONSE")
    hits = logs.select(F.explode(F.array_compact(F.array(own, listed))).alias("source_id"))
    counts = hits.groupBy("source_id").agg(F.count(F.lit(1)).alias("hits"))
    catalogue = F.broadcast(rule_catalogue(logs.sparkSession))
    return counts.join(catalogue, "source_id", "right").select(
        "source_id", "name", "category", F.coalesce("hits", F.lit(0)).alias("hits"))


def rule_categories(logs: DataFrame) -> DataFrame:
    """Sources and hits per category."""
    return rule_hits(logs).groupBy("category").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("hits").alias("hits"))
