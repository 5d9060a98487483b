"""Timelines of several sources: merge, filters, integrity checks, attack chains.

Events: us (µs since 1970), source_file, line_number, event_id, host, process, user, client_ip,
action, severity, message, raw_log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.normalize import SEVERITY_RANK, rank_of
from tracelake.operators.scan import running

#: Events of a chain that are listed.
CHAIN_EVENTS = 20
FAILURES = ("SSH_LOGIN_FAILED", "SSH_LOGIN_FAILED_INVALID_USER", "INVALID_USER")


def merge(events: DataFrame) -> DataFrame:
    """Position of every event in a k-way merge of the files.

    A merge emits a file in its own order, so an event can't come before the greatest key that
    stands before it in its file; on monotonic files that is the plain sort.
    """
    key = F.struct("us", "source_file", "line_number", "event_id")
    reach = running(events, ["source_file"], ["line_number", "event_id"], {"reach": ("max", key, True)})
    return reach.orderBy("reach.us", "reach.source_file", "reach.line_number", "reach.event_id", "line_number").drop("reach")


def positions(ordered: DataFrame) -> DataFrame:
    """Numbers from 1 for the rows of a sorted table: partitions are counted, then numbered inside."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", row).checkpoint()
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a partition
    return placed.join(base, "_part").withColumn("position", (F.col("_base") + F.col("_row") + 1).cast("long")).drop("_part", "_row", "_base")


def filter_events(events: DataFrame, start_us: int | None = None, end_us: int | None = None, min_severity: str | None = None, hosts=None, users=None, ips=None, pattern: str | None = None) -> DataFrame:
    """Inclusive bounds; null never matches a list; the pattern ignores case."""
    if pattern is not None and len(pattern) > 256:
        raise ValueError("pattern of more than 256 characters")
    tests: list[Column] = []
    if start_us is not None:
        tests.append(F.col("us") >= start_us)
    if end_us is not None:
        tests.append(F.col("us") <= end_us)
    if min_severity is not None:
        tests.append(rank_of(F.col("severity")) <= SEVERITY_RANK[min_severity])
    tests += [F.col(c).isin(list(v)) for c, v in (("host", hosts), ("user", users), ("client_ip", ips)) if v]
    if pattern:
        text = F.concat(F.coalesce("message", F.lit("")), F.lit(" "), F.coalesce("action", F.lit("")), F.lit(" "), F.coalesce("raw_log", F.lit("")))
        tests.append(text.rlike(f"(?i){pattern}"))
    for t in tests:
        events = events.where(t)
    return events


def _after(events: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds each value of the file's event before; a file may be of any size."""
    return running(events, ["source_file"], ["line_number", "event_id"], {n: ("last", v, False) for n, v in values.items()})


def clock_anomalies(events: DataFrame, max_gap_s: int = 3600) -> DataFrame:
    """Backward jumps (CRITICAL) and long gaps (MEDIUM) against the file's previous event."""
    seen = _after(events, {"before": F.col("us")}).withColumn("delta", F.col("us") - F.col("before"))
    kind = F.when(F.col("delta") < 0, "NEGATIVE_JUMP").when(F.col("delta") > max_gap_s * 1_000_000, "ACTIVITY_GAP")
    return seen.withColumn("kind", kind).where("kind is not null").select("source_file", "line_number", "kind", F.when(F.col("delta") < 0, "CRITICAL").otherwise("MEDIUM").alias("severity"), "delta")


def future_events(events: DataFrame, now_us: int, tolerance_s: int = 300) -> DataFrame:
    """Events later than now and the tolerance (HIGH)."""
    return events.where(F.col("us") > now_us + tolerance_s * 1_000_000).select("source_file", "line_number", F.lit("FUTURE_TIMESTAMP").alias("kind"), F.lit("HIGH").alias("severity"), (F.col("us") - now_us).alias("delta"))


def bursts(events: DataFrame, threshold: int) -> DataFrame:
    """Runs of more than threshold consecutive events of a file in the same second (LOW)."""
    second = F.floor(F.col("us") / 1_000_000)
    seen = _after(events.withColumn("s", second), {"s_before": F.col("s")})
    new = F.when(F.col("s") == F.col("s_before"), 0).otherwise(1)
    runs = running(seen, ["source_file"], ["line_number", "event_id"], {"run": ("sum", new, True)})
    # a run is counted by task before its parts meet
    return runs.groupBy("source_file", "run").agg(F.min("line_number").alias("line_number"), F.count("*").alias("n"), F.min("s").alias("second")).where(F.col("n") > threshold).select("source_file", "line_number", F.lit("EVENT_BURST").alias("kind"), F.lit("LOW").alias("severity"), "n", "second")


def anomaly_id(*parts: str) -> Column:
    """First 12 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *(F.col(p).cast("string") for p in parts)), 256), 1, 12)


def integrity_summary(anomalies: DataFrame) -> DataFrame:
    """Counts by kind and severity."""
    return anomalies.groupBy("kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("n_files"))


def integrity_verdict(anomalies: DataFrame) -> DataFrame:
    """One row: COMPROMISED or CLEAN, how many anomalies and files, the files in order, counts by severity and kind.

    Anomalies are counted by (file, kind, severity) first, so what meets in the last task is a row
    for each of those. No anomalies: CLEAN, zeros, an empty array and empty maps.
    """
    few = anomalies.groupBy("source_file", "kind", "severity").agg(F.count("*").alias("n"))

    def counts(of: str) -> Column:
        pairs = F.collect_list(F.struct(F.col(of), F.col("n")))
        keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[of])))
        total = lambda k: F.aggregate(F.filter(pairs, lambda p: p[of] == k), F.lit(0).cast("long"), lambda a, p: a + p["n"])
        return F.map_from_arrays(keys, F.transform(keys, total))

    files = F.array_sort(F.collect_set("source_file"))
    return few.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_anomalies"), files.alias("files"), counts("severity").alias("by_severity"), counts("kind").alias("by_kind")).select(
        F.when(F.col("n_anomalies") > 0, "COMPROMISED").otherwise("CLEAN").alias("status"), "n_anomalies", F.size("files").cast("long").alias("n_files"), "files", "by_severity", "by_kind"
    )


def brute_force_chains(events: DataFrame, min_failures: int = 3) -> DataFrame:
    """Per address: enough failures; whether any login succeeded (in any order); the ids of its first events.

    Events without an address are left out. Ties in time go by failures first, then by event id.
    """
    fail = F.col("action").isin(*FAILURES)
    ok = F.col("action") == "SSH_LOGIN_SUCCESS"
    own = events.where(F.col("client_ip").isNotNull() & (fail | ok))
    got = own.groupBy("client_ip").agg(F.count_if(fail).alias("failures"), F.count_if(ok).alias("successes"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_events"))
    # Spark cuts each task's rows to the first ones before they are dealt by address
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("client_ip").orderBy("us", ok, "event_id"))).where(F.col("place") <= CHAIN_EVENTS)
    events = first.groupBy("client_ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda e: e["event_id"]).alias("first_events"))
    kind = F.when(F.col("successes") > 0, "BRUTE_FORCE_SUCCESS").otherwise("BRUTE_FORCE_SCAN")
    severity = F.when(F.col("successes") > 0, "CRITICAL").otherwise("WARNING")
    return got.where(F.col("failures") >= min_failures).withColumn("chain", kind).withColumn("severity", severity).join(events, "client_ip")


def escalation_chains(events: DataFrame, gap_s: int = 300) -> DataFrame:
    """Each login followed by sudo commands of the same user within the gap; system users left out."""
    hidden = ["root", "daemon", "nobody"]
    logins = events.where((F.col("action") == "SSH_LOGIN_SUCCESS") & F.col("user").isNotNull() & ~F.col("user").isin(hidden)).select("user", F.col("us").alias("login_us"), F.col("event_id").alias("login_id"))
    # a login's bucket and the next one hold all that lies within the gap
    width = gap_s * 1_000_000
    sudo = events.where(F.col("action") == "SUDO_COMMAND").select("user", F.col("us").alias("sudo_us"), F.floor(F.col("us") / width).alias("bucket"))
    near = logins.withColumn("bucket", F.explode(F.array(F.floor(F.col("login_us") / width), F.floor(F.col("login_us") / width) + 1)))
    pairs = near.join(sudo, ["user", "bucket"]).where((F.col("sudo_us") >= F.col("login_us")) & (F.col("sudo_us") - F.col("login_us") <= width))
    return pairs.groupBy("user", "login_id", "login_us").agg(F.count("*").alias("n_sudo"), F.max("sudo_us").alias("end_us"))
