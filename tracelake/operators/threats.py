"""Log events to windows, features, rule matches, alerts and anomaly scores.

Events: timestamp (µs since 1970 as ``us``), event_type, src_ip, dst_ip, src_port, dst_port,
user, status, bytes_sent, bytes_recv, duration. Windows are closed on both ends and start at the
first event of all, so they are numbered, not taken from F.window.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.normalize import sanitize
from tracelake.operators.scan import quantiles, running

# The 21 features in order.
FEATURES = (
    "event_count", "events_per_second", "failed_auth_count", "success_auth_count", "failed_auth_ratio", "invalid_user_count", "unique_users",
    "unique_ips", "unique_ports", "bytes_sent", "bytes_recv", "bytes_ratio", "mean_duration", "std_duration", "user_entropy",
    "mean_gap", "gap_cv", "sudo_count", "unique_dst_ips", "max_user_events", "span_seconds",
)


def entity() -> Column:
    """src_ip, else user, else global."""
    return F.coalesce(F.nullif("src_ip", F.lit("")), F.nullif("user", F.lit("")), F.lit("global"))


def sliding_windows(events: DataFrame, width_s: int, step_s: int) -> DataFrame:
    """Every event once for each window [first + k step, first + k step + width] that holds it."""
    width, step = width_s * 1_000_000, max(1, step_s) * 1_000_000
    first = events.agg(F.min("us").alias("first_us"))
    at = events.crossJoin(F.broadcast(first))  # one row
    offset = F.col("us") - F.col("first_us")
    low = F.greatest(F.lit(0), F.ceil((offset - width) / step)).cast("long")
    return at.withColumn("k", F.explode(F.sequence(low, F.floor(offset / step).cast("long")))).withColumn("window_us", F.col("first_us") + F.col("k") * step).withColumn("entity", entity())


def _failed() -> Column:
    return F.col("event_type").isin("ssh_auth_fail", "sudo_auth_fail") | (F.col("status") == "failed")


def window_features(windowed: DataFrame) -> DataFrame:
    """The features of each (window, entity); an invalid user counts as one more failure."""
    key = ["k", "entity"]
    order = Window.partitionBy(*key).orderBy("us", "event_id")
    before = F.lag("us").over(order)
    e = windowed.withColumn("gap", F.when(before.isNotNull(), F.greatest(F.lit(0.0), (F.col("us") - before) / 1e6)))
    users = e.where("user is not null and user <> ''").groupBy(*key, "user").agg(F.count("*").alias("n"))
    per_user = users.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"), F.max("n").alias("max_user_events"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    invalid = one(F.col("event_type") == "ssh_invalid_user")
    ports = F.array_distinct(F.concat(F.collect_set(F.nullif("src_port", F.lit(0))), F.collect_set(F.nullif("dst_port", F.lit(0)))))
    ips = F.array_distinct(F.concat(F.collect_set("src_ip"), F.collect_set("dst_ip")))
    got = e.groupBy(*key).agg(
        F.min("window_us").alias("window_us"), F.count("*").alias("event_count"), (one(F.coalesce(_failed(), F.lit(False))) + invalid).alias("failed_auth_count"),
        one(~F.coalesce(_failed(), F.lit(False))).alias("success_auth_count"), invalid.alias("invalid_user_count"), F.count_distinct(F.nullif("user", F.lit(""))).alias("unique_users"),
        F.size(ips).cast("long").alias("unique_ips"), F.size(ports).cast("long").alias("unique_ports"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("bytes_recv").alias("bytes_recv"),
        F.avg("duration").alias("mean_duration"), F.stddev_pop("duration").alias("std_duration"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("std_gap"), one(F.col("event_type").startswith("sudo")).alias("sudo_count"), F.count_distinct("dst_ip").alias("unique_dst_ips"),
        F.greatest((F.max("us") - F.min("us")) / 1e6, F.lit(1.0)).alias("span_seconds"),
    )
    full = got.join(per_user, key, "left")
    full = full.withColumns({
        "events_per_second": F.col("event_count") / F.col("span_seconds"),
        "failed_auth_ratio": F.col("failed_auth_count") / F.col("event_count"),
        "bytes_ratio": (F.col("bytes_sent") + 1.0) / (F.col("bytes_recv") + 1.0),
        "user_entropy": F.coalesce(F.greatest(F.lit(0.0), F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")), F.lit(0.0)),
        "gap_cv": F.col("std_gap") / (F.col("mean_gap") + 1e-6),
        "max_user_events": F.coalesce("max_user_events", F.lit(0)),
    })
    return full.select(*key, "window_us", *FEATURES)


def categorical_entropy(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy (bits) of a column within groups."""
    n = rows.groupBy(group, value).agg(F.count("*").cast("double").alias("n"))
    return n.groupBy(group).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def rolling_buffer(events: DataFrame, by: str, width_s: int) -> DataFrame:
    """Events of the same key in the last width seconds, the boundary included.

    That is how many there are up to an event's time, less how many there are before its window: both are
    marks in the running count of the key's events, which may be any number.
    """
    numbered = events.select(by, "us", F.monotonically_increasing_id().alias("_id"), F.struct(*events.columns).alias("_row"))
    mark = lambda us, kind: F.struct(us.alias("at"), F.lit(kind).alias("kind"))
    marks = numbered.select(by, "_id", "_row", F.explode(F.array(mark(F.col("us") - width_s * 1_000_000, 0), mark(F.col("us"), 1), mark(F.col("us"), 2))).alias("m"))
    marks = marks.select(by, "m.at", "m.kind", "_id", F.when(F.col("m.kind") == 2, F.col("_row")).alias("_row"))
    counted = running(marks, [by], ["at", "kind"], {"upto": ("sum", F.when(F.col("kind") == 1, 1).otherwise(0), True)})
    upto = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("upto")))
    got = counted.where("kind <> 1").groupBy("_id").agg(F.any_value("_row", True).alias("_row"), (upto(2) - upto(0)).alias("n_buffered"))
    return got.select("_row.*", "n_buffered")


def rule_counts(windowed: DataFrame) -> DataFrame:
    """What the rules need, by (window, entity), from one group-by over users and one over events."""
    key = ["k", "entity"]
    fail = F.col("event_type").isin("ssh_auth_fail", "ssh_invalid_user")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    users = windowed.where(fail).groupBy(*key, "user").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("user").alias("fail_users"), F.max("n").alias("max_per_user"))
    got = windowed.groupBy(*key).agg(
        F.min("window_us").alias("window_us"), one(fail).alias("fails"), one(F.col("event_type") == "sudo_auth_fail").alias("sudo_fails"), one(F.col("event_type") == "sudo_command").alias("sudo_commands"),
        F.sum("bytes_sent").alias("sent"), F.sum("bytes_recv").alias("recv"), F.count_distinct(F.nullif("dst_port", F.lit(0))).alias("dst_ports"),
    )
    return got.join(users, key, "left").na.fill(0, ["fail_users", "max_per_user"])


def _match(rule: str, when: Column, severity: Column | str, confidence: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), confidence.cast("double").alias("confidence")))


def brute_force(c=F.col) -> Column:
    n = c("fails")
    return _match("ssh_brute_force", (n >= 5) & (c("fail_users") <= 3), F.when(n >= 20, "CRITICAL").otherwise("HIGH"), F.least(0.70 + 0.015 * n, F.lit(0.99)))


def password_spraying(c=F.col) -> Column:
    u = c("fail_users")
    return _match("password_spraying", (u >= 4) & ~((c("max_per_user") > 4) & (u < 8)), F.when(u >= 15, "CRITICAL").otherwise("HIGH"), F.least(0.75 + 0.015 * u, F.lit(0.99)))


def data_exfiltration(c=F.col) -> Column:
    sent = c("sent")
    ratio = (sent + 1.0) / (c("recv") + 1.0)
    return _match("data_exfiltration", (sent >= 5e6) & (ratio >= 8), F.when(sent >= 5e7, "CRITICAL").otherwise("HIGH"), F.least(0.80 + sent / 1e8 * 0.15, F.lit(0.98)))


def privilege_escalation(c=F.col) -> Column:
    n = c("sudo_fails")
    return _match("privilege_escalation", (n >= 2) | ((n >= 1) & (c("sudo_commands") >= 3)), F.when(n >= 3, "HIGH").otherwise("MEDIUM"), F.lit(0.85))


def port_scan(c=F.col) -> Column:
    return _match("port_scan", c("dst_ports") >= 8, "MEDIUM", F.lit(0.80))


#: The rule registry: functions from nothing to a match struct or null, in order; extend at will.
RULES = (brute_force, password_spraying, data_exfiltration, privilege_escalation, port_scan)


def evaluate_rules(counts: DataFrame, rules=RULES) -> DataFrame:
    """All matches of each (window, entity), in rule order."""
    return counts.withColumn("matches", F.array_compact(F.array(*(rule() for rule in rules))))


def alerts(matched: DataFrame) -> DataFrame:
    """One alert a (window, entity) that triggers: a strong rule, a score of 0.5 or more, or an anomaly.

    matched: k, entity, window_us, matches, anomaly and, if the model ran, is_anomaly. The score is
    the greater of anomaly and best confidence, 4 places; a null anomaly is 0; without a rule the
    alert is statistical. Of equal confidences the last rule by name counts. Entity and summary are
    sanitised.
    """
    best = F.sort_array(F.transform("matches", lambda m: F.struct(m["confidence"].alias("confidence"), m["rule"].alias("rule"), m["severity"].alias("severity"))), asc=False)
    top = matched.withColumn("top", F.get(best, F.lit(0)))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("anomaly", F.lit(0.0)), F.coalesce(F.col("top.confidence"), F.lit(0.0)))), 4)
    any_of = lambda *s: F.exists("matches", lambda m: m["severity"].isin(*s))
    odd = F.coalesce("is_anomaly", F.lit(False)) if "is_anomaly" in matched.columns else F.lit(False)
    scored = top.withColumn("score", score).where(odd | any_of("HIGH", "CRITICAL") | (F.col("score") >= 0.5))
    at = F.col("score")
    tier = F.when((at >= 0.85) | any_of("CRITICAL"), "CRITICAL").when((at >= 0.70) | any_of("HIGH"), "HIGH").when((at >= 0.50) | any_of("MEDIUM"), "MEDIUM").otherwise("LOW")
    head = F.when(F.size("matches") > 0, F.concat(F.lit("Security Alert: "), F.col("top.rule"), F.lit(" detected"))).otherwise("Statistical Anomaly Detected")
    summary = F.concat(head, F.lit(" on entity '"), F.col("entity"), F.lit("' (Threat Score: "), F.format_string("%.2f", at), F.lit(")"))
    return scored.select("k", sanitize(F.col("entity")).alias("entity"), "window_us", "score", tier.alias("severity"), F.col("top.rule").alias("rule"), F.transform("matches", lambda m: m["rule"]).alias("rules"), sanitize(summary).alias("summary"))


def cooldown(found: DataFrame, seconds: int = 300) -> DataFrame:
    """Critical alerts pass; others only if the entity's last passed alert is at least so old (event time).

    Alerts that stand the cooldown or more behind the one before them pass whatever came before, so
    an entity's alerts are cut there, and each piece streams by in order: no entity is held whole.
    """
    order = Window.partitionBy("entity").orderBy("window_us", "k")
    apart = F.coalesce(F.col("window_us") - F.lag("window_us").over(order) >= seconds * 1_000_000, F.lit(True))
    pieces = found.withColumn("_apart", apart.cast("long")).withColumn("_piece", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last = None, 0
        for batch in batches:
            keep = []
            for i, (e, p, us, severity) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("entity", "_piece", "window_us", "severity")), strict=True)):
                if (e, p) != piece or severity == "CRITICAL" or us - last >= seconds * 1_000_000:
                    piece, last = (e, p), us
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return pieces.repartition("entity", "_piece").sortWithinPartitions("entity", "_piece", "window_us", "k").mapInArrow(run, pieces.schema).drop("_piece")


def robust_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, center, scale): median; MAD times 1.4826, else the deviation, else 1. Medians are exact."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select("f.feature", "f.x")
    centers = quantiles(long, [0.5]).select("feature", F.col("value").alias("center"))
    away = long.join(F.broadcast(centers), "feature").select("feature", F.abs(F.col("x") - F.col("center")).alias("x"))  # a row a feature
    spread = quantiles(away, [0.5]).select("feature", F.col("value").alias("mad"))
    dev = long.groupBy("feature").agg(F.stddev_pop("x").alias("dev"))
    scale = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(F.col("dev") > 0, F.col("dev")).otherwise(1.0)
    return dev.join(centers, "feature").join(spread, "feature").select("feature", "center", scale.alias("scale"))


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, tn and the usual ratios, 4 places: one row."""
    n = lambda p, a: F.count_if((F.col(predicted) == p) & (F.col(actual) == a))
    got = rows.agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    four = lambda x: F.round(x, 4)
    return got.select("tp", "fp", "fn", "tn", four(p).alias("precision"), four(r).alias("recall"), four(safe(2 * p * r, p + r)).alias("f1"), four(safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


# hybrid anomaly scores


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> list:
    """An isolation tree as nested [feature, cut, left, right], leaves as [size]."""
    if depth >= most or len(x) <= 1 or (x == x[0]).all():
        return [len(x)]
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, most), _grow(x[~left], rng, depth + 1, most)]


def average_path(n: float) -> float:
    """The average path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))

    def walk(node: list, rows: np.ndarray, depth: int) -> None:
        if len(node) == 1:
            out[rows] = depth + average_path(node[0])
            return
        left = x[rows, node[0]] < node[1]
        walk(node[2], rows[left], depth + 1)
        walk(node[3], rows[~left], depth + 1)

    walk(tree, np.arange(len(x)), 0)
    return out


def fit_model(rows: DataFrame, columns: list[str], trees: int = 15, sample: int = 128, ridge: float = 1e-3, seed: int = 42, weights: tuple[float, float, float] = (0.5, 0.5, 0.85)) -> dict:
    """Scale, inverse covariance, distance threshold and isolation trees, as a JSON-able model.

    Statistics are aggregates over all rows; the trees take a bounded sample each (trees times
    sample rows, by hash), which is all that reaches the driver besides the d by d moments.
    """
    clean = rows.select(*(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))).alias(c) for c in columns))
    scale = {r["feature"]: (r["center"], r["scale"]) for r in robust_scale(clean, columns).collect()}
    z = clean.select(*((F.col(c) - scale[c][0]) / scale[c][1] for c in columns)).toDF(*columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    moments = z.agg(*(F.covar_samp(a, b) for a, b in pairs)).first()
    d = len(columns)
    cov = np.zeros((d, d))
    for (a, b), v in zip(pairs, moments, strict=False):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = v or 0.0
    # the scaled median is 0 up to the division's rounding
    inverse, center = np.linalg.pinv(cov + ridge * np.eye(d)), np.zeros(d)
    model = {"columns": list(columns), "center": [scale[c][0] for c in columns], "scale": [scale[c][1] for c in columns], "inverse": inverse.tolist(), "middle": center.tolist(), "threshold": 1.0, "trees": [], "sample": sample, "weights": list(weights)}
    far = quantiles(score(clean, {**model, "threshold": None}).select(F.lit("distance").alias("feature"), F.col("distance").alias("x")), [0.99]).first()
    model["threshold"] = max(1.5 * (far.value if far else 0.0), 10.0)
    picked = np.array([list(r) for r in z.orderBy(F.xxhash64(*columns, F.lit(seed))).limit(trees * sample).collect()], dtype=float).reshape(-1, d)
    rng = np.random.default_rng(seed)
    for _ in range(trees if len(picked) else 0):
        own = picked[rng.choice(len(picked), min(sample, len(picked)), replace=False)]
        model["trees"].append(_grow(own, rng, 0, max(1, math.ceil(math.log2(sample)))))
    return model


def save_model(model: dict, path: str) -> None:
    """The model as one JSON file, without pickled objects."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model, f)


def load_model(path: str) -> dict:
    """A saved model; raises ValueError if it isn't one."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if missing := {"columns", "center", "scale", "inverse", "middle", "threshold", "trees", "sample"} - set(model if isinstance(model, dict) else ()):
        raise ValueError(f"{path}: not a model, without {sorted(missing)}")
    return model


def score(rows: DataFrame, model: dict) -> DataFrame:
    """distance, isolation, mahalanobis and the hybrid score of each row; other columns stay."""
    columns = model["columns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse, middle = np.array(model["inverse"]), np.array(model["middle"])
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1) if len(batch) else np.zeros((0, len(columns)))
            x = np.clip(np.nan_to_num(x, nan=0.0, posinf=1e9, neginf=-1e9), -1e9, 1e9)
            x = (x - np.array(model["center"])) / np.array(model["scale"])
            delta = x - middle
            distance = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", delta, inverse, delta), 0))
            maha = 1 - np.exp(-0.5 * (distance / (model["threshold"] or 1.0)) ** 2)
            depth = np.mean([_depths(t, x) for t in model["trees"]], axis=0) if model["trees"] and len(x) else np.full(len(x), np.inf)
            iso = np.clip((2 ** (-depth / (average_path(model["sample"]) or 1.0)) - 0.40) / 0.30, 0, 1)
            of_iso, of_maha, of_most = model.get("weights", (0.5, 0.5, 0.85))  # a weighted mean, or a share of the higher one
            both = np.clip(np.maximum(of_iso * iso + of_maha * maha, of_most * np.maximum(iso, maha)), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (distance, iso, maha, both))], names=[*batch.schema.names, "distance", "isolation", "mahalanobis", "anomaly"])

    extra = "distance double, isolation double, mahalanobis double, anomaly double"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {extra}")


def detect(rows: DataFrame, model: dict, threshold: float) -> DataFrame:
    """Scores with is_anomaly (a score of the threshold or more) and each feature's share of the deviation.

    contributions: feature to its absolute scaled value over the sum of all, 4 places; null, NaN and
    infinite values count as score takes them.
    """
    scored = score(rows, model)

    def deviation(c: str, center: float, scale: float) -> Column:
        value = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.abs((F.greatest(F.lit(-1e9), F.least(F.lit(1e9), value)) - center) / scale)

    z = F.array(*(deviation(*x) for x in zip(model["columns"], model["center"], model["scale"], strict=True)))
    total = F.aggregate("_z", F.lit(1e-6), lambda a, x: a + x)
    share = F.map_from_arrays(F.array(*map(F.lit, model["columns"])), F.transform("_z", lambda x: F.round(x / total, 4)))
    four = {c: F.round(c, 4) for c in ("isolation", "mahalanobis", "anomaly")}
    return scored.withColumns(four).withColumn("_z", z).withColumn("contributions", share).withColumn("is_anomaly", F.col("anomaly") >= threshold).drop("_z")
