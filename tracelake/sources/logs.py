"""Log lines to events, as ordered regular expressions over a column of lines.

Every parser takes a DataFrame with a string column ``value`` (and, for timelines, source_file and
line_number) and adds columns; a pattern's groups are taken once, as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.ranges import read_lines  # lines of files of any size
from tracelake.functions.normalize import epoch_us, event_id, facility_of, normalize_severity, parse_time, severity_of, truncate_raw

MAX_LINE, MAX_JSON = 65_536, 131_072

# Header and message patterns (Java dialect, groups by position).
_BSD = r"^([A-Z][a-z]{2}\s+[0-9]+\s+[0-9]{2}:[0-9]{2}:[0-9]{2})\s+(\S+)\s+([\w.\-]+)(?:\[([0-9]+)\])?:\s+(.*)$"
_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+\-][0-9]{2}:[0-9]{2})?)\s+(\S+)\s+([\w.\-]+)(?:\[([0-9]+)\])?:\s+(.*)$"
_RFC5424 = r"^<([0-9]{1,3})>[0-9]+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)$"
_IP = r"([a-fA-F0-9.:]+)"
_FAILED = rf"Failed\s+password\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+{_IP}\s+port\s+([0-9]+)\s+ssh2"
_INVALID = rf"Invalid\s+user\s+(\S+)\s+from\s+{_IP}\s+port\s+([0-9]+)"
_ACCEPTED = rf"Accepted\s+(?:password|publickey)\s+for\s+(\S+)\s+from\s+{_IP}\s+port\s+([0-9]+)\s+ssh2"
_DISCONNECT = rf"(?:Disconnected\s+from|Received\s+disconnect\s+from)\s+(?:invalid\s+user\s+|authenticating\s+user\s+)?(?:(\S+)\s+)?{_IP}\s+port\s+([0-9]+)"
_PAM = rf"pam_unix\(sshd:auth\):\s+authentication\s+failure;\s+.*rhost={_IP}(?:\s+user=(\S+))?"
_SUDO_FAIL = r"pam_unix\(sudo:auth\):\s+authentication\s+failure;\s+.*rhost=(\S*)\s+user=(\S*)"
_SUDO = r"(\S+)\s*:\s*TTY=(\S*)\s*;\s*PWD=(\S*)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.*)"
_AUTH = r"(?s)^(?:<([0-9]{1,3})>)?((?:[A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?|[0-9]{4}-[0-9]{2}-[0-9]{2}T\S+))\s+([^\s:]+)\s+([^:\[\s]+)(?:\[([0-9]{1,10})\])?:\s*(.*)$"
_ACCESS = r'(?s)^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+([0-9]{3})\s+([0-9]+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
_ERROR = r'(?s)^([0-9]{4}/[0-9]{2}/[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)\s+\[([a-zA-Z]+)\]\s+([0-9]+)#([0-9]+):\s+(?:\*([0-9]+)\s+)?(.*?)(?:,\s+client:\s+([^,]+))?(?:,\s+server:\s+([^,]+))?(?:,\s+request:\s+"([^"]*)")?(?:,\s+host:\s+"([^"]*)")?$'
_SYSLOG5424 = r"(?s)^<([0-9]{1,3})>([0-9]{1,2})\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(\[.+?\]|-))?(?:\s+(.*))?$"
_SYSLOG3164 = r"(?s)^(?:<([0-9]{1,3})>)?([A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)\s+([^\s:]+)\s+(?:([^:\[\s]+)(?:\[([0-9]{1,10})\])?:\s*)?(.*)$"
#: Timeline message patterns in order: (pattern, action, severity, group of the user, group of the address).
AUTH_ACTIONS = (
    (r"^Accepted\s+(?:publickey|password|keyboard-interactive)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+([0-9]+)", "SSH_LOGIN_SUCCESS", "NOTICE", 1, 2),
    (r"^Failed\s+(?:password|publickey|none)\s+for\s+invalid\s+user\s+(\S+)\s+from\s+(\S+)\s+port\s+([0-9]+)", "SSH_LOGIN_FAILED_INVALID_USER", "WARNING", 1, 2),
    (r"^Failed\s+(?:password|publickey|none)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+([0-9]+)", "SSH_LOGIN_FAILED", "WARNING", 1, 2),
    (r"^Invalid\s+user\s+(\S+)\s+from\s+(\S+)\s+port\s+([0-9]+)", "INVALID_USER", "WARNING", 1, 2),
    (r"^(?:Disconnected\s+from|Connection\s+closed\s+by)(?:\s+authenticating)?(?:\s+invalid)?(?:\s+user\s+(\S+))?\s+(\S+)\s+port\s+([0-9]+)", "SSH_DISCONNECT", "INFO", 1, 2),
    (r"^\s*(\S+)\s*:\s*TTY=(\S+)\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.*)$", "SUDO_COMMAND", "NOTICE", 1, 0),
    (r"^pam_unix\(sudo:session\):\s*session opened for user ([^\s(]+)(?:\(uid=[0-9]+\))? by ([^\s(]+)?(?:\(uid=[0-9]+\))?", "PAM_SESSION_OPEN", "NOTICE", 2, 0),
    (r"^pam_unix\(sudo:session\):\s*session closed for user ([^\s(]+)", "PAM_SESSION_CLOSE", "INFO", 1, 0),
    (r"^\s*(\S+)\s*:\s*([0-9]+)\s+incorrect password attempts", "SUDO_FAILED_AUTH", "ALERT", 1, 0),
    (r"^new user:\s*name=([^,\s]+)", "USER_CREATED", "CRITICAL", 1, 0),
    (r"^password changed for (\S+)", "PASSWORD_CHANGED", "CRITICAL", 1, 0),
)
#: JSON keys in order of preference, by field.
JSON_KEYS = {
    "timestamp": ("timestamp", "@timestamp", "time", "ts", "datetime", "date", "event_time", "created_at", "time_utc"),
    "message": ("message", "msg", "log", "event", "text", "description", "summary"),
    "severity": ("severity", "level", "log_level", "status", "loglevel"),
    "host": ("host", "hostname", "node", "computer", "device", "host_name"),
    "process": ("process", "service", "app", "application", "program", "logger"),
    "pid": ("pid", "process_id", "proc_id"),
    "user": ("user", "username", "account", "actor", "login", "user_name"),
    "client_ip": ("client_ip", "ip", "src_ip", "source_ip", "remote_addr", "remote_ip"),
    "action": ("action", "event_type", "type", "operation", "audit_action", "event_name"),
}


def group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match; null where the pattern or the group doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _which(text: Column, patterns: list[str]) -> Column:
    """The index of the first pattern found in a text, -1 if none is."""
    out = F.when(F.lit(False), -1)
    for i, p in enumerate(patterns):
        out = out.when(text.rlike(p), i)
    return out.otherwise(-1)


def _by(which: Column, values: list[Column], other: Column) -> Column:
    """The value at an index, or another."""
    out = F.when(F.lit(False), other)
    for i, v in enumerate(values):
        out = out.when(which == i, v)
    return out.otherwise(other)


def _auth_metadata(m: Column, first, none: Column) -> Column:
    """What a message tells besides user and address: port, sudo's terminal, folder, target and command, attempts."""
    keys = {"port": 3, "tty": 2, "pwd": 3, "target_user": 4, "command": 5, "attempts": 2}
    kinds = {"port": ("SSH",), "tty": ("SUDO_COMMAND",), "pwd": ("SUDO_COMMAND",), "target_user": ("SUDO_COMMAND", "PAM_SESSION_OPEN"), "command": ("SUDO_COMMAND",), "attempts": ("SUDO_FAILED_AUTH",)}

    def value(name: str):
        def of(s) -> Column:
            ssh = s[1].startswith("SSH") or s[1] == "INVALID_USER"
            if not (ssh and name == "port" or s[1] in kinds[name]):
                return none
            return group(m, s[0], 1 if s[1] == "PAM_SESSION_OPEN" else keys[name])

        return of

    pairs = [x for name in keys for x in (F.lit(name), first(value(name), none))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def read_events(spark: SparkSession, path: str, default_year: int, kind: str | None = None) -> DataFrame:
    """Events of one log file; without a kind it is told by the first lines."""
    kind = kind or detect_format([r["value"] for r in spark.read.text(path).limit(10).collect()])
    return PARSERS[kind](read_lines(spark, path), default_year)


def with_event_ids(events: DataFrame) -> DataFrame:
    """Adds event_id to a timeline's events (source_file, line_number, timestamp, raw_log): the same line of the same file has the same id."""
    return events.withColumn("event_id", event_id(F.col("source_file"), F.col("line_number"), F.unix_micros("timestamp"), F.col("raw_log")))


def detect_format(sample: list[str]) -> str:
    """jsonl, nginx, auth or syslog, from a file's first lines."""
    import re

    for line in sample[:10]:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if text.startswith("{"):
            return "jsonl"
        if re.match(_ACCESS.replace("(?s)", ""), text) or re.match(r"[0-9]{4}/[0-9]{2}/[0-9]{2}\s", text):
            return "nginx"
        return "auth" if re.search(r"sshd|sudo|pam_unix|useradd|passwd", text) else "syslog"
    return "syslog"


# Keys of a JSON event that have columns of their own.
JSON_OWN = (
    "timestamp", "ts", "@timestamp", "src_ip", "dst_ip", "src_port", "dst_port",
    "orig_h", "resp_h", "orig_p", "resp_p", "user", "username", "action", "status",
    "bytes_sent", "bytes_recv", "orig_bytes", "resp_bytes", "duration", "event_type", "is_anomaly",
)


def parse_security(lines: DataFrame, default_year: int, hint: str = "auto") -> DataFrame:
    """Typed security events; never drops a line.

    A line that begins as an object does counts as JSON, cut ones too. hint: auto, or json or syslog to read every line as that; what isn't RFC 5424 then falls back to the plain headers.
    metadata has a message's host, pid, or priority and ids, a sudo command with its target, and a
    JSON event's other keys.
    """
    if hint not in ("auto", "json", "syslog"):
        raise ValueError("hint is auto, json or syslog")
    v = F.trim("value")
    too_long, empty = F.length("value") > MAX_LINE, F.coalesce(v, F.lit("")) == ""
    is_json, is_5424 = F.lit(hint == "json") | F.lit(hint == "auto") & v.startswith("{"), v.rlike(_RFC5424)
    iso, bsd = v.rlike(_ISO), v.rlike(_BSD)
    pick = lambda i: F.when(iso, group(v, _ISO, i)).when(bsd, group(v, _BSD, i))
    message = F.when(is_5424, group(v, _RFC5424, 8)).otherwise(pick(5))
    process = F.when(is_5424, group(v, _RFC5424, 4)).otherwise(pick(3))
    at = parse_time(F.when(is_5424, group(v, _RFC5424, 2)).otherwise(pick(1)), default_year)
    head = lines.withColumns({"_v": v, "_m": F.coalesce(message, F.lit("")), "_p": process, "_at": at, "_json": F.when(is_json & ~too_long, F.from_json(v, "map<string,string>")), "_kind": F.when(empty, "empty").when(too_long, "long").when(is_json, "json").when(is_5424 | iso | bsd, "log").otherwise("plain")})
    j = lambda *k: F.coalesce(*(F.try_element_at("_json", F.lit(x)) for x in k))
    m = F.col("_m")
    steps = (
        (_FAILED, "ssh_auth_fail", "ssh_login", "failed", 1, 2, 3), (_INVALID, "ssh_invalid_user", "ssh_login_invalid_user", "failed", 1, 2, 3),
        (_ACCEPTED, "ssh_auth_success", "ssh_login", "success", 1, 2, 3), (_DISCONNECT, "ssh_disconnect", "ssh_disconnect", "closed", 1, 2, 3),
        (_PAM, "ssh_auth_fail", "pam_auth", "failed", 2, 1, 0), (_SUDO_FAIL, "sudo_auth_fail", "sudo_auth", "failed", 2, 1, 0), (_SUDO, "sudo_command", "sudo_exec", "success", 1, 0, 0),
    )

    head = head.withColumn("_s", _which(m, [s[0] for s in steps]))
    first = lambda value, other: _by(F.col("_s"), [value(s) for s in steps], other)
    none = F.lit(None).cast("string")
    take = lambda i: (lambda s: group(m, s[0], s[i]) if s[i] else none)
    k = F.col("_kind")
    bad = (k == "json") & F.col("_json").isNull()
    port = lambda *names: F.when(j(*names).rlike("^[0-9]{1,9}$"), j(*names).cast("int"))
    number = lambda *names: F.coalesce(F.when(j(*names).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), j(*names).cast("double")).cast("long"), F.lit(0))
    log = k == "log"
    what = {"pri": F.when(is_5424, group(v, _RFC5424, 1)), "procid": F.when(is_5424, group(v, _RFC5424, 5)), "msgid": F.when(is_5424, group(v, _RFC5424, 6)), "host": F.when(~is_5424, pick(2)), "pid": F.when(~is_5424, pick(4))}
    sudo = F.col("_s") == len(steps) - 1
    what |= {n: F.when(sudo, group(m, _SUDO, i)) for n, i in (("tty", 2), ("pwd", 3), ("target_user", 4), ("command", 5))}
    told = F.map_filter(F.create_map(*(x for n, c in what.items() for x in (F.lit(n), c))), lambda _, x: x.isNotNull())
    rest = F.map_filter(F.coalesce(F.col("_json"), F.create_map().cast("map<string,string>")), lambda key, _: ~key.isin(*JSON_OWN))
    seconds = F.coalesce(F.when(j("duration").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), j("duration").cast("double")), F.lit(0.0))
    known = ["ssh_auth_fail", "ssh_auth_success", "ssh_invalid_user", "ssh_disconnect", "sudo_auth_fail", "sudo_command", "network_flow", "generic_event", "malformed"]
    json_type = F.when(F.lower(j("event_type")).isin(known), F.lower(j("event_type"))).otherwise("network_flow")
    return head.select(
        *lines.columns,
        F.when(log, F.col("_at")).when(k == "json", parse_time(j("timestamp", "ts", "@timestamp"), default_year)).alias("timestamp"),
        F.when(k.isin("empty", "long") | bad, "malformed").when(k == "json", json_type).when(log, first(lambda s: F.lit(s[1]), F.lit("generic_event"))).otherwise("generic_event").alias("event_type"),
        F.when(k == "json", j("src_ip", "orig_h")).when(log, first(take(5), none)).alias("src_ip"),
        F.when(k == "json", j("dst_ip", "resp_h")).alias("dst_ip"),
        F.when(k == "json", port("src_port", "orig_p")).when(log, first(take(6), none).cast("int")).alias("src_port"),
        F.when(k == "json", port("dst_port", "resp_p")).alias("dst_port"),
        F.when(k == "json", j("user", "username")).when(log, first(take(4), none)).alias("user"),
        F.when(k == "json", j("action")).when(log, first(lambda s: F.lit(s[2]), F.col("_p"))).alias("action"),
        F.when(k == "empty", "empty").when(k == "long", "line_too_long").when(bad, "json_parse_error").when(k == "json", j("status")).when(log, first(lambda s: F.lit(s[3]), F.lit("info"))).otherwise("unstructured").alias("status"),
        F.when(k == "json", number("bytes_sent", "orig_bytes")).otherwise(0).alias("bytes_sent"),
        F.when(k == "json", number("bytes_recv", "resp_bytes")).otherwise(0).alias("bytes_recv"),
        F.when(k == "json", seconds).otherwise(0.0).alias("duration"),
        F.when(k == "json", rest).when(log, told).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        F.when(k == "json", F.lower(j("is_anomaly")) == "true").alias("is_anomaly"),
        F.when(k == "empty", "").when(k == "long", F.concat(F.substring("value", 1, 256), F.lit("... [TRUNCATED]"))).otherwise(F.col("value")).alias("raw_message"),
    )


def parse_auth(lines: DataFrame, default_year: int) -> DataFrame:
    """Timeline events of authentication logs; lines without a header are dropped."""
    v = F.substring(F.regexp_replace("value", "[\r\n]+$", ""), 1, MAX_LINE)
    head = lines.withColumn("_m", F.trim(F.coalesce(group(v, _AUTH, 6), F.lit("")))).where(v.rlike(_AUTH))
    m = F.col("_m")
    head = head.withColumn("_s", _which(m, [s[0] for s in AUTH_ACTIONS]))
    first = lambda value, other: _by(F.col("_s"), [value(s) for s in AUTH_ACTIONS], other)
    none = F.lit(None).cast("string")
    user = first(lambda s: F.coalesce(group(m, s[0], s[3]), group(m, s[0], 1) if s[1] == "PAM_SESSION_OPEN" else none), none)
    return head.select(
        *lines.columns, parse_time(group(v, _AUTH, 2), default_year).alias("timestamp"), F.lit("auth").alias("source_type"), F.lit("auth").alias("facility"),
        first(lambda s: F.lit(s[2]), F.lit("INFO")).alias("severity"), group(v, _AUTH, 3).alias("host"), group(v, _AUTH, 4).alias("process"), group(v, _AUTH, 5).cast("int").alias("pid"),
        user.alias("user"), first(lambda s: group(m, s[0], s[4]) if s[4] else none, none).alias("client_ip"), first(lambda s: F.lit(s[1]), F.lit("AUTH_EVENT")).alias("action"), m.alias("message"),
        truncate_raw(v).alias("raw_log"), _auth_metadata(m, first, none).alias("metadata"),
    )


def parse_syslog(lines: DataFrame, default_year: int | Column) -> DataFrame:
    """RFC 5424, then RFC 3164 with or without a tag; other lines are dropped."""
    v, new = F.col("value"), F.col("_new")
    pick = lambda a, b: F.when(new, group(v, _SYSLOG5424, a)).otherwise(group(v, _SYSLOG3164, b))
    dash = lambda c: F.nullif(c, F.lit("-"))
    head = lines.withColumn("_new", F.when(v.rlike(_SYSLOG5424), True).when(v.rlike(_SYSLOG3164), False)).where("_new is not null")
    # groups are taken here, once each; what follows uses them more than once
    head = head.withColumns({"_pri": pick(1, 1).cast("int"), "_time": pick(3, 2), "_pid": dash(pick(6, 5)), "_sd": F.when(new, group(v, _SYSLOG5424, 8)), "_host": dash(pick(4, 3)), "_process": dash(pick(5, 4)), "_text": pick(9, 6)})
    pri, pid = F.col("_pri"), F.col("_pid")
    return head.select(
        *lines.columns, parse_time(F.col("_time"), default_year).alias("timestamp"), F.lit("syslog").alias("source_type"), F.when(pri.isNotNull(), facility_of(pri)).alias("facility"),
        F.coalesce(severity_of(pri), F.lit("INFO")).alias("severity"), F.col("_host").alias("host"), F.col("_process").alias("process"), F.when(pid.rlike("^[0-9]{1,9}$"), pid.cast("int")).alias("pid"),
        F.trim(F.coalesce("_text", F.lit(""))).alias("message"), F.when(new, structured_data(F.col("_sd"))).alias("structured"),
    ).where("timestamp is not null")


def structured_data(text: Column) -> Column:
    """RFC 5424 structured data as a map of maps; of a repeated id or name the last counts."""
    last = lambda pairs: F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["col1"] == p["col1"])))
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\s=\]]+(?:\s+[^\]]+)?\]"), F.lit(0))

    def one(b: Column) -> Column:
        pairs = F.regexp_extract_all(b, F.lit(r'[^\s=\[]+="[^"]*"'), F.lit(0))
        params = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'^([^=]+)="', 1), F.regexp_extract(p, r'="([^"]*)"$', 1)))
        return F.struct(F.regexp_extract(b, r"^\[([^\s=\]]+)", 1), last(params))

    return last(F.transform(blocks, one))


def parse_nginx(lines: DataFrame, default_year: int) -> DataFrame:
    """Access lines, then error lines; others are dropped."""
    v = F.col("value")
    access, error = v.rlike(_ACCESS), v.rlike(_ERROR)
    request = F.split(F.coalesce(group(v, _ACCESS, 5), F.lit("")), " ")
    method, url, status = F.coalesce(F.nullif(F.get(request, F.lit(0)), F.lit("")), F.lit("UNKNOWN")), F.coalesce(F.get(request, F.lit(1)), F.lit("")), group(v, _ACCESS, 6)
    level = group(v, _ERROR, 2)
    no = lambda c: F.nullif(c, F.lit("-"))
    return lines.where(access | error).select(
        *lines.columns, parse_time(F.when(access, group(v, _ACCESS, 4)).otherwise(group(v, _ERROR, 1)), default_year).alias("timestamp"), F.lit("nginx").alias("source_type"),
        F.when(access, F.when(status >= "500", "ERROR").when(status >= "400", "WARNING").otherwise("INFO")).otherwise(normalize_severity(level)).alias("severity"),
        F.when(error & ~access, F.coalesce(group(v, _ERROR, 10), group(v, _ERROR, 8))).alias("host"), F.when(~access, group(v, _ERROR, 3).cast("int")).alias("pid"),
        F.when(access, no(group(v, _ACCESS, 3))).alias("user"), F.when(access, group(v, _ACCESS, 1)).otherwise(group(v, _ERROR, 7)).alias("client_ip"),
        F.when(access, F.concat(F.lit("HTTP_"), method, F.lit("_"), status)).otherwise(F.concat(F.lit("NGINX_ERROR_"), F.upper(level))).alias("action"),
        F.when(access, F.concat(method, F.lit(" "), url, F.lit(" HTTP status "), status)).otherwise(group(v, _ERROR, 6)).alias("message"),
        F.when(access, status.cast("int")).alias("status_code"), F.when(access, F.coalesce(no(group(v, _ACCESS, 7)).cast("long"), F.lit(0))).alias("bytes_sent"),
        no(group(v, _ACCESS, 8)).alias("referer"), no(group(v, _ACCESS, 9)).alias("user_agent"),
    )


def parse_jsonl(lines: DataFrame, default_year: int) -> DataFrame:
    """JSON objects by alias lists; comments, blanks, bad JSON and lines without a time are dropped."""
    v = F.trim("value")
    head = lines.where((F.length("value") <= MAX_JSON) & v.startswith("{")).withColumn("_j", F.from_json(v, "map<string,string>"))
    own = lambda f: F.coalesce(*(F.try_element_at("_j", F.lit(k)) for k in JSON_KEYS[f]))
    used = [k for keys in JSON_KEYS.values() for k in keys]
    return head.where("_j is not null").select(
        *lines.columns, parse_time(own("timestamp"), default_year).alias("timestamp"), F.lit("jsonl").alias("source_type"), normalize_severity(own("severity")).alias("severity"),
        own("host").alias("host"), own("process").alias("process"), F.when(own("pid").rlike("^[0-9]{1,9}$"), own("pid").cast("int")).alias("pid"), own("user").alias("user"),
        own("client_ip").alias("client_ip"), own("action").alias("action"), F.coalesce(own("message"), F.lit("")).alias("message"), F.map_filter("_j", lambda k, x: ~k.isin(used)).alias("metadata"),
    ).where("timestamp is not null")


def _file_parser(kind: str):
    def read(spark: SparkSession, path: str, default_year: int) -> DataFrame:
        return read_events(spark, path, default_year, kind)

    read.__doc__ = f"Events of a file of {kind} lines."
    return read


PARSERS = {"auth": parse_auth, "syslog": parse_syslog, "nginx": parse_nginx, "jsonl": parse_jsonl}
parse_auth_file, parse_syslog_file, parse_nginx_file, parse_jsonl_file = map(_file_parser, PARSERS)
__all__ = ["PARSERS", "detect_format", "epoch_us", "parse_auth_file", "parse_jsonl_file", "parse_nginx_file", "parse_syslog_file", "read_events", "parse_auth", "parse_jsonl", "parse_nginx", "parse_security", "parse_syslog", "read_lines"]
