"""Scalar normalisers for log fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by syslog number, and their aliases.
SEVERITIES = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG")
ALIASES = {
    "EMERG": "EMERGENCY", "EMERGENCY": "EMERGENCY", "PANIC": "EMERGENCY", "ALERT": "ALERT", "CRIT": "CRITICAL", "CRITICAL": "CRITICAL", "FATAL": "CRITICAL",
    "ERR": "ERROR", "ERROR": "ERROR", "WARN": "WARNING", "WARNING": "WARNING", "NOTE": "NOTICE", "NOTICE": "NOTICE", "INFO": "INFO", "INFORMATIONAL": "INFO",
    "DEBUG": "DEBUG", "TRACE": "DEBUG", "AUTH": "NOTICE", "AUTHPRIV": "NOTICE",
}
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "security", "console", "solaris-cron", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

#: 0 is the most severe.
SEVERITY_RANK = {name: i for i, name in enumerate(SEVERITIES)}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def normalize_severity(value: Column) -> Column:
    """Null or a number out of range: INFO; a number: its name; an alias: its name; else upper-cased."""
    clean = F.upper(F.trim(value.cast("string")))
    number = F.when(clean.rlike("^[0-9]{1,6}$"), clean.cast("int"))
    named = F.get(F.array(*map(F.lit, SEVERITIES)), number)
    return F.when(value.isNull() | (clean == ""), "INFO").when(number.isNotNull(), F.coalesce(named, F.lit("INFO"))).otherwise(F.coalesce(F.try_element_at(_map(ALIASES), clean), clean))


def rank_of(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv)), severity), F.lit(SEVERITY_RANK["INFO"]))


def facility_of(pri: Column) -> Column:
    """The facility's name of a syslog PRI."""
    code = F.shiftright(pri, 3)
    return F.coalesce(F.get(F.array(*map(F.lit, FACILITIES)), code), F.concat(F.lit("facility_"), code.cast("string")))


def severity_of(pri: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), pri.bitwiseAND(7))


def epoch_us(value: Column) -> Column:
    """µs since 1970 of a number in seconds, milli-, micro- or nanoseconds, told by its size."""
    size = F.abs(value)
    scaled = F.when(size >= 1e17, value / 1e3).when(size >= 1e14, value).when(size >= 1e11, value * 1e3).otherwise(value * 1e6)
    return F.round(scaled).cast("long")


def parse_time(text: Column, default_year: int | Column) -> Column:
    """Epoch numbers, BSD (which take the default year), ISO 8601, and nginx access or error times; null if none fits.

    The text is bound once, in an array of one, so that what it is taken from isn't worked out for every format.
    """
    year = F.lit(default_year).cast("string") if isinstance(default_year, int) else default_year.cast("string")

    def tried(one: Column) -> Column:
        tries = [F.try_to_timestamp(F.concat(year, F.lit(" "), one), F.lit(f)) for f in ("yyyy MMM d HH:mm:ss", "yyyy MMM d HH:mm:ss.SSSSSS")]
        tries += [F.try_to_timestamp(one, F.lit(f)) for f in ("dd/MMM/yyyy:HH:mm:ss Z", "yyyy/MM/dd HH:mm:ss")]
        number = F.when(one.rlike("^-?[0-9]+(\\.[0-9]+)?$"), F.timestamp_micros(epoch_us(one.cast("double"))))
        return F.when(one == "", F.lit(None).cast("timestamp")).otherwise(F.coalesce(number, *tries, F.try_to_timestamp(one)))

    short = F.transform(F.array(text), lambda t: F.when(F.length(t) <= 256, F.regexp_replace(F.trim(t), "\\s+", " ")))
    return F.get(F.transform(short, tried), F.lit(0))


def iso_text(us: Column) -> Column:
    """2026-03-04T09:10:11+00:00, with six decimals where there are any."""
    at = F.timestamp_micros(us)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(us, F.lit(1_000_000)) != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def event_id(source_file: Column, line_number: Column, us: Column, raw: Column) -> Column:
    """First 16 hex digits of the SHA-256 of file:line:time:raw[:256]."""
    text = F.concat_ws(":", source_file, line_number.cast("string"), iso_text(us), F.substring(raw, 1, 256))
    return F.substring(F.sha2(text, 256), 1, 16)


def truncate_raw(raw: Column) -> Column:
    return F.when(F.length(raw) > 4096, F.concat(F.substring(raw, 1, 4093), F.lit("..."))).otherwise(raw)


def xml_escape(text: Column) -> Column:
    """Escapes & < > quotes; drops control characters but tab, newline and return."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


# What stands for hidden parts of messages shown to users.
_PATH, _PROMPT = r"/(?:[a-zA-Z0-9_.-]+/)+[a-zA-Z0-9_.-]+", r"(?s)<<<INPUT_USUARIO.*?INPUT_USUARIO>>>"
PATH_MARK, PROMPT_MARK, NO_NAME = "[RUTA]", "[TEXTO_DELIMITADO]", "Anónimo"


def hide_paths(message: Column) -> Column:
    """Absolute paths, then delimited prompt blocks, give way to marks; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), _PATH, PATH_MARK), _PROMPT, PROMPT_MARK)


def mask_name(name: Column) -> Column:
    """The first two characters and three stars; null and empty names have a name of their own."""
    return F.when(F.coalesce(name, F.lit("")) == "", NO_NAME).otherwise(F.concat(F.substring(name, 1, 2), F.lit("***")))


# The patterns of secrets and their marks.
def sanitize(text: Column) -> Column:
    """Private keys, bearer tokens, API keys and secret assignments give way to marks, in that order."""
    out = F.regexp_replace(text, r"(?s)-----BEGIN\s+(?:[A-Z\s]+)?PRIVATE\s+KEY-----.*?-----END\s+(?:[A-Z\s]+)?PRIVATE\s+KEY-----", "[REDACTED_PRIVATE_KEY]")
    out = F.regexp_replace(out, r"(?i)\bBearer\s+[A-Za-z0-9_\-.]{16,}", "Bearer [REDACTED]")
    out = F.regexp_replace(out, r"\b(?:sk_[a-zA-Z0-9_\-]{16,}|gh[a-zA-Z0-9]_[a-zA-Z0-9]{20,}|AKIA[0-9A-Z]{16})\b", "[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\b(password|passwd|pwd|pass|secret|token|api[_-]?key|auth_token)\s*[:=]\s*([^\s;,\"'&]+)", "$1=[REDACTED]")
    return F.coalesce(out, F.lit(""))


# Keys whose values are secrets, whatever they are.
SECRET_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "auth_token", "private_key")


def sanitize_map(pairs: Column) -> Column:
    """A map of texts: values of secret keys (whatever their case) give way, other values are sanitized; null values stay."""
    return F.transform_values(pairs, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "[REDACTED]").when(v.isNotNull(), sanitize(v)))


def sanitize_json(text: Column, schema: str) -> Column:
    """A JSON object of a known shape, with secrets replaced at any depth.

    Values of secret keys give way unless they are objects or lists, which are gone through as others
    are; numbers and truths of other keys stay. Text that isn't an object of that shape gives null.
    """
    from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

    def clean(value: Column, kind: DataType, secret: bool) -> Column:
        if isinstance(kind, StructType):
            return F.when(value.isNotNull(), F.struct(*(clean(value[f.name], f.dataType, f.name.lower() in SECRET_KEYS).alias(f.name) for f in kind.fields)))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType, False))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda k, x: F.when(F.lower(k).isin(*SECRET_KEYS) & x.isNotNull(), "[REDACTED]").otherwise(clean(x, kind.valueType, False)) if isinstance(kind.valueType, StringType) else clean(x, kind.valueType, False))
        if secret:
            return F.when(value.isNotNull(), "[REDACTED]")
        return F.when(value.isNotNull(), sanitize(value)) if isinstance(kind, StringType) else value

    kind = StructType.fromDDL(schema)
    return F.to_json(clean(F.from_json(text, kind), kind, False))
