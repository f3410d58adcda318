"""Column functions over one log line or one line reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sizing contract.
DEFAULT_CHARS_PER_TOKEN = 1.4
DEFAULT_SLICE_TOKEN_BUDGET = 10_000
REF_OVERHEAD_TOKENS = 12
MIN_LINES_PER_SLICE = 10
MAX_HEADER_LINES = 12
MIN_PACKING_BUDGET = 500
NO_TIMESTAMPS = "unknown (no timestamps recognised)"

# Fixed patterns: ISO, syslog, epoch at line start; the ref grammar; domains and IPv4 addresses.
ISO_TS = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b"
SYSLOG_TS = r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"
EPOCH_TS = r"^\d{10}\.\d{3,6}\b"
LINE_REF = r"^[\w.\-/]+:L\d+$"
DOMAIN = r"\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|local)\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

UNICODE = "(?U)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, 0), F.lit(""))


def line_ref(file: Column, line_no: Column) -> Column:
    return F.concat(file, F.lit(":L"), line_no.cast("string"))


def first_timestamp(text: Column) -> Column:
    """First ISO stamp of the line, else syslog, else epoch at line start; null when none."""
    return F.coalesce(_first(text, ISO_TS), _first(text, SYSLOG_TS), _first(text, EPOCH_TS))


def utc_instant(text: Column) -> Column:
    """Instant of an ISO text; without a zone it is UTC, whatever the session's zone is."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def typed_timestamp(raw: Column) -> Column:
    """Instant of a raw stamp, read as UTC. Syslog stamps carry no year and give null."""
    iso = utc_instant(F.regexp_replace(raw, " ", "T"))
    epoch = F.timestamp_micros((raw.try_cast("decimal(20,6)") * F.lit(1_000_000)).cast("bigint"))
    return F.when(raw.rlike(r"^\d{4}-"), iso).when(raw.rlike(EPOCH_TS), epoch)


def token_cost(length: Column, chars_per_token: float = DEFAULT_CHARS_PER_TOKEN) -> Column:
    return length / F.lit(float(chars_per_token)) + F.lit(float(REF_OVERHEAD_TOKENS))


def is_header_line(text: Column) -> Column:
    return F.startswith(text, F.lit("#"))


def is_well_formed_ref(ref: Column) -> Column:
    return ref.rlike(UNICODE + LINE_REF)


def ref_file(ref: Column) -> Column:
    return F.regexp_extract(ref, r"(?s)^(.*):L[1-9][0-9]*$", 1)


def ref_line(ref: Column) -> Column:
    """Line number of a canonical ref (no leading zero); null otherwise."""
    return F.regexp_extract(ref, r":L([1-9][0-9]{0,17})$", 1).try_cast("bigint")


def ref_within(ref: Column, file: Column, start: Column, end: Column) -> Column:
    """True when the ref names one of the lines start..end of file.

    Lines of a slice are consecutive by construction, so the interval test equals a lookup in the set of its refs
    and needs no join to the lines themselves.
    """
    line = ref_line(ref)
    inside = (ref_file(ref) == file) & (line >= start) & (line <= end)
    return F.coalesce(inside, F.lit(False))


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"(?s)^(.+)\.[^.]*$", "$1")


def python_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def text_indicators(text: Column, per_kind: int | None = 4) -> Column:
    """Distinct domains, then distinct IPv4 addresses, each in order of appearance and at most `per_kind` (None: all)."""

    def found(pattern: str) -> Column:
        named = F.array_distinct(F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(0)))
        return named if per_kind is None else F.slice(named, 1, per_kind)

    return F.concat(found(DOMAIN), found(IPV4))
