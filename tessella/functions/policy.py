"""Decision rules as expressions: member states, retries, paths, validation, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUSPECT_AFTER, DEAD_AFTER = 30, 60
RETRYABLE = (429, 500, 502, 503, 504)
RID_PATTERN = "^[A-Za-z0-9-]{1,128}$"


def state_rank(state: Column) -> Column:
    return F.when(state == "Alive", 0).when(state == "Suspect", 1).otherwise(2)


def sweep_state(last_seen: Column, now: Column, is_self: Column) -> Column:
    age = F.greatest(F.lit(0), now - last_seen)
    return F.when(is_self, "Alive").when(age > DEAD_AFTER, "Dead").when(age > SUSPECT_AFTER, "Suspect").otherwise("Alive")


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def backoff_ms(attempt: Column) -> Column:
    """The delay before jitter; jitter moves it by up to a quarter either way."""
    return F.least(F.lit(30000), F.lit(500) * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(10)))).cast("bigint")


def retry_delay_ms(attempt: Column, retry_after_s: Column) -> Column:
    return F.when(retry_after_s.isNotNull(), F.least(retry_after_s * 1000, F.lit(60000))).otherwise(backoff_ms(attempt)).cast("bigint")


def real_path(prefix: Column, path: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", "")
    return F.when(bare == "", path).otherwise(F.concat(bare, F.lit("/"), path))


def combine_prefix(mount_prefix: Column, path: Column) -> Column:
    """A mount's prefix and a path under it, one slash between unless the path brings more; if either is empty, the other as it is."""
    bare = F.regexp_replace(mount_prefix, "/+$", "")
    return F.when(mount_prefix == "", path).when(path == "", mount_prefix).otherwise(F.concat(bare, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))))


def strip_prefix(name: Column, prefix: Column) -> Column:
    """The name without its prefix and the slashes after it, if it starts so (as text, not by path segment)."""
    return F.when((prefix != "") & F.startswith(name, prefix), F.regexp_replace(F.substr(name, F.length(prefix) + 1), "^/+", "")).otherwise(name)


def host_of(url: Column) -> Column:
    return F.split_part(F.regexp_replace(url, "^http://", ""), F.lit(":"), F.lit(1))


def append_sas(url: Column, sas: Column) -> Column:
    bare = F.regexp_replace(sas, "^[?]", "")
    return F.when(bare == "", url).when(F.contains(url, F.lit("?")), F.concat(url, F.lit("&"), bare)).otherwise(F.concat(url, F.lit("?"), bare))


def request_id_ok(rid: Column) -> Column:
    return F.coalesce(F.trim(rid).rlike(RID_PATTERN), F.lit(False))


def format_latency(seconds: Column) -> Column:
    """Microseconds below 1 ms, milliseconds with one decimal below 1 s, else seconds with two."""
    return (
        F.when(seconds.isNull(), F.lit("n/a"))
        .when(seconds == float("inf"), F.lit("+Inf"))
        .when(seconds < 1e-3, F.format_string("%.0fus", seconds * F.lit(1e6)))
        .when(seconds < 1, F.format_string("%.1fms", seconds * F.lit(1e3)))
        .otherwise(F.format_string("%.2fs", seconds))
    )


def elapsed_seconds(text: Column) -> Column:
    """MM:SS or H:MM:SS."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share in percent; ties go to the even digit."""
    return F.bround(F.lit(100.0) * part / whole, digits)


def mib_per_s(nbytes: Column, ms: Column) -> Column:
    return F.when(ms > 0, nbytes / F.lit(1048576.0) / (ms / F.lit(1000.0))).otherwise(F.lit(0.0))


def hydrate_mode(env: Column, requested: Column) -> Column:
    low = F.lower(F.trim(env))
    return F.when(low.isin("broadcast", "ring"), low).otherwise(F.coalesce(requested, F.lit("broadcast")))
