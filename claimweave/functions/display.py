"""Dates as people read them, and who sent a request, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers that tell a client's address, in order; of the first, a list, the first entry counts (fixed values).
ADDRESS_HEADERS = ("x-forwarded-for", "cf-connecting-ip", "x-real-ip", "x-vercel-forwarded-for")


def client_address(headers: Column) -> Column:
    """Address of a client by a map of headers with lower-case names; ``unknown`` where none tells it."""
    listed, *plain = (F.try_element_at(headers, F.lit(name)) for name in ADDRESS_HEADERS)
    first = F.trim(F.get(F.split(listed, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), *[F.nullif(h, F.lit("")) for h in plain], F.lit("unknown"))


def limit_key(scope: Column, who: Column) -> Column:
    return F.concat_ws(":", scope, who)


def format_date(at: Column) -> Column:
    """Like ``Jan 5, 2025``; a null is an unknown date."""
    return F.coalesce(F.date_format(at, "MMM d, y"), F.lit("unknown date"))


def format_date_time(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, y, hh:mm a"), F.lit("unknown date"))


def format_relative(at: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days, each rounded from the one before; from 30 days on the date."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 60_000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "min")).when(hours < 24, ago(hours, "h")).when(days < 30, ago(days, "d")).otherwise(format_date(at))


def make_id(prefix: Column) -> Column:
    """A new id; every evaluation gives another, so it belongs into a table that is written once."""
    return F.concat(prefix, F.lit("_"), F.regexp_replace(F.uuid(), "-", ""))


#: Plans: runs a day and most queries of a run (fixed values).
PLANS = {"FREE": (10, 5), "PRO": (150, 8), "TECHNICIAN": (600, 10)}


def plan_of(name: Column) -> Column:
    """Struct (plan, daily_runs, max_queries) of a plan's name; unknown ones and null have the first one's."""
    struct = lambda n: F.struct(F.lit(n).alias("plan"), F.lit(PLANS[n][0]).alias("daily_runs"), F.lit(PLANS[n][1]).alias("max_queries"))
    out = struct("FREE")
    for plan in PLANS:
        out = F.when(name == plan, struct(plan)).otherwise(out)
    return out
