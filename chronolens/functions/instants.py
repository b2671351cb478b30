"""Text to UTC microseconds, as one Spark expression.

A value is taken apart by the first form that matches its trimmed, upper-cased
text. Forms and their clocks:

=========================================  ===============================
``yyyy-MM-dd[T ]HH:mm:ss[.f]`` + zone      the written offset
``yyyy-MM-dd HH:mm:ss[.f]``                UTC
``yyyy-MM-ddTHH:mm:ss[.f]``                the device's wall clock
``dd.MM.yyyy HH:mm:ss``                    the device's wall clock
``MM/dd/yyyy hh:mm:ss AM``                 the device's wall clock
``Mon, dd MMM yyyy HH:mm:ss`` + zone       the written offset
``yyyyMMdd_HHmmss_ffffff``                 UTC
9-11 / 12-14 / 15-17 digits                seconds / milli / microseconds
=========================================  ===============================

An offset outweighs a bracketed region name; a region alone is a clock of its
own. Where an hour repeats, the first pass is meant; a wall-clock time inside
a spring gap moves on by the gap. Everything else, impossible dates included,
is null. Digits past microseconds are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The one form that needs no rewriting, and the accepted forms.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"
DOTS = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\s+(\d{1,2}:)"
SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}:)"
MAIL = r"^(?:[A-Z]{3},\s*)?(\d{1,2})\s+([A-Z]{3})\s+(\d{4})\s+(\d{1,2}:)"
COMPACT = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})_(\d{1,9})$"
WHOLE = r"^(\d{4})-(\d{1,2}|[A-Z]{3})-(\d{1,2})(T|\s)(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?\s*(AM|PM)?\s*(Z|UTC|GMT|UT|[+-]\d{2}:?\d{2})?(\[[^\]]+\])?$"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that the JVM can resolve; any other name counts as no zone."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tidy(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"^[\s ]+|[\s ]+$", ""))


def _iso(u: Column) -> Column:
    """Every dated form rewritten with year, month and day in front; ``T`` marks a wall clock."""
    out = F.regexp_replace(u, DOTS, "$3-$2-$1T$4")
    out = F.regexp_replace(out, SLASHES, "$3-$1-$2T$4")
    out = F.regexp_replace(out, MAIL, "$3-$2-$1T$4")
    return F.regexp_replace(out, COMPACT, "$1-$2-$3 $4:$5:$6.$7")


def _fields(u: Column) -> Column:
    """year, month, day, separator, hour, minute, second, fraction, half, offset, region."""
    return F.split(F.regexp_replace(_iso(u), WHOLE, "$1;$2;$3;$4;$5;$6;$7;$8;$9;$10;$11"), ";")


def utc_micros(raw: Column, device_zone: Column, zones: list[str]) -> Column:
    """Microseconds since 1970-01-01 UTC that ``raw`` names, or null."""

    def dated(f: Column) -> Column:
        year, month, day, mark, hour, minute, second, fraction, half, offset, region = (F.get(f, F.lit(i)) for i in range(11))
        two = lambda c: F.lpad(c, 2, "0")
        at = F.position(month, F.lit(MONTHS))
        number = F.when(month.rlike("^[A-Z]"), F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))).otherwise(month)
        clock = hour.try_cast("int")
        hour24 = F.when(half == "", hour).when(clock.between(1, 12), (clock % 12 + F.when(half == "PM", 12).otherwise(0)).cast("string"))
        wall = F.concat(year, F.lit("-"), two(number), F.lit("-"), two(day), F.lit(" "), two(hour24), F.lit(":"), minute, F.lit(":"), second, F.lit("+00:00"))
        micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long")
        minutes = F.substring(offset, 2, 2).try_cast("long") * 60 + F.substring(offset, -2, 2).try_cast("long")
        shift = F.when(offset.startswith("+"), minutes).when(offset.startswith("-"), -minutes).otherwise(F.lit(0).cast("long"))
        named = F.regexp_extract(raw, r"\[([^\]]+)\]\s*$", 1)
        zone = F.when(region != "", named).otherwise(device_zone)

        def moved(instant: Column) -> Column:
            # the wall clock was read as if it were UTC; the session's own zone plays no part
            return (
                F.when(offset != "", F.unix_micros(instant) - shift * 60_000_000)
                .when((mark != "T") & (region == ""), F.unix_micros(instant))
                .otherwise(F.unix_micros(F.to_utc_timestamp(instant, F.when(F.find_in_set(zone, F.lit(",".join(zones))) > 0, zone))))
            )

        return F.when(F.size(f) == 11, let(wall.try_cast("timestamp"), moved) + micros)

    def parsed(u: Column) -> Column:
        count = u.try_cast("long")
        return (
            F.when(u.rlike(r"^\d{9,11}$"), count * 1_000_000)
            .when(u.rlike(r"^\d{12,14}$"), count * 1_000)
            .when(u.rlike(r"^\d{15,17}$"), count)
            .otherwise(let(_fields(u), dated))
        )

    return let(tidy(raw), parsed)
