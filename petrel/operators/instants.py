"""Date texts in many forms and zones, each as one instant in UTC.

A text is split into a zone part (offset, region, abbreviation, none) and a local time.
Texts with an offset or ``Z`` are arithmetic. Local times are joined as-of to the intervals
during which a region kept one offset, exploded per region and local year: two matching
intervals mean an ambiguous time (the earlier instant is taken), none means a skipped one
(moved forward by the gap, that is, read with the offset of the interval before it), one
gives the offset. An abbreviation is that of the interval which carries it at that time, or of
the nearest one.

Scale: everything but the interval table is column expressions on the rows that are not
already in canonical form; the interval table has one row per tz-database region and year that
the data names, so it is bounded by the tz database and by the years a date can have; it is
broadcast and no row of data is shuffled.

Defined cases: null, blank or unreadable texts, impossible dates (13th month, 30 February)
and times (hour 24, second 60) and local times without a known region give NULL; the years 1 and
9999 are read with the offsets of the years next to them. Repeated rows each give a row.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: Years whose intervals are built beside those in the data, so that abbreviations of other years are known.
HISTORY = range(1900, 2038)
FIRST_YEAR, LAST_YEAR = 2, 9998
DAY_MS = 86_400_000
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _offset(zone: ZoneInfo, second: int) -> tuple[int, str]:
    local = (_EPOCH + timedelta(seconds=second)).astimezone(zone)
    return int(local.utcoffset().total_seconds()), local.tzname()


def _probed(zone: ZoneInfo, begin: int, end: int) -> list[tuple[int, int, int, str]]:
    step = 7 * 86_400
    out, start, now = [], begin, _offset(zone, begin)
    for at in range(begin + step, end + step, step):
        while (then := _offset(zone, at)) != now:
            low, high = max(start, at - step), at
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _offset(zone, mid) == now else (low, mid)
            out.append((start, high, *now))
            start, now = high, _offset(zone, high)
            if now == then:
                break
    return [*out, (start, end, *now)]


@cache
def zone_intervals(name: str, years: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """(first second UTC, end, offset in seconds, abbreviation) of each stretch with one offset, over these years and the ones next to them."""
    zone, out = ZoneInfo(name), []
    second = lambda y: int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    wanted = sorted({min(max(y + k, FIRST_YEAR), LAST_YEAR) for y in years for k in (-1, 0, 1)})
    runs: list[list[int]] = []
    for y in wanted:
        if runs and y == runs[-1][1] + 1:
            runs[-1][1] = y
        else:
            runs.append([y, y])
    for first, last in runs:
        out += _probed(zone, second(first), second(last + 1))
    return tuple(out)


@cache
def _zone_rows(names: tuple[str, ...], years: tuple[int, ...]) -> tuple[list[tuple], list[tuple]]:
    """Rows (zone, year, [(start, end, offset)]) and (zone, abbreviation, [(start, end, offset)]), all in ms, start and end in local time."""
    by_year: dict[tuple[str, int], list] = {}
    short: dict[tuple[str, str], list] = {}
    margin = 2 * DAY_MS
    bounds = {y: tuple(int((datetime(x, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds() * 1000) for x in (y, y + 1)) for y in years}
    for name in names:
        for a, b, offset, abbreviation in zone_intervals(name, tuple(sorted({*years, *HISTORY}))):
            piece = ((a + offset) * 1000, (b + offset) * 1000, offset * 1000)
            short.setdefault((name, abbreviation.upper()), []).append(piece)
            first, last = (_EPOCH.year + int(x // (365.2425 * DAY_MS)) for x in piece[:2])
            for y in range(first - 1, last + 2):
                if y in bounds and piece[0] < bounds[y][1] + margin and piece[1] > bounds[y][0] - margin:
                    by_year.setdefault((name, y), []).append(piece)
    return [(z, y, p) for (z, y), p in by_year.items()], [(z, k, p) for (z, k), p in short.items()]


def regions_used(texts: DataFrame, text: str, more: DataFrame) -> list[str]:
    """The tz-database regions named in a column, and those of the one column of ``more``; at most as many as the database has."""
    spark = texts.sparkSession
    known = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "region string")
    named = texts.where(F.col(text).rlike(r"[\[\s][A-Za-z]")).select(region_of(trimmed(F.col(text))).alias("region")).distinct()
    found = named.unionByName(more.toDF("region").distinct()).join(F.broadcast(known), "region", "left_semi").distinct()
    return sorted(r[0] for r in found.collect())


def years_used(texts: DataFrame, text: str) -> list[int]:
    """The four-digit years at the beginning or end of the dates in a column; at most 10,000 by their form."""
    t = trimmed(F.col(text))
    year = F.coalesce(_group(t, r"^(\d{4})", 1), _group(t, r"[./\s-](\d{4})(?:[\sTt,]|$)", 1)).cast("int")
    later = _group(t, r"[./\s-](\d{4})(?:[\sTt,]|$)", 1).cast("int")
    found = texts.select(F.explode(F.array(year, later)).alias("y")).where("y is not null").distinct().collect()
    return sorted({min(max(r[0], FIRST_YEAR), LAST_YEAR) for r in found})


def zone_tables(spark: SparkSession, zones: list[str] | None = None, years: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The interval table and the abbreviation table of these regions and years (default: the whole tz database, 1900 to 2037)."""
    names = tuple(sorted(available_timezones() if zones is None else zones))
    rows, short = _zone_rows(names, tuple(sorted(set(HISTORY if years is None else years))))
    piece = "array<struct<start:bigint,end:bigint,offset:bigint>>"
    return spark.createDataFrame(rows, f"zone string, year int, intervals {piece}"), spark.createDataFrame(short, f"zone string, abbreviation string, carried {piece}")


def _group(text: Column, pattern: str, n: int) -> Column:
    got = F.regexp_extract(text, pattern, n)
    return F.when(got != "", got)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def region_of(trimmed_text: Column) -> Column:
    """Region name at the end of a date text, in brackets or after a blank."""
    return F.coalesce(_group(trimmed_text, r"\[([A-Za-z][A-Za-z0-9_+\-/]*)\]$", 1), _group(trimmed_text, r"\s([A-Za-z_]+/[A-Za-z0-9_+\-/]+)$", 1))


def split_zone(text: Column) -> Column:
    """Struct(local, offset_ms, region, abbreviation) of a date text: zone part taken off its end."""
    t = trimmed(text)
    region = region_of(t)
    offset = r"(?<=\d)\s?([+-])(\d{2}):?(\d{2})?$"
    sign, hh, mm = (F.regexp_extract(t, offset, n) for n in (1, 2, 3))
    # an offset needs a time before it, so that the day of 2022-01-15 is none
    has_offset = t.rlike(r"(?:\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{14}(?:\d{3})?|\d{12})\s?[+-]\d{2}(?::?\d{2})?$")
    minutes = F.try_to_number(hh, F.lit("99")).cast("int") * 60 + F.coalesce(F.try_to_number(F.when(mm != "", mm), F.lit("99")).cast("int"), F.lit(0))
    offset_ms = F.when(minutes <= 18 * 60, F.when(sign == "-", -minutes).otherwise(minutes).cast("bigint") * 60_000)
    abbreviation = F.upper(_group(t, r"(?<=\d|\d\s|[AaPp][Mm]\s)(?<!\d\s?[Tt])([A-Za-z]{1,5})$", 1))
    abbreviation = F.when(~abbreviation.isin("AM", "PM"), abbreviation)
    return (
        F.when(region.isNotNull(), F.struct(F.regexp_replace(t, r"\s?\[[^\]]*\]$|\s[A-Za-z_]+/\S+$", "").alias("local"), F.lit(None).cast("bigint").alias("offset_ms"), region.alias("region"), F.lit(None).cast("string").alias("abbreviation")))
        .when(has_offset, F.struct(F.regexp_replace(t, r"\s?[+-]\d{2}(?::?\d{2})?$", "").alias("local"), F.coalesce(offset_ms, F.lit(-1).cast("bigint") * 10**15).alias("offset_ms"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("abbreviation")))
        .when(abbreviation.isNotNull(), F.struct(F.regexp_replace(t, r"\s?[A-Za-z]{1,5}$", "").alias("local"), F.when(abbreviation.isin("Z", "UTC", "GMT", "UT"), F.lit(0).cast("bigint")).alias("offset_ms"), F.lit(None).cast("string").alias("region"), abbreviation.alias("abbreviation")))
        .otherwise(F.struct(t.alias("local"), F.lit(None).cast("bigint").alias("offset_ms"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("abbreviation")))
    )


CLOCK = r"(?:[T t]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s?([AaPp][Mm]))?)?$"
#: Local forms: pattern and the groups of year, month, day; the clock's groups follow at the last number.
FORMS = {
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})" + CLOCK, (1, 2, 3), 4),
    "dots": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})" + CLOCK, (3, 2, 1), 4),
    "slash_ymd": (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + CLOCK, (1, 2, 3), 4),
    "slash_dmy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + CLOCK, (3, 2, 1), 4),
    "slash_mdy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + CLOCK, (3, 1, 2), 4),
    "named": (r"^(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})[\s-]([A-Za-z]{3,9})\.?[\s-](\d{4})" + CLOCK, (3, 2, 1), 4),
    "digits": (r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(?:(\d{2})(\d{3})?)?)?$", (1, 2, 3), 4),
}


def _fields(form: str, local: Column) -> Column:
    pattern, (y, m, d), c = FORMS[form]
    get = lambda n: _group(local, pattern, n)
    month = get(m)
    if form == "named":
        month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(month, 1, 3))).cast("string")
    return F.struct(
        get(y).cast("int").alias("y"), month.cast("int").alias("m"), get(d).cast("int").alias("d"),
        F.coalesce(get(c), F.lit("0")).cast("int").alias("h"), F.coalesce(get(c + 1), F.lit("0")).cast("int").alias("mi"), F.coalesce(get(c + 2), F.lit("0")).cast("int").alias("s"),
        F.substring(F.rpad(F.coalesce(get(c + 3), F.lit("0")), 3, "0"), 1, 3).cast("int").alias("ms"),
        (F.upper(get(c + 4)) if form != "digits" else F.lit(None).cast("string")).alias("half"),
    )


def local_fields(local: Column, date_order: Column) -> Column:
    """Struct of the parts of a local time text, NULL if it has no known form."""
    which = {
        "iso": local.rlike(FORMS["iso"][0]),
        "digits": F.length(local).isin(8, 12, 14, 17) & local.rlike(FORMS["digits"][0]),
        "dots": local.rlike(FORMS["dots"][0]),
        "slash_ymd": local.rlike(FORMS["slash_ymd"][0]),
        "slash_dmy": (date_order == "dmy") & local.rlike(FORMS["slash_dmy"][0]),
        "slash_mdy": (date_order == "mdy") & local.rlike(FORMS["slash_mdy"][0]),
        "named": local.rlike(FORMS["named"][0]),
    }
    f = None
    for form, holds in which.items():
        f = F.when(holds, _fields(form, local)) if f is None else f.when(holds, _fields(form, local))
    return f


def fields_ms(f: Column) -> Column:
    """Milliseconds of the parts as if they were UTC; NULL if they are no possible date and time."""
    hour = F.when(f["half"].isNull(), f["h"]).when(f["h"].between(1, 12), f["h"] % 12 + F.when(f["half"] == "PM", 12).otherwise(0))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", f["y"], f["m"], f["d"]), "yyyy-MM-dd")
    ok = hour.between(0, 23) & f["mi"].between(0, 59) & f["s"].between(0, 59) & f["m"].between(1, 12)
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.when(ok, days * DAY_MS + hour.cast("bigint") * 3_600_000 + f["mi"] * 60_000 + f["s"] * 1000 + f["ms"])


def to_instants(rows: DataFrame, text: str, zone: str, date_order: str, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with ``epoch_ms`` (NULL where the text denotes no instant) and ``time_kind``.

    time_kind: epoch, offset, unique, ambiguous, skipped or none.
    """
    intervals, short = tables
    parts = rows.withColumn("_z", split_zone(F.col(text)))
    bare = F.col("_z.local")
    epoch = F.when(F.col("_z.offset_ms").isNull() & F.col("_z.region").isNull() & F.col("_z.abbreviation").isNull() & bare.rlike(r"^(\d{10}|\d{13})$"), F.rpad(bare, 13, "0").cast("bigint"))
    # a step each: parts that are used many times must not be repeated inside one expression
    parts = parts.withColumn("_epoch", epoch).withColumn("_f", local_fields(bare, F.col(date_order)))
    parts = parts.withColumn("_local", fields_ms(F.col("_f")))
    parts = parts.withColumn("_zone", F.coalesce("_z.region", zone)).withColumn("_year", F.least(F.greatest(F.col("_f.y"), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)))
    known = parts.join(F.broadcast(short.withColumnsRenamed({"zone": "_sz", "abbreviation": "_sa"})), (F.col("_z.abbreviation") == F.col("_sa")) & (F.col("_zone") == F.col("_sz")), "left")
    placed = known.join(F.broadcast(intervals.withColumnsRenamed({"zone": "_iz", "year": "_iy"})), (F.col("_zone") == F.col("_iz")) & (F.col("_year") == F.col("_iy")), "left")
    holds = lambda i: (F.col("_local") >= i["start"]) & (F.col("_local") < i["end"])
    # of the intervals that carry the abbreviation the one that holds the time, else the nearest
    away = lambda i: F.struct(F.greatest(i["start"] - F.col("_local"), F.col("_local") - i["end"] + 1, F.lit(0)).alias("ms"), (-i["offset"]).alias("minus"))
    placed = placed.withColumn("_named", -F.array_min(F.transform("carried", away))["minus"])
    placed = placed.withColumn("_hits", F.when(F.col("_z.abbreviation").isNull(), F.filter("intervals", holds)))
    # as-of: the last interval that ended before a skipped time
    before = F.array_max(F.transform(F.filter("intervals", lambda i: i["end"] <= F.col("_local")), lambda i: F.struct(i["end"].alias("end"), i["offset"].alias("offset"))))["offset"]
    placed = placed.withColumn("_before", F.when(F.size("_hits") == 0, before))
    offset = F.coalesce("_z.offset_ms", "_named")
    offset = F.when(offset > -(10**12), offset)
    kind = (
        F.when(F.col("_epoch").isNotNull(), "epoch").when(F.col("_local").isNull(), "none")
        .when(F.col("_z.offset_ms").isNotNull() | F.col("_z.abbreviation").isNotNull(), F.when(offset.isNotNull(), "offset").otherwise("none"))
        .when(F.size("_hits") >= 2, "ambiguous").when(F.size("_hits") == 1, "unique").when(F.col("_before").isNotNull(), "skipped")
        .otherwise("none")
    )
    placed = placed.withColumn("time_kind", kind)
    value = (
        F.when(F.col("time_kind") == "epoch", F.col("_epoch"))
        .when(F.col("time_kind") == "offset", F.col("_local") - offset)
        .when(F.col("time_kind") == "skipped", F.col("_local") - F.col("_before"))
        .when(F.col("time_kind") != "none", F.array_min(F.transform("_hits", lambda i: F.col("_local") - i["offset"])))
    )
    return placed.select(*[F.col(c) for c in rows.columns], value.alias("epoch_ms"), "time_kind")
