"""Mixed notations of time, with or without a zone, brought to one UTC instant.

Raw strings are first reduced to a dictionary of distinct (string, site) pairs. Only pairs the dictionary
doesn't hold yet are parsed, once, by an exhaustive list of notations; then rows look their instant up.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.bind import let
from siftmill.functions.text import fold_code, strip
from siftmill.operators.skew import lookup
from siftmill.session import broadcast_if_small, table_path

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Abbreviations that mean one offset wherever they are written. CST, IST, EST, MST, BST and the like
#: depend on the site and aren't here.
PLAIN_ZONES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "jst": 540, "cet": 60, "cest": 120}
DICTIONARY = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("date_order", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("utc", T.TimestampNTZType()),
    ]
)

_CLOCK = r"(\d{1,2})[:时](\d{1,2})(?:[:分](\d{1,2})(?:[.,](\d{1,9}))?秒?)?分?"
_HALF = r"\s*(am|pm|a\.m\.|p\.m\.)?"
_ZONE = r"\s*(z|utc|gmt|ut|[a-z]{2,5}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|\[[a-z_]+(?:/[a-z_+-]+)*\])?"
_MON = "(" + "|".join(MONTHS) + ")[a-z]*"
#: Notations. Groups of each: three parts of the date, half day in front, hour, minute, second, fraction, half day, zone.
SHAPES = (
    ("year_first", rf"^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?(?:t|\s)\s*(上午|下午)?\s*{_CLOCK}{_HALF}{_ZONE}$"),
    ("by_site", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{1,2}})(?:t|,?\s)\s*(上午|下午)?\s*{_CLOCK}{_HALF}{_ZONE}$"),
    ("day_month", rf"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(\d{{1,2}})[-/.\s]{_MON}[-/.\s](\d{{4}})()\s+{_CLOCK}{_HALF}{_ZONE}$"),
    ("month_day", rf"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?{_MON}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})()\s+{_CLOCK}{_HALF}{_ZONE}$"),
    ("year_first", r"^(\d{4})(\d{2})(\d{2})()(?:[t\s])?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?()\s*(z|utc|[+-]\d{2}:?\d{2})?$"),
)


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each zone's own abbreviations with their minutes east, from the zone database. An abbreviation
    that a zone used for two offsets keeps the later one."""
    for pdf in batches:
        out = []
        for site, zone, order in zip(pdf["site"], pdf["zone"], pdf["date_order"], strict=True):
            names: dict[str, int] = {}
            try:
                tz = ZoneInfo(zone)
            except Exception:  # noqa: BLE001 - an unknown zone names nothing
                tz = None
            if tz is not None:
                for year in range(2000, 2038):
                    for month in (1, 4, 7, 10):
                        at = dt.datetime(year, month, 15, 12, tzinfo=tz)
                        name = (at.tzname() or "").lower()
                        if name.isalpha():
                            names[name] = int(at.utcoffset().total_seconds() // 60)
            out.append((site, zone if tz is not None else None, order, names))
        yield pd.DataFrame(out, columns=["site", "zone", "date_order", "names"])


def site_rules(sites: DataFrame) -> DataFrame:
    """One row a site: zone, date order and the offsets its abbreviations stand for. A repeated site
    keeps its least (zone, date_order)."""
    one = sites.where(F.col("site").isNotNull()).groupBy("site").agg(F.min(F.struct("zone", "date_order")).alias("r"))
    rules = one.select("site", "r.zone", "r.date_order")
    return rules.mapInPandas(_offsets, "site string, zone string, date_order string, names map<string,int>")


def _num(c: Column) -> Column:
    return F.when(c != "", c.try_cast("int"))


def _hour24(hour: Column, half: Column) -> Column:
    late = half.isin("pm", "p.m.", "下午")
    early = half.isin("am", "a.m.", "上午")
    twelve = F.when(hour == 12, F.lit(0)).otherwise(hour)
    # "下午13:05" and "15:00 PM" tell the hour already.
    return F.when(late, F.when(hour > 12, hour).otherwise(twelve + 12)).when(early, twelve).otherwise(hour)


def _stamp(n: Column) -> Column:
    """A time from (year, month, day, hour, minute, second, micros); NULL if any part is impossible."""
    y, mo, d, h, mi, s, us = (n[i] for i in range(7))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    fine = y.between(1900, 2200) & mo.between(1, 12) & (d >= 1) & (d <= last) & (h <= 23) & (mi <= 59) & (s <= 59)
    return F.when(fine, F.make_timestamp_ntz(y, mo, d, h, mi, s + (us / F.lit(1_000_000)).cast("decimal(8,6)")))


def _numbers(part: Column, date_order: Column) -> Column:
    """(year, month, day, hour, minute, second, micros) of the parts of a notation."""
    kind, one, two, three = (part[i] for i in range(4))
    month = lambda c: F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), c).cast("int"), F.lit(0))
    year = lambda v: F.when(v < 70, v + 2000).when(v < 100, v + 1900).otherwise(v)
    # "ymd" can't order 5/10/2026: nothing is told there.
    site_year = F.when(date_order.isin("dmy", "mdy"), year(_num(three))).when((date_order == "ymd") & (F.length(three) < 4), year(_num(one)))
    y = F.when(kind == "year_first", _num(one)).when(kind == "by_site", site_year).otherwise(_num(three))
    site_month = F.when(date_order == "mdy", _num(one)).otherwise(_num(two))
    mo = F.when(kind == "year_first", _num(two)).when(kind == "by_site", site_month).when(kind == "day_month", month(two)).otherwise(month(one))
    site_day = F.when(date_order == "dmy", _num(one)).when(date_order == "mdy", _num(two)).otherwise(_num(three))
    d = F.when(kind == "year_first", _num(three)).when(kind == "by_site", site_day).when(kind == "day_month", _num(one)).otherwise(_num(two))
    half = F.coalesce(F.nullif(part[4], F.lit("")), part[9])
    micros = F.rpad(F.substring(part[8], 1, 6), 6, "0").cast("int")
    return F.array(y, mo, d, _hour24(_num(part[5]), half), _num(part[6]), F.coalesce(_num(part[7]), F.lit(0)), micros)


def parse_instant(raw: Column, zone: Column, date_order: Column, names: Column) -> Column:
    """UTC time (without zone type) of one raw string, or NULL where it tells no single instant.

    NULL: blanks and placeholders, a date or a clock alone, impossible dates and hours, a local time that
    the zone skips, a zoneless time without a zone, an abbreviation the site doesn't know, numbers of
    another length than 10 (seconds), 13 (milliseconds), 16 (microseconds) or 14 (yyyyMMddHHmmss). A local
    time that occurs twice is the first of the two.
    """
    plain = F.regexp_replace(strip(F.lower(fold_code(raw))), r"\s+", " ")

    def numeric(text: Column) -> Column:
        number = text.try_cast("bigint")
        micros = F.when(F.length(text) == 10, number * 1_000_000).when(F.length(text) == 13, number * 1000).otherwise(number)
        return F.timestamp_add("MICROSECOND", micros % 1_000_000, F.timestamp_add("SECOND", F.floor(micros / 1_000_000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))

    def zoned(local: Column, mark: Column) -> Column:
        digits = F.regexp_extract(mark, r"([+-])(\d{1,2}):?(\d{2})?$", 0)
        sign = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
        hours, rest = (_num(F.regexp_extract(digits, p, 1)) for p in (r"[+-](\d{1,2})", r"[+-]\d{1,2}:?(\d{2})$"))
        named = F.coalesce(*[F.when(mark == k, F.lit(v)) for k, v in PLAIN_ZONES.items()])
        shift = F.when(digits != "", sign * (hours * 60 + F.coalesce(rest, F.lit(0)))).otherwise(F.coalesce(F.try_element_at(names, mark), named))
        by_shift = F.when(shift.between(-1080, 1080), F.timestamp_add("MINUTE", -shift, local))
        # A region in brackets is the site's own, or one of the database.
        region = F.regexp_extract(mark, r"^\[(.+)\]$", 1)
        proper = F.array_join(F.transform(F.split(region, "/"), lambda p: F.array_join(F.transform(F.split(p, "_"), lambda w: F.initcap(w)), "_")), "/")
        known = F.array_contains(F.array(*[F.lit(z) for z in _regions()]), proper)
        where = F.when((region == "") | (region == F.lower(zone)), zone).when(known, proper)
        # A skipped local time comes back as another one.
        back = lambda utc: F.when(F.convert_timezone(F.lit("UTC"), where, utc) == local, utc)
        by_zone = F.when(where.isNotNull(), let(F.convert_timezone(where, F.lit("UTC"), local), back))
        return F.when((mark == "") | (region != ""), by_zone).otherwise(by_shift)

    def told(text: Column) -> Column:
        groups = "|".join(f"${i}" for i in range(1, 11))
        parts = F.coalesce(*[F.when(text.rlike(p), F.split(F.concat(F.lit(f"{k}|"), F.regexp_replace(text, p, groups)), "\\|", -1)) for k, p in SHAPES])
        spoken = let(parts, lambda part: let(_stamp(_numbers(part, date_order)), lambda local: zoned(local, part[10])))
        return F.when(text.rlike(r"^(?:\d{10}|\d{13}|\d{16})$"), numeric(text)).otherwise(spoken)

    return let(plain, told)


def _regions() -> list[str]:
    """Regions a bracket may name besides the site's own: the plain two-part ones of the database."""
    from zoneinfo import available_timezones

    areas = ("Africa/", "America/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    plain = lambda z: all(w == w.capitalize() for p in z.split("/") for w in p.split("_"))
    return sorted(z for z in available_timezones() if z.startswith(areas) and plain(z))


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(DICTIONARY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def time_dictionary(rows: DataFrame, sites: DataFrame, raw: str, site: str, path: str, alone: bool = False) -> DataFrame:
    """The dictionary of distinct (raw, site) pairs of ``rows`` with their instants, kept at ``path``.

    What ``path`` holds under the same rules (zone and date order) isn't parsed again; new pairs are
    appended. ``n`` is how often the pair stands in the present rows. Each pair comes once, also where two jobs
    appended it at the same time. ``alone`` says that ``path`` is new and known to this job only.
    """
    spark = rows.sparkSession
    pairs = rows.where(F.col(raw).isNotNull()).groupBy(F.col(raw).alias("raw"), F.col(site).alias("site")).agg(F.count("*").alias("n"))
    rules = broadcast_if_small(site_rules(sites))
    pairs = pairs.join(rules, "site", "left")
    same = ("raw", "site", "zone", "date_order")
    known = None if alone else _held(spark, path)
    new = pairs if known is None else pairs.join(known, [pairs[c].eqNullSafe(known[c]) for c in same], "left_anti")
    parsed = new.select(*same, "n", parse_instant(F.col("raw"), F.col("zone"), F.col("date_order"), F.col("names")).alias("utc"))
    parsed.write.mode("append").parquet(path)
    held = spark.read.schema(DICTIONARY).parquet(path)
    if alone:
        return held
    held = held.groupBy(*same).agg(F.min("utc").alias("utc"))
    now = pairs.select("raw", "site", "zone", "date_order", "n")
    return now.join(held, [now[c].eqNullSafe(held[c]) for c in same], "inner").select(*[now[c] for c in same], now["n"], held["utc"])


def normalise_times(rows: DataFrame, sites: DataFrame, raw: str, site: str, out: str, path: str | None = None) -> DataFrame:
    """``rows`` with one more column ``out``, the UTC time that ``raw`` tells at ``site`` (NULL if none).

    Every row stays, whatever its other columns; a column already called ``out`` is replaced. NULL, empty and
    unreadable strings give NULL, as does an empty table. A site that ``sites`` lacks counts as none. With ``path`` the
    dictionary is kept there, for later runs to parse new strings only.
    """
    words = time_dictionary(rows, sites, raw, site, path or table_path(rows.sparkSession, "time_dictionary"), alone=path is None)
    keyed = rows.drop(out) if out in rows.columns and out not in (raw, site) else rows
    none = "\x00"
    keyed = keyed.withColumns({"__raw": F.col(raw), "__site": F.coalesce(F.col(site), F.lit(none))})
    table = words.where(F.col("utc").isNotNull()).select(
        F.col("raw").alias("__raw"), F.coalesce("site", F.lit(none)).alias("__site"), "n", F.col("utc").alias("__utc")
    )
    spread = F.struct(*[c for c, kind in keyed.dtypes if not kind.startswith(("map", "variant"))])
    joined = lookup(keyed, table, ["__raw", "__site"], "n", spread, "left")
    return joined.select(*[c for c in joined.columns if not c.startswith("__")], F.col("__utc").alias(out))
