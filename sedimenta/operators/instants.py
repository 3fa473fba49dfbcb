"""Normalise timestamps of mixed formats, precisions and zones to UTC instants.

A string is taken apart by patterns into a local clock time and what it says of a zone: a
fixed offset, a zone of the tz database, or nothing, in which case a zone column applies.
Local times of named zones are looked up as of the zone's offset intervals, exploded to one
row per zone and local year that holds the few intervals touching that year. Two intervals
that hold the local time mean that it is ambiguous: the first one counts. None means that it
was skipped: the offset before the change counts. One gives the offset directly. A status
column tells these apart.

Defined results: null for null, empty and meaningless strings, impossible dates, dates
without a time of day, and local times with neither zone nor zone column. Later years than
are tabulated have the offsets of a tabulated year with the same calendar, earlier ones that
of the first tabulated moment.
"""

from __future__ import annotations

import uuid
from calendar import isleap
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import shared_folder

#: Years for which named zones are tabulated. The last 28 hold every calendar a year can have.
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: Status of an instant: what fixed its offset.
STATED, UNIQUE, AMBIGUOUS, NONEXISTENT = "stated", "unique", "ambiguous", "nonexistent"

# Month names of the languages in which mail programs write dates.
MONTHS = {
    1: "jan january januar janvier enero gennaio januari",
    2: "feb february februar février fevrier febrero febbraio februari",
    3: "mar march märz maerz mars marzo maart mrz mär",
    4: "apr april avril abril aprile avr",
    5: "may mai mayo maggio mei",
    6: "jun june juni juin junio giugno",
    7: "jul july juli juillet julio luglio juil",
    8: "aug august août aout agosto augustus",
    9: "sep sept september septembre septiembre settembre",
    10: "oct october oktober octobre octubre ottobre okt",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre decembre diciembre dicembre dez déc",
}
# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "met": 60, "cest": 120, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_ZONE = r"(Z|z|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*\]|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Pattern and replacement giving year|month|day|hour|minute|second|fraction|half of day|zone.
FORMATS = [
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[Tt ]{_CLOCK} ?{_ZONE}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(?:\p{{L}}+\.?, )?(\d{{1,2}})\.? (\p{{L}}+)\.? (\d{{4}}|\d{{2}}) {_CLOCK} ?{_ZONE}?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^\p{{L}}+ (\p{{L}}+) (\d{{1,2}}) {_CLOCK} (?:([A-Za-z]+) )?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^\p{{L}}+ (\p{{L}}+) (\d{{1,2}}) {_CLOCK} (\d{{4}}) {_ZONE}$", "$7|$1|$2|$3|$4|$5|$6||$8"),
    (rf"^(\p{{L}}+)\.? (\d{{1,2}}), (\d{{4}}),? {_CLOCK} ?([AaPp][Mm])(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK} ?{_ZONE}?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日 ?{_CLOCK} ?{_ZONE}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
]
_EPOCH = r"^\d{9,10}(?:\.\d{1,9})?$|^\d{12,13}$|^\d{15,16}$"


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parsed(df: DataFrame, text: str, zone: str, out: str = "__t") -> DataFrame:
    """df with a struct column out: epoch (microseconds, for numbers), local (microseconds
    of the clock time read as UTC), offset (seconds, if the string fixes it) and zone (lower
    case, to be looked up). All null where text states no point in time."""
    s = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    s = F.regexp_replace(s, r"([+-]\d{4}|\d) \([A-Za-z ]+\)$", "$1")
    parts = None
    for pattern, shape in FORMATS:
        one = F.regexp_replace(F.col("__s"), pattern, shape)
        parts = F.when(F.col("__s").rlike(pattern), one) if parts is None else parts.when(F.col("__s").rlike(pattern), one)
    df = df.withColumn("__s", s).withColumn("__p", F.split(parts, r"\|"))
    p = [F.try_element_at(F.col("__p"), F.lit(i + 1)) for i in range(9)]
    num = lambda c: c.try_cast("int")
    year = F.when(F.length(p[0]) == 2, num(p[0]) + F.when(num(p[0]) < 50, 2000).otherwise(1900)).otherwise(num(p[0]))
    months = _lookup({w: m for m, words in MONTHS.items() for w in words.split()})
    month = F.coalesce(num(p[1]), F.try_element_at(months, F.lower(p[1])))
    half, hour = F.lower(p[7]), num(p[3])
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).when(half == "pm", hour % 12 + 12).otherwise(hour % 12)
    micros = num(F.rpad(F.left(p[6], F.lit(6)), 6, "0"))
    at = F.try_make_timestamp(year, month, num(p[2]), hour, num(p[4]), F.coalesce(num(p[5]), F.lit(0)).cast("decimal(8,6)"), F.lit("UTC"))
    local = F.unix_micros(at) + F.coalesce(micros, F.lit(0))
    z = F.lower(F.regexp_replace(p[8], r"[\[\]]", ""))
    sign = F.when(F.left(z, F.lit(1)) == "-", -1).otherwise(1)
    hh, mm = num(F.substring(z, 2, 2)), F.coalesce(num(F.right(z, F.lit(2))), F.lit(0))
    numeric = F.when((hh <= 18) & (mm < 60), sign * (hh * 3600 + F.when(F.length(z) > 3, mm * 60).otherwise(0)))
    offset = F.when(z.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(_lookup(ABBREVIATIONS), z) * 60)
    named = F.when(z == "", F.lower(F.trim(F.col(zone)))).when(z.contains("/"), z)
    digits = F.col("__s").try_cast("decimal(28,9)")
    whole = F.length(F.substring_index("__s", ".", 1))
    epoch = F.when(F.col("__s").rlike(_EPOCH), F.floor(digits * F.when(whole <= 10, 1000000).when(whole <= 13, 1000).otherwise(1)).cast("bigint"))
    return df.withColumn(out, F.struct(epoch.alias("epoch"), local.alias("local"), offset.cast("int").alias("offset"), named.alias("zone"))).drop("__s", "__p")


def zone_changes(name: str) -> list[tuple[int, int, int]]:
    """Intervals (first second, end second, seconds east) of a zone in UTC."""
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(name)
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    east = lambda t: int((zero + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())
    t, end = int((datetime(FIRST_YEAR - 1, 1, 1, tzinfo=timezone.utc) - zero).total_seconds()), int((datetime(LAST_YEAR + 2, 1, 1, tzinfo=timezone.utc) - zero).total_seconds())
    out, start, now, step = [], t, east(t), 14 * 86400
    while t < end:
        nxt = t + step
        if (o := east(nxt)) != now:
            lo, hi = t, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if east(mid) == now else (lo, mid)
            out.append((start, hi, now))
            start, now = hi, east(hi)
            nxt = hi if now != o else nxt
        t = nxt
    return [*out, (start, end, now)]


def zone_intervals(spark: SparkSession) -> DataFrame:
    """(zone, year, spans): the offset intervals of every zone, exploded to the local years
    they touch. At most zones of the tz database times tabulated years: a fixed size."""
    from zoneinfo import available_timezones

    def expand(batches: Iterator) -> Iterator:
        import pandas as pd

        starts = [int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
        for batch in batches:
            rows = []
            for name in batch["name"]:
                try:
                    spans = [(a + o, b + o, o) for a, b, o in zone_changes(name)]
                except Exception:  # a name that this machine's tz database lacks
                    continue
                k = 0
                for i, y in enumerate(range(FIRST_YEAR, LAST_YEAR + 1)):
                    lo, hi = starts[i] - 172800, starts[i + 1] + 172800
                    while spans[k][1] <= lo:
                        k += 1
                    j = k
                    while j < len(spans) and spans[j][0] < hi:
                        a, b, o = spans[j]
                        rows.append((name.lower(), y, a * 1000000, b * 1000000, o))
                        j += 1
            yield pd.DataFrame(rows, columns=["zone", "year", "a", "b", "east"])

    names = spark.createDataFrame([(n,) for n in sorted(available_timezones())], "name string").repartition(8)
    spans = names.mapInPandas(expand, "zone string, year int, a long, b long, east int")
    return spans.groupBy("zone", "year").agg(F.array_sort(F.collect_list(F.struct("a", "b", "east"))).alias("spans"))


_tables: dict[str, str] = {}


def zone_table(spark: SparkSession) -> DataFrame:
    """zone_intervals, made once for each application and kept in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        path = f"{shared_folder(spark).rstrip('/')}/zones-{uuid.uuid4().hex}"
        zone_intervals(spark).coalesce(1).write.parquet(path)
        _tables[app] = path
    return spark.read.schema("zone string, year int, spans array<struct<a:bigint,b:bigint,east:int>>").parquet(_tables[app])


def _tabulated(local: Column) -> Column:
    """A clock time with the same offset in the years that are tabulated."""
    year = F.year(F.timestamp_micros(local))
    calendars = {}
    for y in range(LAST_YEAR - 27, LAST_YEAR + 1):
        first = date(y, 1, 1)
        calendars[first.isoweekday() % 7 + 1 + (10 if isleap(y) else 0)] = first.toordinal() - date(1970, 1, 1).toordinal()
    first = F.make_date(year, F.lit(1), F.lit(1))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    same = F.try_element_at(_lookup(calendars), F.dayofweek(first) + F.when(leap, 10).otherwise(0))
    start = int((datetime(FIRST_YEAR, 1, 1) - datetime(1970, 1, 1)).total_seconds()) * 1000000
    later = local + (same - F.unix_date(first)).cast("bigint") * 86400000000
    return F.when(year > LAST_YEAR, later).otherwise(F.greatest(local, F.lit(start)))


def to_utc(df: DataFrame, text: str, zone: str, out: str = "utc_us", status: str | None = None) -> DataFrame:
    """df with the instant that text states, in microseconds since 1970 in UTC, or null, and
    if asked its status: stated (by the string), unique, ambiguous or nonexistent."""
    t = F.col("__t")
    df = parsed(df, text, zone).withColumn("__zone", F.when(t["offset"].isNull() & t["epoch"].isNull(), t["zone"]))
    df = df.withColumn("__at", F.when(F.col("__zone").isNotNull(), _tabulated(t["local"]))).withColumn("__year", F.year(F.timestamp_micros("__at")))
    table = F.broadcast(zone_table(df.sparkSession).select(F.col("zone").alias("__z"), F.col("year").alias("__y"), F.col("spans").alias("__spans")))  # fixed size
    df = df.join(table, (F.col("__zone") == F.col("__z")) & (F.col("__year") == F.col("__y")), "left")
    at = F.col("__at")
    hold = F.filter("__spans", lambda s: (s["a"] <= at) & (at < s["b"]))
    before = F.try_element_at(F.filter("__spans", lambda s: s["b"] <= at), F.lit(-1))["east"]
    # Of two offsets that fit, the larger one is that of the earlier instant.
    east = F.when(F.size(hold) > 0, F.array_max(F.transform(hold, lambda s: s["east"]))).otherwise(before)
    df = df.withColumn(out, F.coalesce(t["epoch"], t["local"] - F.coalesce(t["offset"], east).cast("bigint") * 1000000))
    if status:
        by = F.when(F.col("__zone").isNull(), STATED).when(F.size(hold) > 1, AMBIGUOUS).when(F.size(hold) == 1, UNIQUE).otherwise(NONEXISTENT)
        df = df.withColumn(status, F.when(F.col(out).isNotNull(), by))
    return df.drop("__t", "__zone", "__at", "__year", "__z", "__y", "__spans")


def year_of(instant: Column) -> Column:
    """The year in UTC of microseconds since 1970; null stays null."""
    return F.year(F.timestamp_micros(instant))
