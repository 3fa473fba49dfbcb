"""SQL of another engine that reads dates as the operator of instants does, with that
engine's own time zones; what queries on instants and years are compared with."""

from __future__ import annotations

from sedimenta.operators.instants import ABBREVIATIONS, MONTHS

_ZONE = r"(Z|z|[+-]\d\d(?::?\d\d)?|\[[A-Za-z]+(?:/[\w+-]+)*\]|[A-Za-z]+(?:/[\w+-]+)*)"
_TIME = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?"
#: Each shape of a date, and what its groups are: year, month, day, hour, minute, second,
#: fraction, half of the day, zone.
SHAPES = [
    (rf"^(\d{{4}})[-/](\d\d?)[-/](\d\d?)[Tt ]{_TIME} ?{_ZONE}?$", "y mo d h mi s f z"),
    (rf"^(?:\p{{L}}+\.?, )?(\d\d?)\.? (\p{{L}}+)\.? (\d{{4}}|\d\d) {_TIME} ?{_ZONE}?$", "d mo y h mi s f z"),
    (rf"^\p{{L}}+ (\p{{L}}+) (\d\d?) {_TIME} (?:([A-Za-z]+) )?(\d{{4}})$", "mo d h mi s f z y"),
    (rf"^\p{{L}}+ (\p{{L}}+) (\d\d?) {_TIME} (\d{{4}}) {_ZONE}$", "mo d h mi s f y z"),
    (rf"^(\p{{L}}+)\.? (\d\d?), (\d{{4}}),? {_TIME} ?([AaPp][Mm])(?: {_ZONE})?$", "mo d y h mi s f ap z"),
    (rf"^(\d\d?)\.(\d\d?)\.(\d{{4}}),? {_TIME} ?{_ZONE}?$", "d mo y h mi s f z"),
    (rf"^(\d{{4}})年(\d\d?)月(\d\d?)日 ?{_TIME} ?{_ZONE}?$", "y mo d h mi s f z"),
    (rf"^(\d{{4}})(\d\d)(\d\d)[Tt](\d\d)(\d\d)(\d\d)?(?:[.,](\d{{1,9}}))?{_ZONE}?$", "y mo d h mi s f z"),
]
_PARTS = "y mo d h mi s f ap z".split()


def _shape(pattern: str, groups: str) -> str:
    at = {g: i + 1 for i, g in enumerate(groups.split())}
    quoted = pattern.replace("'", "''")
    parts = ", ".join(f"'{p}': " + (f"regexp_extract(s, '{quoted}', {at[p]})" if p in at else "''") for p in _PARTS)
    return f"when regexp_matches(s, '{quoted}') then {{{parts}}}"


def _map(pairs: dict[str, int]) -> str:
    return "map {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"


def instants(source: str, name: str = "inst", keep: str = "id") -> str:
    """Common table expressions ending in name(keep.., utc_us). source: a query of columns
    keep, dt (the string) and tz (the zone column)."""
    months = _map({w: m for m, words in MONTHS.items() for w in words.split()})
    shapes = " ".join(_shape(*x) for x in SHAPES)
    n = name
    return rf"""
{n}_src as ({source}),
{n}_s as (select {keep}, tz, regexp_replace(trim(regexp_replace(dt, '[\s\p{{Z}}]+', ' ', 'g')), '([+-]\d\d\d\d|\d) \([A-Za-z ]+\)$', '\1') as s from {n}_src),
{n}_p as (select *, case {shapes} end as p from {n}_s),
{n}_n as (select {keep}, tz, s, p, try_cast(p.y as int) + case when length(p.y) = 2 then (case when try_cast(p.y as int) < 50 then 2000 else 1900 end) else 0 end as y,
  coalesce(try_cast(p.mo as int), {months}[lower(p.mo)]) as mo, try_cast(p.h as int) as h, lower(p.ap) as ap, lower(regexp_replace(p.z, '[\[\]]', '', 'g')) as z from {n}_p),
{n}_l as (select {keep}, tz, s, z,
  epoch_us(try_cast(printf('%04d-%02d-%02d %02d:%s:%s.%s', y, mo, try_cast(p.d as int), case when ap = '' then (case when h < 24 then h end) when h between 1 and 12 then h % 12 + case when ap = 'pm' then 12 else 0 end end,
    p.mi, case when p.s = '' then '00' else p.s end, left(rpad(p.f, 9, '0'), 6)) as timestamp)) as local,
  case when z similar to '[+-].*' then (case when try_cast(z[2:3] as int) <= 18 and coalesce(try_cast(case when length(z) > 3 then right(z, 2) else '0' end as int), 0) < 60
      then (case when z[1] = '-' then -1 else 1 end) * (try_cast(z[2:3] as int) * 60 + case when length(z) > 3 then try_cast(right(z, 2) as int) else 0 end) end) else {_map(ABBREVIATIONS)}[z] end as east,
  case when z = '' then lower(trim(tz)) when contains(z, '/') then z end as zone,
  case when regexp_matches(s, '^\d{{9,10}}(\.\d{{1,9}})?$') then cast(floor(cast(s as decimal(28, 9)) * 1000000) as bigint) when regexp_matches(s, '^\d{{12,13}}$') then cast(s as bigint) * 1000 when regexp_matches(s, '^\d{{15,16}}$') then cast(s as bigint) end as epoch from {n}_n),
{n}_z as (select l.*, k.tzname, epoch_us(timezone(k.tzname, make_timestamp(local))) as late from {n}_l l left join (select lower(name) as zkey, min(name) as tzname from pg_timezone_names() group by 1) k on k.zkey = l.zone and l.east is null and l.epoch is null and l.local is not null),
{n} as (select {keep}, coalesce(epoch, local - cast(east as bigint) * 60000000, case when tzname is null then null else coalesce(
  {", ".join(f"case when epoch_us(timezone(tzname, make_timestamptz(late - {m}))) = local then late - {m} end" for m in (10800000000, 7200000000, 3600000000, 2400000000, 1800000000, 1200000000))}, late) end) as utc_us from {n}_z)"""
