"""URI and date-time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment (RFC 2396, appendix B). Fixed value.
PARTS = r"\A(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
CHARS = r"(?:[A-Za-z0-9\-_.!~*'();/?:@&=+$,\[\]]|%[0-9A-Fa-f]{2})"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(x, n: int) -> Column:
    return F.regexp_extract(_c(x), PARTS, n)


def without_fragment(x) -> Column:
    return F.regexp_replace(_c(x), r"#.*\z", "")


def fragment(x) -> Column:
    """The text after '#', '' without one."""
    return F.regexp_extract(_c(x), r"#(.*)\z", 1)


def with_fragment(x, text) -> Column:
    return F.concat(without_fragment(x), F.lit("#"), _c(text))


def is_reference(x) -> Column:
    return _c(x).rlike(rf"\A{CHARS}*(#{CHARS}*)?\z")


def is_absolute(x) -> Column:
    return _c(x).rlike(rf"\A[A-Za-z][A-Za-z0-9+.-]*:{CHARS}+\z")


def remove_dots(path: Column) -> Column:
    """A path without '.' and '..' segments; leading '..' of an absolute path go."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 1) & (F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(F.lit(""))), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when((s == "..") & (F.size(acc) == 1) & (F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(F.lit("x"))), 1) == ""), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(kept, "/")


def resolve(base, reference) -> Column:
    """A reference against an absolute base (RFC 2396, section 5.2)."""
    r, b = [part(reference, i) for i in range(1, 6)], [part(base, i) for i in range(1, 6)]
    joined = F.concat(F.regexp_replace(b[2], r"[^/]*\z", ""), r[2])
    path = F.when((r[2] == "") & (r[3] == ""), b[2]).when(r[2].startswith("/"), r[2]).otherwise(remove_dots(joined))
    query = F.when((r[2] == "") & (r[3] == ""), b[3]).otherwise(r[3])
    tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(r[4] != "", F.concat(F.lit("#"), r[4])).otherwise(""))
    head = F.concat(b[0], F.lit(":"), F.when(b[1] != "", F.concat(F.lit("//"), b[1])).otherwise(""))
    return F.when(r[0] != "", _c(reference)).when(r[1] != "", F.concat(b[0], F.lit(":"), _c(reference))).otherwise(F.concat(head, path, tail))


def escape(x) -> Column:
    """Percent-escapes all but unreserved characters; blanks become %20."""
    return F.replace(F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def unescape(x) -> Column:
    return F.url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B")))


def leap_year(year) -> Column:
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(year, month) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(_c(year), _c(month), F.lit(1))))


def day_number(date) -> Column:
    """Days since 1900-01-01."""
    return F.datediff(_c(date), F.lit("1900-01-01").cast("date"))


def from_day_number(days) -> Column:
    return F.date_add(F.lit("1900-01-01").cast("date"), _c(days).cast("int"))


def to_utc(local, offset_minutes) -> Column:
    """A local time with its zone's offset, on the common scale on which times compare."""
    return F.timestamp_add("MINUTE", -_c(offset_minutes), _c(local))


def relativise(base, full) -> Column:
    """A reference that leads from an absolute base to ``full``; ``full`` itself for another scheme.

    Another authority, or a path that shares no first segment, gives a reference from the root on.
    """
    b, f = [part(base, i) for i in range(1, 6)], [part(full, i) for i in range(1, 6)]
    old, new = F.split(b[2], "/"), F.split(f[2], "/")
    most = F.least(F.size(old), F.size(new)) - 1
    places = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    shared = F.aggregate(places, F.lit(0), lambda n, i: F.when((i <= most) & (n == i - 1) & (F.try_element_at(old, i) == F.try_element_at(new, i)), i).otherwise(n))
    ups = F.size(old) - 1 - shared
    rest = F.array_join(F.slice(new, shared + 1, F.greatest(F.size(new) - shared, F.lit(0))), "/")
    short = F.concat(F.repeat(F.lit("../"), ups), rest)
    short = F.when((ups == 0) & ((rest == "") | (F.substring_index(rest, "/", 1).contains(":"))), F.concat(F.lit("./"), rest)).otherwise(short)
    path = F.when(shared <= 1, F.when(f[2] == "", F.lit("/")).otherwise(f[2])).otherwise(short)
    tail = F.concat(F.when(f[3] != "", F.concat(F.lit("?"), f[3])).otherwise(""), F.when(f[4] != "", F.concat(F.lit("#"), f[4])).otherwise(""))
    away = F.concat(F.lit("//"), f[1], f[2], tail)
    return F.when(b[0] != f[0], _c(full)).when(b[1] != f[1], away).otherwise(F.concat(path, tail))


#: host, then port: a name, an IPv4 address or an IPv6 address in brackets (RFC 2396 and 2732). Fixed value.
HOST = r"\A(?:[A-Za-z0-9\-_.!~*'();:&=+$,%]*@)?(?:\[[0-9A-Fa-f:.]+\]|(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?)(?::[0-9]*)?\z"


def has_host(x) -> Column:
    """The URI's authority is a host with an optional port."""
    return part(x, 2).rlike(HOST)


def zone_minutes(text) -> Column:
    """Minutes ahead of the common scale that a date-time's text ends with: Z or a signed hh:mm; NULL without one."""
    t = _c(text)
    sign, hours, minutes = (F.regexp_extract(t, r"([+-])([0-9]{2}):([0-9]{2})\z", i) for i in (1, 2, 3))
    value = hours.try_cast("int") * 60 + minutes.try_cast("int")
    return F.when(t.endswith("Z"), F.lit(0)).when(sign == "-", -value).when(sign == "+", value)


def instant(text) -> Column:
    """The time on the common scale of ``yyyy-mm-ddThh:mm:ss`` with a zone; texts without one are on it already."""
    local = F.try_to_timestamp(F.regexp_replace(_c(text), r"(Z|[+-][0-9]{2}:[0-9]{2})\z", "").cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return to_utc(local, F.coalesce(zone_minutes(text), F.lit(0)))


def earlier(a, b) -> Column:
    return instant(a) < instant(b)


def add_minutes(time, minutes) -> Column:
    return F.timestamp_add("MINUTE", _c(minutes), _c(time))


def add_days(date, days) -> Column:
    return from_day_number(day_number(date) + _c(days))


def show_time(time) -> Column:
    return F.date_format(_c(time), "yyyy-MM-dd HH:mm:ss")


def valid_date(year, month, day) -> Column:
    """The numbers are a day of the calendar."""
    y, m, d = _c(year), _c(month), _c(day)
    ok = F.coalesce(m.between(1, 12) & (d >= 1), F.lit(False))
    return ok & F.coalesce(d <= days_in_month(y, F.when(ok, m)), F.lit(False))


#: A date-time text: date, time, optional thousandths of a second, optional zone.
DATE_TIME = r"\A([0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,3}))?(Z|[+-][0-9]{2}:[0-9]{2})?\z"


def accessors(text) -> Column:
    """Struct of year, month, day, hour, minute, second, millisecs and timezone (minutes) as a date-time is written.

    Without a zone or thousandths these are 0. NULL for other texts, and for days and times that there are not.
    """
    at = lambda i: F.regexp_extract(_c(text), DATE_TIME, i)
    number = lambda i: at(i).try_cast("int")
    names = ("year", "month", "day", "hour", "minute", "second")
    fields = [number(i + 1).alias(n) for i, n in enumerate(names)]
    millisecs = F.coalesce(F.rpad(at(7), 3, "0").try_cast("int"), F.lit(0)).alias("millisecs")
    fine = _c(text).rlike(DATE_TIME) & valid_date(number(1), number(2), number(3)) & (number(4) < 24) & (number(5) < 60) & (number(6) < 60)
    return F.when(fine, F.struct(*fields, millisecs, F.coalesce(zone_minutes(text), F.lit(0)).alias("timezone")))


def show_date_time(parts) -> Column:
    """The text of what ``accessors`` gives: thousandths if there are any, and Z for the zone of the common scale."""
    x = _c(parts)
    pad = lambda v, n=2: F.lpad(v.cast("string"), n, "0")
    # years of more than four digits keep them
    year = F.when(x["year"] < 10_000, pad(x["year"], 4)).otherwise(x["year"].cast("string"))
    day = F.concat_ws("-", year, pad(x["month"]), pad(x["day"]))
    time = F.concat_ws(":", pad(x["hour"]), pad(x["minute"]), pad(x["second"]))
    thousandths = F.when(x["millisecs"] != 0, F.concat(F.lit("."), pad(x["millisecs"], 3))).otherwise("")
    ahead = F.abs(x["timezone"])
    zone = F.when(x["timezone"] == 0, "Z").otherwise(F.concat(F.when(x["timezone"] < 0, "-").otherwise("+"), pad(F.floor(ahead / 60)), F.lit(":"), pad(ahead % 60)))
    return F.when(x.isNotNull(), F.concat(day, F.lit("T"), time, thousandths, zone))
