"""Dates and times of the Lisbon calendar as Column expressions, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from agendry import constants as C
from agendry.functions.text import fold, let

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def lisbon(t: Column) -> Column:
    """Lisbon wall clock (without zone) of epoch seconds."""
    return F.convert_timezone(F.lit("UTC"), F.lit(C.LISBON), F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), t.cast("decimal(18,6)")))


def lisbon_day(t: Column) -> Column:
    return F.date_format(lisbon(t), "yyyy-MM-dd")


def lisbon_minute(t: Column) -> Column:
    return F.date_format(lisbon(t), "yyyy-MM-dd HH:mm")


def epoch_of(ntz: Column, zone: str = C.LISBON) -> Column:
    """Epoch seconds of a wall clock; null for null."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ntz)
    return F.timestamp_diff("SECOND", F.expr(EPOCH), utc)


def wall_clock(y: Column, m: Column, d: Column, h: Column | None = None, mi: Column | None = None) -> Column:
    """Epoch seconds of a Lisbon wall clock; a missing time is midnight and an impossible date is null."""
    hh, mm = (F.coalesce(x, F.lit("0")) if x is not None else F.lit("0") for x in (h, mi))
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"), F.lit(" "), F.lpad(hh.cast("string"), 2, "0"), F.lit(":"), F.lpad(mm.cast("string"), 2, "0"), F.lit(":00"))
    return epoch_of(text.try_cast("timestamp_ntz"))


def captured(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def iso_epoch(c: Column) -> Column:
    """An ISO text: with an offset or Z an instant, bare a Lisbon wall clock, a date alone its midnight."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?)?"
    y, m, d, h, mi = (captured(c, pattern, i) for i in range(1, 6))
    bare = wall_clock(y, m, d, h, mi)
    zone = captured(c, r"[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$", 1)
    text = F.concat_ws("", y, F.lit("-"), m, F.lit("-"), d, F.lit(" "), h, F.lit(":"), mi, F.lit(":00"))
    seconds = F.coalesce(captured(c, r"[T ]\d{2}:\d{2}:(\d{2})", 1).cast("bigint"), F.lit(0))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(F.replace(zone, F.lit(":"), F.lit("")), 4, 2).cast("int") * 60))
    return F.when(zone.isNotNull(), F.timestamp_diff("SECOND", F.expr(EPOCH), text.try_cast("timestamp_ntz")) + seconds - offset).otherwise(bare)


def month_number(c: Column) -> Column:
    """1 to 12 of a Portuguese month name, full or its first three letters, with or without marks."""
    short = F.substring(fold(c), 1, 3)
    return let(F.array_position(F.array(*[F.lit(m.replace("ç", "c")[:3]) for m in C.MONTHS]), short), lambda n: F.when(n > 0, n.cast("int")))


LONG_DATE = r"(?i)(\d{1,2})(?:\s+de)?\s+([a-zç]{3,9})\.?,?(?:\s+de)?\s+(\d{4})(?:\D{1,6}(\d{1,2})[:h](\d{2}))?"


def long_date(c: Column) -> Column:
    """Epoch seconds of a Portuguese date such as "19 de setembro de 2026, 18:30"; midnight without a time."""
    d, m, y, h, mi = (captured(c, LONG_DATE, i) for i in range(1, 6))
    return wall_clock(y, month_number(m), d, h, mi)


def shift_day(day: Column, n: Column | int) -> Column:
    return F.date_format(F.date_add(day.cast("date"), n), "yyyy-MM-dd")


def weekday(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day.cast("date"))


def strict_clock(c: Column) -> Column:
    """Epoch of YYYY-MM-DD HH:mm, with a space or T between and anything after the minute; null for other texts."""
    parts = [captured(F.trim(c), r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})", i) for i in range(1, 6)]
    return F.when(parts[0].isNotNull(), wall_clock(*parts))


def day_epoch(c: Column) -> Column:
    """Epoch of the midnight of a text that begins with YYYY-MM-DD."""
    y, m, d = (captured(c, r"^(\d{4})-(\d{2})-(\d{2})", i) for i in range(1, 4))
    return F.when(y.isNotNull(), wall_clock(y, m, d))


def start_of_day(t: Column) -> Column:
    """Epoch of the Lisbon midnight before or at t."""
    return epoch_of(F.date_trunc("DAY", lisbon(t)).cast("timestamp_ntz"))


def full_year(c: Column) -> Column:
    """The year of two digits (70 and above are of the last century) or more."""
    n = c.cast("int")
    return F.when(F.length(c) > 2, n).when(n >= 70, n + 1900).otherwise(n + 2000)


def full_month(c: Column) -> Column:
    """1 to 12 of a whole Portuguese month name, with or without marks; null for other words."""
    names = F.array(*[F.lit(m.replace("ç", "c")) for m in C.MONTHS])
    return F.nullif(F.array_position(names, fold(c)), F.lit(0).cast("bigint")).cast("int")


def chip_dates(chunk: Column) -> Column:
    """struct(earliest, latest) of the dates that a listing chip shows.

    Slashed (2026/10/04) and dotted (17.10.26) dates decide; without any, the days, months and year of the
    chip's spans do. A chip without a year gives nulls, and dates that do not exist do not count.
    """
    def found(pattern: str, year: int, month: int, day: int) -> Column:
        groups = [F.regexp_extract_all(chunk, F.lit(pattern), F.lit(i)) for i in range(1, 4)]
        each = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])
        get = lambda x, i: x.getField(f"g{i}")
        return F.transform(each, lambda x: wall_clock(full_year(get(x, year)), get(x, month), get(x, day)))

    whole = F.array_compact(F.concat(found(r"(\d{4})/(\d{1,2})/(\d{1,2})", 1, 2, 3), found(r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})(?!\d)", 3, 2, 1)))
    days = F.regexp_extract_all(chunk, F.lit(r'class="?dia"?>\s*(\d{1,2})'), F.lit(1))
    names = F.regexp_extract_all(chunk, F.lit(r'class="?mes(?:_curto|_extenso)?"?>\s*([A-Za-zÀ-ÿ]+|\d{1,2})'), F.lit(1))
    number = lambda m: F.when(m.rlike(r"^\d+$"), F.when(m.cast("int").between(1, 12), m.cast("int"))).otherwise(month_number(m))
    months = F.array_compact(F.transform(names, number))
    year = full_year(captured(chunk, r'class="?ano"?>\s*(\d{2,4})', 1))
    ends = [wall_clock(year, F.try_element_at(months, F.lit(i)), F.try_element_at(days, F.lit(i))) for i in (1, -1)]
    spans = F.array_compact(F.array(*ends))
    dates = F.when(F.size(whole) > 0, whole).otherwise(spans)
    return F.struct(F.array_min(dates).alias("earliest"), F.array_max(dates).alias("latest"))


_NAME = r"([\p{L}]+)"


def date_range(c: Column) -> Column:
    """struct(start, end), days as yyyy-MM-dd, of "13 de Junho, 2026" or of two such dates with a dash between; null for other texts."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[–—]", "-"))
    one = rf"(\d{{1,2}})\s+de\s+{_NAME},\s*(\d{{4}})"
    safe = lambda y, m, d: F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string")

    def days(flat: Column) -> Column:
        part = lambda i: captured(flat, rf"^{one}(?:\s*-\s*{one})?$", i)
        start = safe(part(3), full_month(part(2)), part(1))
        return F.struct(start.alias("start"), F.when(part(4).isNull(), start).otherwise(safe(part(6), full_month(part(5)), part(4))).alias("end"))

    return let(let(flat, days), lambda r: F.when(r["start"].isNotNull() & r["end"].isNotNull(), r))


def day_span(c: Column) -> Column:
    """struct(first, last, month) of "4 a 7 de Setembro" or "4 de Setembro" anywhere in a text; null without a month."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[–—]", "-"))
    two, one = rf"(\d{{1,2}})\s*(?:a|e|-)\s*(\d{{1,2}})\s+de\s+{_NAME}", rf"(\d{{1,2}})\s+de\s+{_NAME}"

    def found(flat: Column) -> Column:
        span = F.struct(captured(flat, two, 1).cast("int").alias("first"), captured(flat, two, 2).cast("int").alias("last"), full_month(captured(flat, two, 3)).alias("month"))
        day = captured(flat, one, 1).cast("int")
        single = F.struct(day.alias("first"), day.alias("last"), full_month(captured(flat, one, 2)).alias("month"))
        return F.when(captured(flat, two, 1).isNotNull(), span).otherwise(single)

    return let(let(flat, found), lambda r: F.when(r["month"].isNotNull(), r))


def utc_date(t: Column) -> Column:
    return F.to_date(F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), t.cast("decimal(18,6)")))


def resolve_year(month: Column, day: Column, ref: Column) -> Column:
    """The year of a month and day that do not lie before the UTC day of epoch ``ref``."""
    return let(utc_date(ref), lambda at: F.year(at) + (month * 100 + day < F.month(at) * 100 + F.dayofmonth(at)).cast("int"))


def infer_epochs(span: Column, now: int) -> Column:
    """struct(start, end) of a day span: this year if its end is at most a day past, else next year if it starts within ANNOUNCE_DAYS.

    Starts are midnights and ends 23:59; a date that does not exist in one year is tried in the next.
    """
    this = F.year(utc_date(F.lit(now)))

    def candidate(r: Column, y: Column) -> Column:
        start, end = wall_clock(y, r["month"], r["first"]), wall_clock(y, r["month"], r["last"], F.lit("23"), F.lit("59"))
        return F.struct(start.alias("start"), end.alias("end"))

    open_ = lambda c: c["start"].isNotNull() & (c["end"] >= now - C.DAY)
    soon = lambda c: F.when(open_(c) & (c["start"] <= now + C.ANNOUNCE_DAYS * C.DAY), c)
    both = lambda r: F.coalesce(let(candidate(r, this), lambda c: F.when(open_(c), c)), let(candidate(r, this + 1), soon))
    return let(span, lambda r: F.when(r.isNotNull(), both(r)))


MONTH_WORDS = "|".join([*(m.replace("ç", "c") for m in C.MONTHS), *(m[:3] for m in C.MONTHS)])


def free_date(text: Column, ref: Column) -> Column:
    """struct(at, has_time): the date that a free text announces; null if it names none.

    Candidates are long dates with a year, days with a month alone (their year follows from epoch ``ref``), dotted
    or slashed dates, and short dates with a year, in this order. The first one that a time follows within 16
    characters is taken, else the first of the years 2020 to 2100, else the first.
    """
    return let(fold(text), lambda flat: _announced(flat, ref))


def _announced(flat: Column, ref: Column) -> Column:
    time = r"(?=([\s\S]{0,16}))"

    def found(pattern: str, groups: int, make) -> Column:
        lists = [F.regexp_extract_all(flat, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
        each = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(lists)])
        made = F.transform(each, lambda x: make(*[x.getField(f"g{i}") for i in range(groups)]))
        return F.when(flat.rlike(pattern), made).otherwise(F.array().cast("array<struct<y:int,m:int,d:int,h:int,mi:int>>"))

    def candidate(y: Column, m: Column, d: Column, h: Column, mi: Column) -> Column:
        return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), h.cast("int").alias("h"), mi.cast("int").alias("mi"))

    def followed(y: Column, m: Column, d: Column, after: Column) -> Column:
        time = F.array(*[F.regexp_extract(after, r"\b(\d{1,2})h(\d{0,2})\b", i) for i in (1, 2)])
        return let(time, lambda t: candidate(y, m, d, none(t[0]), F.when(t[0] != "", F.coalesce(none(t[1]), F.lit("0")))))

    none = lambda x: F.nullif(x, F.lit(""))
    long = found(
        rf"\b(\d{{1,2}})(?:\s+de)?\s+({MONTH_WORDS})\s+de?\s*(\d{{4}})\b(?:\s+as?\s*(\d{{1,2}})h(\d{{2}})?)?", 5,
        lambda d, m, y, h, mi: candidate(y, month_number(m), d, F.when(none(mi).isNotNull(), none(h)), F.when(none(h).isNotNull(), none(mi))),
    )
    first_day = lambda d: F.regexp_extract(d, r"\d{1,2}", 0)
    bare = found(
        rf"(\d{{1,2}}(?:\s*[,e]+\s*\d{{1,2}})*)\s*(?:de\s+)?({MONTH_WORDS})(?![\p{{L}}\x{{C0}}-\x{{24F}}])(?!\s*(?:de\s*)?\d{{4}}){time}", 3,
        lambda d, m, after: followed(resolve_year(month_number(m), first_day(d).cast("int"), ref), month_number(m), first_day(d), after),
    )
    dotted = found(rf"(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){time}", 4, lambda d, m, y, after: followed(y, m, d, after))
    short = found(rf"\b(\d{{1,2}})\s+({MONTH_WORDS})\s+(\d{{4}})\b{time}", 4, lambda d, m, y, after: followed(y, month_number(m), d, after))
    first = lambda every, test: F.try_element_at(F.filter(every, test), F.lit(1))
    best = lambda every: F.coalesce(first(every, lambda c: c["h"].isNotNull()), first(every, lambda c: c["y"].between(2020, 2100)), F.try_element_at(every, F.lit(1)))
    taken = let(F.concat(long, bare, dotted, short), best)
    at = lambda c: wall_clock(c["y"], c["m"], c["d"], c["h"].cast("string"), c["mi"].cast("string"))
    return let(taken, lambda c: F.when(c.isNotNull(), F.struct(at(c).alias("at"), c["h"].isNotNull().alias("has_time"))))


def date_sentence(text: Column) -> Column:
    """The sentence around a month's name, 120 characters at most, without leading signs; null without one."""
    names = "|".join([*C.MONTHS, "marco", *(m[:3] for m in C.MONTHS)])
    whole = F.regexp_extract(text, rf"(?i)[^.!?]*\b(?:{names})\b[^.!?]*", 0)
    return F.nullif(F.substring(F.trim(F.regexp_replace(whole, r"^[\s,;:—-]+", "")), 1, 120), F.lit(""))


def is_placeholder_time(c: Column) -> Column:
    return F.trim(c).isin(*C.PLACEHOLDER_TIMES)


def card_times(card_start: Column, card_end: Column, has_time: Column, detail_start: Column, detail_end: Column) -> Column:
    """struct(start, end): the listing's time if it is a real one, else the detail's, else the listing's day.

    An end before its start is dropped.
    """
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    timed = F.coalesce(has_time, F.lit(False))
    real = timed & given(card_start)
    own = F.when(given(card_end) & ~card_end.eqNullSafe(card_start), card_end)

    def choose(t: Column) -> Column:
        card, detail, end, late = (t[i] for i in range(4))
        start = F.coalesce(F.when(real, card), F.when(~real, detail), day_epoch(card_start))
        last = F.when(real & own.isNotNull(), end).when(late.isNotNull() & ~late.eqNullSafe(start), late).when(own.isNotNull(), F.when(timed, end).otherwise(day_epoch(own)))
        return F.struct(start.alias("start"), last.alias("end"))

    sane = lambda r: F.struct(r["start"].alias("start"), F.when(r["end"].isNull() | r["start"].isNull() | (r["end"] >= r["start"]), r["end"]).alias("end"))
    return let(let(F.transform(F.array(card_start, detail_start, own, detail_end), iso_epoch), choose), sane)


def is_default_time(start: Column, published: Column, modified: Column) -> Column:
    """The start's minute is that of publication or of the last change, so nobody typed it."""
    minute = lambda c: F.concat_ws(" ", captured(F.trim(c), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})", 1), captured(F.trim(c), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})", 2))
    own = F.nullif(minute(start), F.lit(""))
    return F.coalesce(own.isNotNull() & ((own == minute(published)) | (own == minute(modified))), F.lit(False))


def typed_start(start: Column, published: Column, modified: Column) -> Column:
    """Epoch of a start; a default time becomes midnight."""
    return F.when(is_default_time(start, published, modified), day_epoch(F.trim(start))).otherwise(strict_clock(start))


def last_second(day: Column) -> Column:
    """The last second of the day that an inclusive end date names by its midnight."""
    return day + (C.DAY - 1)


def last_minute(day: Column) -> Column:
    """23:59 of a day given by yyyy-MM-dd."""
    return wall_clock(F.substring(day, 1, 4), F.substring(day, 6, 2), F.substring(day, 9, 2), F.lit("23"), F.lit("59"))


def later_end(start: Column, end: Column) -> Column:
    """The end, or null if it is not after the start."""
    return F.when(end > start, end)


def run_label(t: Column, now: int) -> Column:
    """hoje, ontem or dd/MM of a run's Lisbon day, and its clock."""
    day, clock = lisbon_day(t), F.date_format(lisbon(t), "HH:mm")
    named = F.when(day == lisbon_day(F.lit(now)), "hoje").when(day == lisbon_day(F.lit(now - C.DAY)), "ontem").otherwise(F.date_format(lisbon(t), "dd/MM"))
    return F.concat_ws(", ", named, clock)
