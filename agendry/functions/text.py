"""Text normalisers as Column expressions; each has a twin in agendry.oracle for DuckDB."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, functions as F

from agendry import constants as C


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value bound once: a rule that reads it often neither repeats it in the plan nor computes it again."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def filled(c: Column) -> Column:
    """The text, or null for an empty one; inside a lambda ``nullif`` would compute it twice."""
    return let(c, lambda v: F.when(v != "", v))


@functools.cache
def _accents() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that lose their marks one to one, and those that become several."""
    one, to, many = [], [], []
    for i in range(0xC0, sys.maxunicode + 1):
        ch = chr(i)
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4 or not unicodedata.decomposition(ch) or unicodedata.decomposition(ch).startswith("<"):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not "̀" <= c <= "ͯ")
        if base == ch or i > 0xFFFF:
            continue
        if len(base) == 1:
            one.append(ch)
            to.append(base)
        elif not base:
            many.append((ch, base))
    return "".join(one), "".join(to), many


def strip_marks(c: Column) -> Column:
    """Canonical decomposition without U+0300-036F; letters such as ø and ß stay. Texts of ASCII alone have no marks."""
    one, to, _ = _accents()
    return let(c, lambda v: F.when(F.octet_length(v) == F.length(v), v).otherwise(F.translate(F.regexp_replace(v, "[̀-ͯ]", ""), one, to)))


def fold(c: Column) -> Column:
    return F.lower(strip_marks(c))


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def norm_title_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def norm_place(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), "[-_]+", " "), r"[\s\x{a0}]+", " "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(c), "['’\"|·•&]", ""), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def words(c: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def listed(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def norm_venue(c: Column) -> Column:

    def bare(flat: Column) -> Column:
        out = flat
        for p in reversed(C.VENUE_PREFIXES):
            out = F.when(flat.startswith(p), F.trim(F.substring(flat, F.lit(len(p) + 1), F.length(flat)))).otherwise(out)
        return out

    return let(F.trim(F.regexp_replace(c, r"\s+", " ")), bare)


def norm_city(c: Column) -> Column:
    base = norm_title(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)\s*", " "))
    kept = lambda b: F.array_join(F.filter(words(b), lambda w: ~w.isin(C.CITY_FILLERS)), " ")
    return let(base, lambda b: F.coalesce(F.nullif(kept(b), F.lit("")), b))


def venue_tokens(name: Column, city: Column) -> Column:
    """Sorted distinct words of a venue's name that tell it from others of its city."""
    return F.array_sort(_own_words(name, words(norm_city(city))))


def _own_words(name: Column, city_words: Column) -> Column:
    all_words = words(norm_title(norm_venue(F.coalesce(name, F.lit("")))))
    own = F.filter(all_words, lambda w: (F.length(w) >= 3) & ~w.isin([*C.VENUE_STOPWORDS, *C.GENERIC_VENUE_WORDS]))
    return F.array_distinct(F.array_except(own, city_words))


def is_vague(name: Column, city: Column) -> Column:
    return let(words(norm_city(city)), lambda ws: F.size(F.array_except(_own_words(name, ws), F.concat(listed(C.DISTRICT_WORDS), ws))) == 0)


def title_core(c: Column) -> Column:
    return F.array_distinct(F.filter(words(norm_title(c)), lambda w: ~w.isin(C.TITLE_NOISE) & ~w.rlike(r"^\d+$")))


def has_phrase(tokens: Column, phrase: Column | str) -> Column:
    """The phrase's words stand next to each other in the space-joined tokens."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat(F.lit(" "), tokens, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))) & (p != "")


def _from_code(n: Column, whole: Column, invalid: Column) -> Column:
    hexed = F.lpad(F.hex(n), 8, "0")
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(hexed), "UTF-32")).otherwise(invalid if invalid is not None else whole)


def decode_entities(c: Column, lenient: bool = False) -> Column:
    """Comments go; hexadecimal, then decimal, then named references are decoded; unknown ones stay.

    ``lenient`` drops references to no character and knows six names, in any case.
    """
    return let(c, lambda v: F.when(~F.contains(v, F.lit("&")) & ~F.contains(v, F.lit("<!--")), v).otherwise(_decoded(v, lenient)))


def _decoded(c: Column, lenient: bool) -> Column:
    def numeric(text: Column, pattern: str, base: int) -> Column:
        found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))

        def put(acc: Column, whole: Column) -> Column:
            digits = F.regexp_extract(whole, pattern, 1)
            n = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 7, F.conv(digits, base, 10).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
            return F.replace(acc, whole, let(n, lambda code: _from_code(code, whole, F.lit("") if lenient else whole)))

        return let(text, lambda t: F.when(F.contains(t, F.lit("&#")), F.aggregate(found(t), t, put)).otherwise(t))

    text = c if lenient else F.when(F.contains(c, F.lit("<!--")), F.regexp_replace(c, r"(?s)<!--.*?-->", "")).otherwise(c)
    text = numeric(text, "&#[xX]([0-9a-fA-F]+);", 16)
    text = numeric(text, "&#([0-9]+);", 10)
    names = {k: C.ENTITIES[k] for k in ("amp", "apos", "gt", "lt", "nbsp", "quot")} if lenient else C.ENTITIES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    # One pass over the references as they stand in the text: what one decodes to is not decoded again.
    parts = F.split(text, "&", -1)

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, "^([a-zA-Z]+);", 1)
        known = let(table[F.lower(name) if lenient else name], lambda value: F.concat(value, F.substring(part, F.length(name) + 2, F.length(part))))
        return F.when(i == 0, part).otherwise(F.coalesce(F.when(name != "", known), F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(parts, one), "")


#: What markup, a reference, or white space that does not stand as it should, looks like; texts without it are plain.
UNPLAIN = r"[<&\t\n\x0B\f\r\x{a0}]| [ ,.;:!?%)\]]|[(\[] "


def plain_text(c: Column) -> Column:
    return let(c, lambda v: F.when(~v.rlike(UNPLAIN), F.trim(v)).otherwise(_plain(v)))


def _plain(c: Column) -> Column:
    flat = F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]*>", " ")), r"[\s\x{a0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"\s+([,.;:!?%)\]])", "$1"), r"([(\[])\s+", "$1"))


def strip_tags(c: Column) -> Column:
    """Text of markup: script and style bodies go, block ends and line breaks part words."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")


def matches_keywords(text: Column, kws: Column) -> Column:
    folded = fold(F.coalesce(text, F.lit("")))
    return F.exists(kws, lambda k: F.contains(folded, fold(k)))


def slug_to_title(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, "[_-]+", " "), " ")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def title_venue(c: Column) -> Column:
    """What follows the last @, if something stands before it and it has 1 to 60 characters."""

    def after(c: Column) -> Column:
        right = F.trim(F.substring_index(c, "@", -1))
        left = F.trim(F.substring(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, "@", -1)) - 1))
        return F.when(F.contains(c, F.lit("@")) & (left != "") & F.length(right).between(1, 60), right)

    return let(c, after)


def haystack(*parts: Column) -> Column:
    return norm_title_ascii(F.concat_ws(" ", *parts))


def _known(c: Column, junk) -> Column:
    """The text, or null if it is empty or one of the junk values in any case and with any marks."""
    return let(c, lambda v: F.when((v != "") & ~F.trim(fold(v)).isin(*junk), v))


def prose_venue(text: Column) -> Column:
    """The venue that prose names after a pin, up to a stop phrase, else after "Local" and a sign; else the default."""
    stops = "|".join([*C.VENUE_STOPS, r"das \d+"])
    pinned = F.regexp_extract(text, r"[📌📍]\s*([^📌📍\n]+)", 1)
    named = F.trim(F.regexp_replace(F.trim(pinned), rf"(?iu)\s+(?={stops})[\s\S]*$", ""))
    clean = F.trim(F.regexp_replace(F.regexp_replace(named, r"[\s.…]*$", ""), r"^[\s.…]*", ""))
    local = F.trim(F.regexp_extract(text, r"(?i)Local\s*[:\-—]\s*([^.,\n]+)", 1))
    return F.coalesce(_known(clean, C.JUNK_VENUES), _known(local, C.JUNK_VENUES), F.lit(C.DEFAULT_VENUE))


def pick_venue(city: Column, *candidates: Column) -> Column:
    """The first candidate that is neither empty nor a placeholder, else the city."""
    usable = lambda v: (v != "") & ~F.lower(v).isin(*C.VENUE_PLACEHOLDERS) & ~v.rlike("^-+$")
    flat = F.transform(F.array(*candidates), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce(F.try_element_at(F.filter(flat, usable), F.lit(1)), city)


def usable_venue(c: Column) -> Column:
    """A venue's name, or null if it is empty or a country."""
    return let(F.trim(c), lambda v: F.when((v != "") & ~norm_place(v).isin(*C.COUNTRY_PLACEHOLDERS), v))


def is_feed_venue(slug: Column, venue: Column) -> Column:
    """The venue repeats the words of its feed's slug, or calls itself an agenda."""
    feed = venue_tokens(F.regexp_replace(slug, "[-/]", " "), F.lit(""))
    repeated = let(feed, lambda f: (F.size(f) > 0) & (F.size(F.array_except(f, venue_tokens(venue, F.lit("")))) == 0))
    return repeated | venue.rlike("(?i)agenda")


def source_id(prefix: str, url: Column, marker: str) -> Column:
    """The prefix and the decoded tail of a url after a marker, up to the next slash, query or fragment."""
    tail = F.try_url_decode(F.regexp_extract(url, marker + "(.*)$", 1))
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(F.coalesce(tail, F.lit("")), r"[/?#][\s\S]*$", ""))


def is_near_venue(slug: Column) -> Column:
    """A venue's slug holds one of the area's keywords."""
    bare = F.regexp_replace(slug, "^/+|/+$", "")
    return bare.rlike("|".join(C.VENUE_KEYWORDS))
