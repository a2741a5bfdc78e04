"""Place, taxonomy and key functions; rosters are fixed dimensions of the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agendry import constants as C
from agendry.functions import text as T
from agendry.functions.dates import lisbon_day, lisbon_minute


def _norm(s: str) -> str:
    """Driver-side twin of norm_place for the rosters."""
    import re
    import unicodedata

    s = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower()
    return re.sub(r"\s+", " ", re.sub(r"[-_]+", " ", s)).strip()


MUNICIPALITY = {_norm(m): m for m in C.MUNICIPALITIES}
PARISH = {_norm(p): m for m, names in C.PARISHES.items() for p in names}
LOCALITIES = sorted({*PARISH, *C.GATE_PARISHES} - set(MUNICIPALITY))
NOWHERE = ["", "?", "n/d"]


def place_rows() -> list[tuple[str, str, str]]:
    """(norm, municipality, kind): a name, then an alias, then a parish wins."""
    known = {n: (m, "lugar") for n, m in PARISH.items()} | {n: (m, "concelho") for n, m in C.MUNICIPALITY_ALIASES.items()} | {n: (m, "concelho") for n, m in MUNICIPALITY.items()}
    return [(n, m, k) for n, (m, k) in sorted(known.items())]


def places(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(place_rows(), "norm string, municipality string, kind string"))


def with_municipality(df: DataFrame, city: str, out: str = "municipality") -> DataFrame:
    """Adds the municipality of a place name, null where the roster does not know it."""
    dim = places(df.sparkSession).select("norm", F.col("municipality").alias(out))
    return df.withColumn("_norm", T.norm_place(F.col(city))).join(dim, F.col("_norm") == F.col("norm"), "left").drop("_norm", "norm")


def in_district(city: Column) -> Column:
    known = lambda n: ~n.isin(NOWHERE) & (n.rlike("(^|[^a-z])leir") | n.isin([*MUNICIPALITY, *LOCALITIES]))
    return T.let(T.norm_place(F.coalesce(city, F.lit(""))), known)


def is_locality(city: Column) -> Column:
    n = T.norm_place(F.coalesce(city, F.lit("")))
    return ~n.isin(NOWHERE) & n.isin(LOCALITIES)


def known_venue(evidence: Column) -> Column:
    """The first curated venue whose name or alias stands in the evidence, or null."""
    hit = lambda tokens: F.coalesce(*[F.when(T.has_phrase(tokens, _norm_title(n)), F.lit(name)) for name, aliases, _ in C.KNOWN_VENUES for n in (name, *aliases)])
    return T.let(T.norm_title(F.coalesce(evidence, F.lit(""))), hit)


def in_scope(city: Column, venue: Column) -> Column:
    return in_district(city) | T.let(venue, lambda v: in_district(v) | known_venue(v).isNotNull())


def title_place(title: Column) -> Column:
    """The municipality that a title names: whole phrases first, then single words."""
    first = lambda tokens: F.coalesce(*[F.when(T.has_phrase(tokens, p), F.lit(MUNICIPALITY[p])) for p in (*C.TITLE_PHRASES, *C.TITLE_SINGLES)])
    return T.let(T.norm_title(F.coalesce(title, F.lit(""))), first)


def record_scope(name: Column) -> Column:
    """concelho, lugar or venue, by the first part of a record's name."""
    first = F.element_at(F.split(T.decode_entities(name, lenient=True), "[,/]"), 1)
    kind = lambda n: F.when(n.isin([*MUNICIPALITY, *C.MUNICIPALITY_ALIASES]), "concelho").when(n.isin(sorted(PARISH)), "lugar").otherwise("venue")
    return T.let(T.norm_place(F.trim(F.regexp_replace(first, r"\s*\([^)]*\)\s*$", ""))), kind)


def known_city(evidence: Column) -> Column:
    """The city of the first curated venue that the evidence names, or null."""
    return T.let(known_venue(evidence), lambda name: F.coalesce(*[F.when(name == n, F.lit(city)) for n, _, city in C.KNOWN_VENUES]))


def resolve_scope(title: Column, card_title: Column, city: Column, *venues: Column) -> Column:
    """struct(in_scope, city, venue) of a listing row; ``venues`` are its venue's names, the best first.

    The row's own city decides first, then a curated venue, then, if it has no city, a place in its title. A
    city of the district is kept; otherwise the curated venue's, else the first place named by venue or titles,
    else the row's own.
    """
    facts = F.struct(
        F.coalesce(*[T.usable_venue(v) for v in venues], T.title_venue(card_title)).alias("venue"), F.nullif(F.trim(F.coalesce(city, F.lit(""))), F.lit("")).alias("own"),
        known_city(card_title).alias("known"), F.coalesce(title_place(card_title), title_place(title)).alias("named"),
    )
    seen = lambda f: F.struct(f["venue"].alias("venue"), f["own"].alias("own"), F.coalesce(known_city(f["venue"]), f["known"]).alias("known"), f["named"].alias("named"), in_district(f["own"]).alias("inside"))

    def scope(f: Column) -> Column:
        scoped = f["inside"] | in_scope(F.lit(None).cast("string"), f["venue"]) | f["known"].isNotNull() | (f["own"].isNull() & f["named"].isNotNull())
        resolved = F.coalesce(F.when(f["inside"], f["own"]), f["known"], title_place(f["venue"]), f["named"], f["own"])
        return F.struct(scoped.alias("in_scope"), F.when(scoped, resolved).alias("city"), f["venue"].alias("venue"))

    return T.let(T.let(facts, seen), scope)


def is_outside(place: Column) -> Column:
    """A concelho outside the district that listings name."""
    return T.norm_place(place).isin([_norm(c) for c in C.OUTSIDE_CONCELHOS])


def tail_city(venue: Column, default: str) -> Column:
    """struct(venue, city): the part after the last comma is the city if it is a known place, in or out of the district.

    An unknown venue ("a definir", "a confirmar", nothing) is the default city itself.
    """

    def parted(raw: Column) -> Column:
        unknown = (raw == "") | raw.rlike(r"(?i)^a\s*(definir|confirmar)$")
        parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
        city = T.let(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), lambda last: F.when(~unknown & (in_district(last) | is_outside(last)), last).otherwise(default))
        return F.struct(F.when(unknown, default).otherwise(raw).alias("venue"), city.alias("city"))

    return T.let(F.trim(F.coalesce(venue, F.lit(""))), parted)


def category_rows() -> list[tuple[str, str, int]]:
    """(norm, label, rank) of every label that the taxonomy covers; a dropped one has no label."""

    rank = {c: i for i, c in enumerate(C.CATEGORIES)}
    rows = {_norm_title(c): [c] for c in C.CATEGORIES}
    rows |= {_norm_title(a): list(to) for a, to in C.CATEGORY_ALIASES.items()}
    out = [(n, c, rank[c]) for n, labels in rows.items() for c in labels]
    return out + [(_norm_title(d), None, 0) for d in C.DROPPED_CATEGORIES]


def _norm_title(s: str) -> str:
    import re
    import unicodedata

    s = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower()
    return re.sub(r"[\W_]+", " ", s).strip()


def canonical_categories(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, categories): taxonomy labels in its order, then unknown labels as they came, in Portuguese order."""
    dim = F.broadcast(df.sparkSession.createDataFrame(category_rows(), "norm string, label string, rank int"))
    each = df.select(key, F.explode_outer(labels).alias("raw")).withColumn("_n", T.norm_title(F.coalesce("raw", F.lit(""))))
    met = each.join(dim, F.col("_n") == F.col("norm"), "left")
    label = F.when(F.col("_n") == "", None).when(F.col("norm").isNull(), F.col("raw")).otherwise(F.col("label"))
    named = met.select(key, label.alias("label"), F.coalesce("rank", F.lit(len(C.CATEGORIES))).alias("rank"))
    entries = F.collect_set(F.when(F.col("label").isNotNull(), F.struct("rank", "label")))
    ordered = F.array_sort(F.transform(entries, lambda s: F.struct(s["rank"].alias("rank"), F.collate(s["label"], "pt").alias("order"), s["label"].alias("label"))))
    return named.groupBy(key).agg(F.transform(ordered, lambda s: s["label"]).alias("categories"))


def unmapped_labels(labels: DataFrame) -> DataFrame:
    """(label, count) of labels that no table covers."""
    dim = F.broadcast(labels.sparkSession.createDataFrame([(n,) for n, _, _ in category_rows()], "norm string").distinct())
    n = T.norm_title(F.col("label"))
    return labels.withColumn("norm", n).where("norm <> ''").join(dim, "norm", "left_anti").groupBy("label").agg(F.count("*").alias("count"))


#: Rules of single listings, in their order: the first that a text meets gives its category.
FAIR_RULES = (("(?i)^feira", "Mercados e Feiras"), ("(?i)mercado", "Mercados e Feiras"), ("(?i)festival", "Festivais"))
TOWN_RULES = (
    ("exposi|mostra|colec", "Exposições"),
    (r"festival|folio|\bfol\b|semana", "Festivais"),
    ("mercado|feira", "Mercados e Feiras"),
    ("oficina|atelier|atelie|workshop|kamishi", "Oficinas"),
    ("festa|romaria", "Tradição"),
)
KIND_RULES = (("festa", "Festas"), ("oxigenio", "Atividades ao Ar Livre"))


def by_rules(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def fair_category(title: Column) -> Column:
    """Category of a listing of fairs and feasts."""
    return by_rules(title, FAIR_RULES, "Tradição")


def town_category(title: Column) -> Column:
    """Category of a town's agenda, whatever the title's marks and case."""
    return by_rules(T.norm_place(title), TOWN_RULES, "Outros")


def kind_category(kind: Column) -> Column:
    """Category of a newspaper's kinds of entry."""
    return by_rules(F.lower(kind), KIND_RULES, "Agenda")


def genre_categories(genre: Column) -> Column:
    """The label of a hub's genre; none for genres that mean none."""
    table = F.create_map(*[F.lit(x) for pair in C.GENRE_CATEGORIES.items() for x in pair])
    label = table[F.lower(F.trim(genre))]
    return F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>"))


def drop_pseudo(categories: Column) -> Column:
    """Categories without those that name a channel."""
    return F.filter(categories, lambda c: ~c.isin(*C.PSEUDO_CATEGORIES))


def fingerprint(title: Column, venue: Column, start: Column) -> Column:
    return F.sha1(F.concat_ws("|", T.norm_title(title), T.slugify(T.norm_venue(F.coalesce(venue, F.lit("")))), lisbon_minute(start)))


def fingerprint_undated(title: Column, venue: Column) -> Column:
    return F.sha1(F.concat_ws("|", T.norm_title(title), T.slugify(T.norm_venue(F.coalesce(venue, F.lit("")))), F.lit("UNDATED")))


def day_key(title: Column, start: Column) -> Column:
    return F.concat_ws("|", T.norm_title(title), lisbon_day(start))


def identity_key(title: Column, venue: Column, start: Column) -> Column:
    return F.concat_ws("|", T.norm_title(title), T.slugify(F.coalesce(venue, F.lit(""))), lisbon_day(start))


def public_slug(title: Column, print_: Column) -> Column:
    s = T.slugify(title)
    return F.concat_ws("-", F.when(s == "", "evento").otherwise(s), F.left(print_, F.lit(12)))


def trust(source: Column) -> Column:
    """Place of a source in the order of trust; others come after the last."""
    at = F.array_position(F.array(*[F.lit(s) for s in C.TRUST]), F.coalesce(source, F.lit(""))).cast("int")
    return F.when(at == 0, len(C.TRUST)).otherwise(at - 1)
