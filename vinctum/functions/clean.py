"""Cleaning and conversion of registry fields: Column in, Column out. Bad values become null, never errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import STATE_REPAIRS


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    """The matchers treat an empty string as a missing value."""
    return F.nullif(c(x), F.lit(""))


def clean(x) -> Column:
    t = F.trim(c(x))
    return F.when(~t.isin("", "SIN DATO"), t)


def to_bool(x) -> Column:
    t = F.upper(F.trim(c(x)))
    return F.when(t == "SI", F.lit(True)).when(t == "NO", F.lit(False))


def to_int(x) -> Column:
    """Whole numbers; exponents aren't read."""
    t = F.trim(c(x))
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_extract(t, r"^([+-]?[0-9]+)", 1).try_cast("int"))


def digits_int(x) -> Column:
    return blank_to_null(F.regexp_replace(c(x), "[^0-9]", "")).try_cast("int")


def parse_dmy(x) -> Column:
    """D/M/YYYY as an ISO string, without a check of ranges."""
    p = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
    t = c(x)
    return F.when(t.rlike(p), F.concat_ws("-", F.regexp_extract(t, p, 3), F.lpad(F.regexp_extract(t, p, 2), 2, "0"), F.lpad(F.regexp_extract(t, p, 1), 2, "0")))


def parse_flex_date(x) -> Column:
    """A leading YYYY-MM-DD, else M/D/YYYY, read as D/M when the first number is over 12; impossible dates are null."""
    t = F.trim(c(x))
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    a, b, y = (F.regexp_extract(t, slash, i) for i in (1, 2, 3))
    swap = a.try_cast("int") > 12
    us = F.concat_ws("-", y, F.lpad(F.when(swap, b).otherwise(a), 2, "0"), F.lpad(F.when(swap, a).otherwise(b), 2, "0"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date")).when(t.rlike(slash), us.try_cast("date"))


def year_of(x, low: int, high: int) -> Column:
    y = F.regexp_extract(c(x), r"^(\d{4})", 1).try_cast("int")
    return F.when(y.between(low, high), y)


def age_at(birth, event) -> Column:
    b, e = c(birth), c(event)
    age = F.year(e) - F.year(b) - F.when(F.month(e) * 100 + F.day(e) < F.month(b) * 100 + F.day(b), 1).otherwise(0)
    return F.when(age.between(0, 100), age)


def age_bucket(age) -> Column:
    a = c(age)
    return F.when(a < 18, "0-17").when(a < 30, "18-29").when(a < 45, "30-44").when(a < 60, "45-59").when(a.isNotNull(), "60+")


def map_sex(x, strict: bool = False) -> Column:
    """M, F or X by the words found; strict: only the exact words, anything else is null."""
    t = c(x)
    if strict:
        low = F.lower(F.trim(t))
        return F.when(low.isin("hombre", "masculino", "m"), "M").when(low.isin("mujer", "femenino", "f"), "F")
    return F.when(t.rlike("(?iu)hombre|masculino"), "M").when(t.rlike("(?iu)mujer|femenino"), "F").when(t != "", "X")


def repair_state(x) -> Column:
    out = F.upper(F.trim(c(x)))
    for plain, written in STATE_REPAIRS:
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def parse_marks(x) -> Column:
    """Parts between <br>, trimmed, without empty ones and NINGUNA."""
    return F.filter(F.transform(F.split(F.coalesce(c(x), F.lit("")), "<br>"), lambda p: F.trim(p)), lambda p: (p != "") & (F.upper(p) != "NINGUNA"))


def parse_kv(x, drop_empty: bool = False) -> Column:
    """KEY: value parts between <br> as a map, split at the first colon; the last of equal keys wins."""
    parts = F.filter(F.split(F.coalesce(c(x), F.lit("")), "<br>"), lambda p: p.contains(":") & (F.trim(F.substring_index(p, ":", 1)) != ""))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    if drop_empty:
        pairs = F.filter(pairs, lambda e: e["value"] != "")
    return F.map_from_entries(last_of_keys(pairs))


def last_of_keys(entries: Column) -> Column:
    """Entries of which no later one has the same key: maps then need no duplicate-key policy."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))


def plausible_height(x) -> Column:
    return F.when(c(x).between(50, 230), c(x))


def height_cm(x, variant: str = "b") -> Column:
    """a: 'Estatura: 172 cm'; agent: the same, else a bare 140-199 cm; b: the first 2-3 digits after ESTATURA:, if 50..230."""
    t = c(x)
    if variant == "b":
        number = F.regexp_extract(t, r"ESTATURA:\s*([\d.,]+)", 1)
        return plausible_height(F.regexp_extract(number, r"(\d{2,3})", 1).try_cast("int"))
    first = F.regexp_extract(t, r"[Ee]statura[:\s]*(\d{3})\s*cm", 1).try_cast("int")
    if variant == "a":
        return first
    return F.coalesce(first, F.regexp_extract(t, r"(?<![A-Za-z0-9_])(1[4-9]\d)\s*cm(?![A-Za-z0-9_])", 1).try_cast("int"))


def display_name(*parts, default: str = "Sin nombre") -> Column:
    return F.coalesce(blank_to_null(F.concat_ws(" ", *[blank_to_null(F.trim(c(p))) for p in parts])), F.lit(default))


def record_key(*cols) -> Column:
    return F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in cols])


def to_record(personas: DataFrame, date_order: tuple[str, str] = ("fecha_hechos", "fecha_percato")) -> DataFrame:
    """Persona rows in the records' shape; the event date is the first of date_order that is given."""
    date = F.coalesce(*[blank_to_null(d) for d in date_order])
    return personas.select(F.concat(F.lit("persona-"), "id_victimadirecta").alias("id"), F.lit("missing").alias("record_type"), map_sex("sexo").alias("sex"), F.col("edad").alias("age_min"), F.col("edad").alias("age_max"), height_cm("media_filiacion", "b").alias("height_cm"), blank_to_null("estado").alias("estado"), date.alias("event_date"), F.array_join(parse_marks("sana_particular"), "; ").alias("raw_description"))


def detail(personas: DataFrame) -> DataFrame:
    """Parsed marks and attributes beside the raw fields."""
    return personas.select("id_victimadirecta", "sana_particular", "media_filiacion", parse_marks("sana_particular").alias("marks"), parse_kv("media_filiacion").alias("attributes"))


def flatten_notice(notices: DataFrame, posts: DataFrame) -> DataFrame:
    """Nested notices as flat rows with defaults, joined to their post by image; notices of kind 'otro' without a name go."""
    f = notices.select("image", "notice.*")
    out = f.join(posts, "image", "left").where("NOT (kind <=> 'otro' AND coalesce(trim(name), '') = '')")
    return out.select("image", "kind", F.col("name").alias("nombre"), F.coalesce("nationality", F.lit("mexicana")).alias("nacionalidad"), F.coalesce("confidence", F.lit(0.0)).alias("confianza"), F.coalesce("review", F.lit(True)).alias("requiere_revision"), "permalink", "author")
