"""Text features: tokenizers, controlled vocabularies, redaction, HTML, hashes. Column in, Column out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .clean import blank_to_null, c
from .detect import matches


def _lits(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


@cache
def _mark_table() -> tuple[str, str]:
    """For translate: every character that decomposes to an ASCII letter or digit and combining marks (U+0300 to U+036F) becomes that one; the marks, which come last, go."""
    marks = [chr(x) for x in range(0x300, 0x370)]
    found = []
    for code in range(0xC0, 0x30000):
        base, *rest = unicodedata.normalize("NFD", chr(code))
        if base.isascii() and base.isalnum() and all(x in marks for x in rest):
            found.append((chr(code), base))
    return "".join(x for x, _ in found) + "".join(marks), "".join(b for _, b in found)


def without_marks(x) -> Column:
    """Letters without their marks, in every script that has precomposed ones, and decomposed letters alike (what remains of NFD without U+0300 to U+036F, for ASCII bases)."""
    return F.translate(c(x), *_mark_table())


def tokens_ascii(x) -> Column:
    """Lower case, marks off letters, runs of a-z and 0-9 of two or more characters but stop words; repeats stay."""
    t = without_marks(F.lower(c(x)))
    words = F.split(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*V.STOP_A))


def mark_struct(x) -> Column:
    """A mark as (raw, lado, tokens): IZQ or DER by the first side word, and the set of its other words."""
    words = F.filter(F.split(F.upper(c(x)), "[^A-ZÁÉÍÓÚÑ0-9]+"), lambda w: w != "")
    left, right = V.SIDES_B["IZQ"], V.SIDES_B["DER"]
    side = F.get(F.filter(words, lambda w: w.isin(*left, *right)), F.lit(0))
    content = F.array_distinct(F.filter(words, lambda w: ~w.isin(*left, *right, *V.STOP_B)))
    return F.struct(c(x).alias("raw"), F.when(side.isin(*left), "IZQ").when(side.isin(*right), "DER").alias("lado"), content.alias("tokens"))


def split_marks(x) -> Column:
    """Segments between ; , line ends or the word y, trimmed, without empty ones."""
    parts = F.split(F.coalesce(c(x), F.lit("")), r"(?i)[;,\n]|(?<![A-Za-z0-9_])y(?![A-Za-z0-9_])")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def first_match(x, table, default: str | None = None) -> Column:
    t = c(x)
    out = F.lit(default).cast("string")
    for pattern, value in reversed(table):
        out = F.when(t.rlike(f"(?iu){pattern}"), value).otherwise(out)
    return out


def classify_mark(x, strict: bool = False) -> Column:
    """(feature_type, body_region, laterality, motif_category) from the vocabularies; strict takes sides as whole words."""
    sides = V.STRICT_SIDES if strict else V.SIDES
    return F.struct(first_match(x, V.TYPES, "otra_sena").alias("feature_type"), first_match(x, V.REGIONS, "generico").alias("body_region"), first_match(x, sides, "na").alias("laterality"), first_match(x, V.MOTIFS).alias("motif_category"))


def build_features(records: DataFrame, strict: bool = False) -> DataFrame:
    """One row per mark of a record: record_id, place, its classes, raw text and tokens."""
    marks = records.select(F.col("id").alias("record_id"), F.posexplode(split_marks("raw_description")).alias("place", "description_raw"))
    f = marks.withColumn("_c", classify_mark("description_raw", strict)).select("record_id", "place", "_c.*", "description_raw")
    return f.withColumn("tokens", tokens_ascii(F.concat_ws(" ", "description_raw", "body_region", "laterality", "motif_category")))


PHONE = r"(\+\d{1,3}[\s.-]?)?(?<![A-Za-z0-9_])\d{10}(?![A-Za-z0-9_])"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"


def redact_pii(x) -> Column:
    """(redacted_text, phone_count, email_count): e-mails are counted after telephone numbers were replaced."""
    t = c(x)
    no_phone = F.regexp_replace(t, PHONE, "[telefono_redactado]")
    return F.struct(F.regexp_replace(no_phone, EMAIL, "[email_redactado]").alias("redacted_text"), F.regexp_count(t, F.lit(PHONE)).alias("phone_count"), F.regexp_count(no_phone, F.lit(EMAIL)).alias("email_count"))


def copy_safety(x) -> Column:
    """(ok, forbidden_hits, uses_recommended)."""
    low = F.lower(c(x))
    hits = F.filter(_lits(V.FORBIDDEN), lambda p: F.contains(low, p))
    return F.struct((F.size(hits) == 0).alias("ok"), hits.alias("forbidden_hits"), F.exists(_lits(V.RECOMMENDED), lambda p: F.contains(low, p)).alias("uses_recommended"))


def strip_tags(x, collapse: bool = True) -> Column:
    t = F.regexp_replace(c(x), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style.*?</style>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " ")) if collapse else t


def artifact_text(title, markdown, html, json) -> Column:
    """The title and the first of markdown, stripped html and json that is given."""
    body = F.coalesce(blank_to_null(markdown), F.when(blank_to_null(html).isNotNull(), strip_tags(html)), blank_to_null(json))
    title = F.coalesce(c(title), F.lit(""))
    return F.when(body.isNull(), title).otherwise(F.trim(F.concat(title, F.lit("\n"), body), F.lit(" \t\r\n")))


def record_text(*parts, default: str = "sin datos") -> Column:
    filled = [blank_to_null(F.trim(F.replace(c(p), F.lit("<br>"), F.lit(", ")))) for p in parts]
    return F.coalesce(blank_to_null(F.concat_ws(" | ", *filled)), F.lit(default))


def location_phrase(x) -> Column:
    """Case and spaces as RE2 reads them: (?i) folds accented letters too, ſ is an s and the Kelvin sign a k, and \\v is no space. Java's (?i) and \\s don't, so classes are spelled out."""
    t = c(x)
    s, either = r"[\t\n\f\r ]", "A-Za-zſ\u212a"
    accents = "ÁÉÍÓÚÑáéíóúñ"
    name = rf"([{either}{accents}][{either}0-9_\t\n\f\r {accents}.-]{{2,%d}})"
    patterns = (
        rf"(?:en|por|desde|cerca de){s}+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:{s}*,{s}*[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)?)",
        rf"(?i)(?:colonia|fracc|fraccionamiento|barrio){s}+{name % 60}",
        rf"(?i)(?:e[sſ]tado|municipio|ciudad){s}+[de\t\n\f\r ]*{name % 40}",
    )
    return F.coalesce(*[blank_to_null(F.trim(F.regexp_extract(t, p, 1))) for p in patterns])


def tone_keywords(x, variant: str = "full", lowered: bool = False) -> Column:
    """Keywords of a text, or of a column that is lower-cased already. Nulls go by array_except, for which, unlike for a filter with a function, code is generated."""
    low = c(x) if lowered else F.lower(c(x))
    table = V.TONES if variant == "full" else V.SHORT_TONES
    return F.array_except(F.array(*[F.when(matches(low, p), k) for k, p in table]), F.array(F.lit(None).cast("string")))


def relative_date(x, now) -> Column:
    """Marks such as 3d or 2w: of those within their unit's limit the largest unit, then number, counts back from `now`."""
    found = F.regexp_extract_all(F.lower(c(x)), F.lit(r"(\d{1,2}[hdwmy])(?=[a-z\d\s]|$)"), F.lit(1))
    rank = F.create_map(*[F.lit(v) for pair in (("h", 1), ("d", 2), ("w", 3), ("m", 4), ("y", 5)) for v in pair])
    limit = F.create_map(*[F.lit(v) for pair in (("h", 23), ("d", 30), ("w", 52), ("m", 12), ("y", 10)) for v in pair])
    marks = F.transform(found, lambda m: F.struct(rank[F.right(m, F.lit(1))].alias("r"), F.regexp_extract(m, r"^(\d+)", 1).cast("int").alias("n"), limit[F.right(m, F.lit(1))].alias("most")))
    best = F.array_max(F.filter(marks, lambda m: m["n"] <= m["most"]))
    n, zero = best["n"], F.lit(0)
    part = lambda r, k=1: F.when(best["r"] == r, n * k).otherwise(zero)
    return F.when(best.isNotNull(), c(now) - F.make_interval(part(5), part(4), zero, part(2) + part(3, 7), part(1)))


def split_posts(df: DataFrame, text: str, keep: list[str], max_chars: int = 5000) -> DataFrame:
    """Page texts as posts: chunks between comment markers, over 20 characters; lines after a reaction line are comments."""
    chunks = df.select(*keep, F.posexplode(F.split(F.col(text), r"(?i)\nComment as |\nAnswer as ")).alias("idx", "chunk"))
    chunks = chunks.withColumn("chunk", F.trim("chunk")).where(F.length("chunk") > 20)
    lines = F.filter(F.transform(F.split("chunk", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ui = r"(?i)^(Like|Comment|Share|All reactions.*|Reply|View (more|all).*|\d+[dhw])$"
    marked = chunks.withColumn("lines", lines).withColumn("cut", F.expr(r"array_position(transform(lines, x -> x RLIKE '(?i)^(Like|Comment|Share|All reactions.*)$'), true)"))
    body = F.when(F.col("cut") > 0, F.expr("slice(lines, 1, cast(cut as int) - 1)")).otherwise(F.col("lines"))
    rest = F.when(F.col("cut") > 0, F.expr("slice(lines, cast(cut as int), size(lines))")).otherwise(F.array().cast("array<string>"))
    tidy = lambda a: F.filter(a, lambda x: ~x.rlike(ui))
    posts = marked.select(*keep, "idx", F.array_join(tidy(body), " ").alias("content"), tidy(rest).alias("comments")).where(F.length("content") >= 10)
    full = F.when(F.size("comments") > 0, F.concat("content", F.lit("\n\n[Comments: "), F.array_join("comments", " | "), F.lit("]"))).otherwise(F.col("content"))
    return posts.select(*keep, "idx", F.substring(full, 1, max_chars).alias("content"))


def content_hash(*cols) -> Column:
    return F.sha2(F.to_json(F.struct(*[c(x) for x in cols])), 256)


def idempotency_key(*cols) -> Column:
    """sha256 of the trimmed, lower-cased parts joined by U+001F; missing parts are empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.lower(F.trim(F.coalesce(c(x).cast("string"), F.lit("")))) for x in cols]), 256)


def flatten_search(df: DataFrame, keep: list[str], arrays: tuple[str, ...] = ("web", "news", "images")) -> DataFrame:
    """Result arrays of structs (url, link, title) as rows; url falls back to link; rows without either go."""
    each = [F.expr(f"transform({a}, x -> named_struct('kind', '{a}', 'url', coalesce(nullif(x.url, ''), nullif(x.link, '')), 'title', x.title))") for a in arrays]
    rows = df.select(*keep, F.inline(F.flatten(F.array(*each))))
    return rows.where("url IS NOT NULL")
