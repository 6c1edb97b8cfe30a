"""Offer signals, scores, extraction and validation. DataFrames in and out; patterns are data in the vocabulary."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .clean import blank_to_null, c

#: The first number of a text with what surrounds it.
#: The look ahead only tells where a match can begin, so that most places of a text cost one comparison.
SALARY = r"(?i)(?=[\s\d$mp])(\$|mxn|pesos)?\s*+(\d[\d.,]*)\s*(mil)?\s*(semanal|quincenal|mensual|al mes|por semana)?"
#: The same from its first digit on: a match holds the text's first digit, so what is before it is looked for only where it is shown.
AMOUNT = r"(?i)(\d[\d.,]*)\s*(mil)?\s*(semanal|quincenal|mensual|al mes|por semana)?"
#: Where an offer says that it is.
LOCATION = r"(?i)(?:en|ubicaci[oóÓ]n|zona)\s+([A-ZÁÉÍÓÚÑáéíóúñ][\wÁÉÍÓÚÑáéíóúñ\s.,-]{2,80})"
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def required_literal(p: str) -> str:
    """The longest run of plain characters that every match of the pattern holds; '' if none is certain."""
    bare, depth = "", 0
    for token in re.findall(r"\(|\||(?:\\.|\[[^\]]*\]|.)(?:[+*?]|\{[^}]*\})?", p, re.S):
        if token == "|" and not depth:
            return ""
        depth += (token == "(") - token.startswith(")")
        plain = not depth and len(token) == 1 and token not in "().^$|"
        bare += token if plain else "\0"
    return max(bare.split("\0"), key=len)


_TOKEN = re.compile(r"\(\?:|\(|\||(?:\\.|\[[^\]]*\]|.)(?:[+*?]\+?|\{[^}]*\})?", re.S)
_PLAIN = re.compile(r"[^\W_]|[ '-]")


def alternatives(p: str) -> list[str]:
    """What `|` parts a pattern into; a group that is the whole pattern is opened."""
    parts, depth, closed = [""], 0, False
    for token in _TOKEN.findall(p):
        if token == "|" and not depth:
            parts.append("")
            continue
        closed = closed or (not depth and parts[-1] != "")  # something stands beside the first group
        depth += token.startswith("(") - token.startswith(")")
        parts[-1] += token
    whole = len(parts) == 1 and not closed and p.endswith(")") and p.startswith("(") and p[1:2] != "?"
    return alternatives(p[1:-1]) if whole else parts


def _spelled(tokens: list[str], most: int = 4) -> list[str] | None:
    """The texts that plain characters and classes of them stand for; None if other tokens are there, or more texts than `most`."""
    out = [""]
    for token in tokens:
        letters = token if _PLAIN.fullmatch(token) else token[1:-1] if re.fullmatch(r"\[\w+\]", token) else token[1:] if re.fullmatch(r"\\\W", token) else ""
        if not letters or len(out) * len(letters) > most:
            return None
        out = [x + y for x in out for y in letters]
    return out


def needed(p: str) -> tuple[list[str], bool]:
    """Texts of which every match of the pattern (without `|` outside of groups) holds one, and whether each of them is a match; [""] if none is certain.

    A run of four characters that is spelled one way goes before those that are spelled in several ways or are shorter.
    """
    tokens = _TOKEN.findall(p)
    if exact := _spelled(tokens):
        return exact, True
    flat, depth = [], 0
    for token in tokens:
        inside = depth
        depth += token.startswith("(") - token.startswith(")")
        flat.append(None if inside or depth or token.startswith(")") else token)
    runs = [[""]]
    for i in range(len(flat)):
        for j in range(i + 1, len(flat) + 1):
            if None in flat[i:j] or (texts := _spelled(flat[i:j])) is None:
                break
            runs.append(texts)
    best = max(runs, key=lambda r: (len(r[0]) >= 4, -len(r) if len(r[0]) >= 4 else 0, len(r[0]), -len(r)))
    if best == [""] and (group := re.match(r"\(([^()?]*)\)(?![*?{])", p)):  # one of the texts of a first group
        inner = [needed(a) for a in alternatives(group[1])]
        best = [x for texts, _ in inner for x in texts] if all(exact for _, exact in inner) else best
    return best, False


def _regex(p: str) -> str:
    """The pattern as Java reads it; an edge before a first letter is looked for where that letter is."""
    p = re.sub(r"^\\b([a-z])(?![+*?{])", lambda m: f"{m[1]}(?<!{_WORD}{m[1]})", p)
    return p.replace(r"\b", _EDGE)


def matches(low: Column, p: str) -> Column:
    """Whether lower-cased text has a match. Each alternative runs as a pattern only where a text that it needs occurs, and those that are plain texts are looked up as such."""
    holds = lambda x: F.contains(low, F.lit(x))
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    needs = {a: needed(a) for a in alternatives(p)}
    texts = list(dict.fromkeys(x for found, exact in needs.values() if exact for x in found))
    plain = [x for x in texts if not any(y != x and y in x for y in texts)]
    rest = [some([holds(x) for x in found]) & low.rlike(_regex(a)) if found != [""] else low.rlike(_regex(a)) for a, (found, exact) in needs.items() if not exact]
    return some([holds(x) for x in plain] + rest)


def first_found(x: Column, low: Column, patterns: list[str]) -> Column:
    """The text that the first pattern with a match finds."""
    out = None
    for p in patterns:
        text = F.get(F.regexp_extract_all(x, F.lit(f"(?iu){p.replace(chr(92) + 'b', _EDGE)}"), F.lit(0)), F.lit(0))
        out = F.when(matches(low, p), text) if out is None else out.when(matches(low, p), text)
    return out


def _salary(t: Column, low: Column, amount: Column) -> Column:
    part = lambda i: F.regexp_extract(amount, AMOUNT, i)
    number = F.regexp_replace(part(1), "[,.]", "").try_cast("double") * F.when(part(2) != "", 1000).otherwise(1)
    any_number, found = amount != "", F.regexp_extract(t, SALARY, 0)
    return F.when(any_number & matches(low, r"gana\s+(lo\s+que|cuanto|lo q)"), "gana lo que quieras (vago)").when(any_number & F.contains(low, F.lit("semanal")) & (number >= 15000), F.concat(found, F.lit(" (semanal muy alto)"))).when(number >= 60000, F.concat(found, F.lit(" (inusual)")))


def offer_signals(df: DataFrame, text: str, area: str | None = None, state: str | None = None, interview: str | None = None, image: str | None = None) -> DataFrame:
    """Adds `hits`: array of (id, category, severity, evidence) in the catalogue's order.

    Texts are lower-cased once; literals decide which patterns run at all, and evidence is cut out of the original where one has matched.
    """
    t = F.coalesce(c(text), F.lit(""))
    place = F.concat_ws(" ", blank_to_null(interview), t) if interview else t
    df = df.withColumns({"_t": t, "_low": F.lower(t), "_place": place, "_number": F.regexp_extract(t, AMOUNT, 0)})
    # the text is lower-cased once
    df = df.withColumn("_low_place", F.concat_ws(" ", F.lower(blank_to_null(interview)), "_low") if interview else F.col("_low"))
    t, low = F.col("_t"), F.col("_low")
    listed = F.when(matches(low, V.BENEFITS), F.regexp_count(low, F.lit(V.BENEFITS))).otherwise(0)
    none = F.lit(None).cast("string")
    computed = {
        "salario_inusual": _salary(t, low, F.col("_number")),
        "prestaciones_excesivas": F.when(listed >= 4, F.concat(listed.cast("string"), F.lit(" prestaciones listadas"))),
        "contacto_otra_ciudad": F.when(blank_to_null(area) != blank_to_null(state), F.concat(F.lit("contacto "), c(area), F.lit(" vs oferta "), c(state))) if area and state else none,
        "diseno_generico": F.when(c(image), "(imagen presente — requiere revisión)") if image else none,
    }
    found = {i: computed[i] if ps is None else first_found(F.col("_place"), F.col("_low_place"), ps) if i == "ubicacion_sospechosa" else first_found(t, low, ps) for i, _, _, ps in V.SIGNALS}
    df = df.withColumns({f"_s_{i}": e for i, e in found.items()})
    hits = [F.when(F.col(f"_s_{i}").isNotNull(), F.struct(F.lit(i).alias("id"), F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.col(f"_s_{i}").alias("evidence"))) for i, cat, sev, _ in V.SIGNALS]
    return df.withColumn("hits", F.array_compact(F.array(*hits))).drop("_t", "_low", "_place", "_low_place", "_number", *[f"_s_{i}" for i in found])


def offer_score(df: DataFrame) -> DataFrame:
    """Adds score (0..100), level and recommendation from `hits`."""
    weight = lambda h: F.when(h["severity"] == "info", V.SEVERITY["info"]).when(h["severity"] == "medium", V.SEVERITY["medium"]).when(h["severity"] == "high", V.SEVERITY["high"]).otherwise(V.SEVERITY["critical"])
    df = df.withColumn("score", F.least(F.lit(100), F.aggregate(F.transform("hits", weight), F.lit(0), lambda a, x: a + x)))
    critical = F.exists("hits", lambda h: h["severity"] == "critical")
    level = F.when(critical | (F.col("score") >= 70), "CRÍTICO").when(F.col("score") >= 45, "ALTO").when(F.col("score") >= 20, "MEDIO").otherwise("BAJO")
    texts = {"CRÍTICO": "ALTO riesgo de reclutamiento forzado/fraude. No acudas sin verificar a la empresa en fuentes oficiales ni entregues documentos/dinero. Reporta a autoridades de búsqueda.", "ALTO": "Múltiples señales de alerta. Verifica la empresa (Google Maps, RFC), desconfía de entrevistas en terminales/hoteles, ve acompañado y comparte tu ubicación.", "MEDIO": "Algunas señales presentes. Confirma los datos de la empresa antes de aceptar.", "BAJO": "Pocas o ninguna señal. Aplica las precauciones habituales al buscar empleo."}
    df = df.withColumn("level", level)
    rec = F.lit(None).cast("string")
    for k, v in texts.items():
        rec = F.when(F.col("level") == k, v).otherwise(rec)
    return df.withColumn("recommendation", rec)


def contact_methods(x) -> Column:
    t, low = c(x), F.lower(c(x))
    has = lambda *words: reduce(lambda a, w: a | F.contains(low, F.lit(w)), words[1:], F.contains(low, F.lit(words[0])))
    tests = [("whatsapp", has("whatsapp", "whatapp", "wa.me")), ("telefono", t.rlike(r"(?<![A-Za-z0-9_])\d{10}(?![A-Za-z0-9_])")), ("email", F.contains(t, F.lit("@")) & t.rlike(r"(?i)[A-Z0-9._%+-]@[A-Z0-9.-]+\.[A-Z]{2,}")), ("dm", has("inbox", "dm", "mensaje directo"))]
    return F.array_compact(F.array(*[F.when(found, k) for k, found in tests]))


def offer_location(x) -> Column:
    """Where an offer says that it is; '' if nowhere."""
    return F.trim(F.regexp_extract(F.coalesce(c(x), F.lit("")), LOCATION, 1))


def extract_offer(df: DataFrame, text: str = "text") -> DataFrame:
    """Structured offers from scored posts: title, salary, place, contacts, signals, mechanism, flags and notes."""
    t = c(text)
    low = F.lower(t)
    ids = F.transform("hits", lambda h: h["id"])
    risky = F.col("score") >= 20
    words = ("vacante", "trabajo", "empleo")
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return df.withColumns({
        "is_job_offer": (F.size("hits") > 0) | named | F.contains(low, F.lit("sueldo")) | matches(low, "contrataci[oó]n"),
        "job_title": F.when(named, F.substring(F.trim(F.regexp_extract(t, r"(?i)(?:vacante|trabajo|empleo)\s+(?:de|para|como)?\s*([^\n.,;]+)", 1)), 1, 80)).otherwise(""),
        "salary_text": F.trim(F.regexp_extract(t, SALARY, 0)),
        "location_text": offer_location(t),
        "contact_methods": contact_methods(t), "risk_signals": ids,
        "possible_mechanism": F.when(F.col("score") >= 45, "reclutamiento_forzado_o_fraude").otherwise("sin_mecanismo_claro"),
        "confidence": F.col("score") / 100, "privacy_level": F.when(risky, "restricted").otherwise("internal"), "needs_review": risky, "notes": F.col("recommendation"),
    })


def extract_risk_event(df: DataFrame, text: str = "text") -> DataFrame:
    n = F.size("hits")
    risky = F.col("score") >= 20
    return df.withColumns({
        "event_type": F.when(risky, "oferta_laboral_sospechosa").otherwise("otro"), "estado": F.lit("sin_dato"), "municipio": F.lit("sin_dato"), "locality_approx": offer_location(text),
        "summary": F.when(n > 0, F.concat(F.lit("Oferta o reporte con "), n.cast("string"), F.lit(" senales de riesgo detectadas."))).otherwise("Reporte contextual sin senales suficientes."),
        "confidence": F.when(F.col("score") == 0, 0.3).otherwise(F.col("score") / 100), "privacy_level": F.when(risky, "restricted").otherwise("internal"), "needs_review": F.lit(True),
    })


def merge_validation(given: DataFrame) -> DataFrame:
    """Second look at offers that came with own fields (g_signals, g_confidence, g_privacy, g_review, g_notes): the detector can only tighten them."""
    ids = F.transform("hits", lambda h: h["id"])
    risky = F.col("score") >= 20
    notes = F.coalesce(blank_to_null("g_notes"), F.col("recommendation")) if "g_notes" in given.columns else F.col("recommendation")
    return given.withColumns({"risk_signals": F.array_union(F.coalesce("g_signals", F.array().cast("array<string>")), ids), "confidence": F.greatest(F.coalesce("g_confidence", F.lit(0.0)), F.col("score") / 100), "privacy_level": F.when(risky, "restricted").otherwise(F.col("g_privacy")), "needs_review": F.coalesce("g_review", F.lit(False)) | risky, "notes": notes})


def keyword_event(df: DataFrame, text: str) -> DataFrame:
    hits = F.regexp_count(c(text), F.lit(f"(?i){V.RISK_WORDS}"))
    df = df.withColumn("n_hits", hits)
    kind = F.when(F.col("n_hits") >= 2, "oferta_laboral_sospechosa").otherwise("otro")
    return df.withColumns({"event_type": kind, "confidence": F.least(0.3 + F.col("n_hits") * 0.1, F.lit(0.8)), "severity": F.when(kind.isin("secuestro_levanton", "trata_enganche"), 4).otherwise(2)})


def extraction_confidence(df: DataFrame, fields: list[str], kind: str, expected: int = 7) -> DataFrame:
    """Share of `expected` fields that are given, at most 1, to two decimals; low shares and kind 'otro' need review."""
    filled = sum((F.when(blank_to_null(F.col(f).cast("string")).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    conf = F.floor(F.least(filled / expected, F.lit(1.0)) * 100 + 0.5) / 100
    return df.withColumn("confidence", conf).withColumn("needs_review", (F.col("confidence") < 0.4) | F.col(kind).eqNullSafe("otro"))


def validate(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Adds `violations`: per rule of the spec (required, enum, min, max) the fields that break it, and columns the spec doesn't know."""
    out = []
    for name, rule in spec.items():
        if name not in df.columns:
            out += [F.lit(f"{name}: missing")] if rule.get("required") else []
            continue
        x = F.col(name)
        if rule.get("required"):
            out.append(F.when(blank_to_null(x.cast("string")).isNull(), f"{name}: required"))
        if "enum" in rule:
            out.append(F.when(x.isNotNull() & ~x.isin(*rule["enum"]), f"{name}: not allowed"))
        if "min" in rule:
            out.append(F.when(x < rule["min"], f"{name}: too small"))
        if "max" in rule:
            out.append(F.when(x > rule["max"], f"{name}: too large"))
    extra = [F.lit(f"{k}: unknown") for k in df.columns if k not in spec]
    return df.withColumn("violations", F.array_compact(F.array(*out, *extra)))


CONSENT_TYPES = ("authorized_group", "submitted_by_family", "submitted_by_partner")


def policy_gate(requests: DataFrame) -> DataFrame:
    """Requests with access_type, mode, allowed_actions (array), pii_requested, pii_allowed, has_consent, legal_basis, retention_days: the first reason to deny wins."""
    asked = F.coalesce("pii_requested", F.lit(False))
    reason = F.when(F.col("access_type") == "private_denied", "source is private or explicitly denied")
    reason = reason.when((F.col("access_type") == "unknown") & (F.col("mode") != "discovery_search"), "unknown sources require discovery review before acquisition")
    reason = reason.when(~F.expr("array_contains(allowed_actions, mode)"), F.concat(F.lit("mode '"), F.col("mode"), F.lit("' is not allowed for this source")))
    reason = reason.when(asked & ~F.coalesce("pii_allowed", F.lit(False)), "PII requested but source policy does not allow PII processing")
    reason = reason.when(asked & F.col("access_type").isin(*CONSENT_TYPES) & ~F.coalesce("has_consent", F.lit(False)), "PII processing requires active consent for this source type")
    reason = reason.when(asked & F.coalesce("legal_basis", F.lit("not_assessed")).isin("", "not_assessed"), "PII processing requires documented legal basis")
    df = requests.withColumn("denied", reason)
    return df.withColumns({"allowed": F.col("denied").isNull(), "reason": F.coalesce("denied", F.lit("allowed by source policy")), "privacy_level": F.when(F.col("denied").isNull() & ~asked, "internal").otherwise("restricted"), "retention_days": F.coalesce("retention_days", F.lit(30))}).drop("denied")
