"""JSON documents against a nested schema: the schema becomes one expression over parsed variants, which lists what each document breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of a schema, as patterns of the type names of parsed values.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": r"^(BIGINT$|DECIMAL\(\d+,0\)$)", "null": "^VOID$"}

#: The two documents of extraction results: fixed values.
FAKE_JOB_OFFER = {
    "type": "object", "required": ["is_job_offer", "risk_signals", "confidence", "privacy_level"], "additionalProperties": False,
    "properties": {
        "is_job_offer": {"type": "boolean"}, "job_title": {"type": "string"}, "salary_text": {"type": "string"}, "location_text": {"type": "string"}, "contact_methods": {"type": "array", "items": {"type": "string"}},
        "risk_signals": {"type": "array", "items": {"type": "string"}}, "possible_mechanism": {"type": "string"}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "privacy_level": {"type": "string", "enum": ["internal", "restricted"]},
        "needs_human_review": {"type": "boolean"}, "notes": {"type": "string"},
    },
}
SOCIAL_RISK_EVENT = {
    "type": "object", "required": ["event_type", "estado", "municipio", "confidence", "privacy_level"], "additionalProperties": False,
    "properties": {
        "event_type": {"type": "string", "enum": ["oferta_laboral_sospechosa", "secuestro_levanton", "balacera_enfrentamiento", "trata_enganche", "narcomenudeo_contexto", "control_territorial_contexto", "otro"]},
        "estado": {"type": "string"}, "municipio": {"type": "string"}, "locality_approx": {"type": "string"}, "occurred_at": {"type": "string"}, "reported_at": {"type": "string"}, "summary": {"type": "string"},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "privacy_level": {"type": "string", "enum": ["public_aggregate", "internal", "restricted"]}, "needs_human_review": {"type": "boolean"},
    },
}

_NONE = "cast(array() as array<string>)"


def _cast(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _check(v: Column, node: dict, path: Column) -> Column:
    """array<string> of the rules of `node` that the value v (null: absent, and then nothing) breaks; nulls in it stand for rules kept."""
    out = []

    def rule(broken: Column, text: str):
        return F.when(broken, F.concat(path, F.lit(f": {text}")))

    kinds = node.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    fits = F.lit(True)
    if kinds:
        fits = _kind(v).rlike("|".join(_KINDS[k] for k in kinds))
        out.append(rule(~fits, f"not {' or '.join(kinds)}"))
    if "enum" in node:
        text = F.when(_kind(v) == "STRING", _cast(v, "string"))
        out.append(rule(fits & ~F.coalesce(text.isin(*[x for x in node["enum"] if isinstance(x, str)]), F.lit(False)), "not allowed"))
    number = F.when(_kind(v).rlike(_KINDS["number"]), _cast(v, "double"))
    out += [rule(number < node[k], "too small") for k in ("minimum",) if k in node] + [rule(number > node[k], "too large") for k in ("maximum",) if k in node]
    text = F.when(_kind(v) == "STRING", _cast(v, "string"))
    out += [rule(F.length(text) < node["minLength"], "too short")] if "minLength" in node else []
    out += [rule(F.length(text) > node["maxLength"], "too long")] if "maxLength" in node else []
    out += [rule(~text.rlike(node["pattern"]), "no match")] if "pattern" in node else []
    nested = []
    if "properties" in node or "required" in node or node.get("additionalProperties") is False:
        fields = F.when(_kind(v).startswith("OBJECT"), _cast(v, "map<string,variant>"))
        names = F.map_keys(fields)
        inner = lambda name: F.concat(path, F.lit(f".{name}"))
        out += [F.when(~F.array_contains(names, name), F.concat(inner(name), F.lit(": missing"))) for name in node.get("required", [])]
        nested += [_check(F.try_element_at(fields, F.lit(name)), sub, inner(name)) for name, sub in node.get("properties", {}).items()]
        if node.get("additionalProperties") is False:
            known = F.array(*[F.lit(x) for x in node.get("properties", {})]).cast("array<string>")
            nested.append(F.transform(F.array_sort(F.array_except(names, known)), lambda x: F.concat(path, F.lit("."), x, F.lit(": unknown"))))
    if "items" in node or "minItems" in node or "maxItems" in node:
        items = F.when(_kind(v).startswith("ARRAY"), _cast(v, "array<variant>"))
        out += [rule(F.size(items) < node["minItems"], "too few")] if "minItems" in node else []
        out += [rule(F.size(items) > node["maxItems"], "too many")] if "maxItems" in node else []
        if "items" in node:
            nested.append(F.flatten(F.transform(items, lambda x, i: _check(x, node["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    own = F.array(*out).cast("array<string>") if out else F.expr(_NONE)
    return F.when(v.isNull(), F.expr(_NONE)).otherwise(F.concat(own, *[F.coalesce(n, F.expr(_NONE)) for n in nested]))


def violations(document: str | Column, schema: dict) -> Column:
    """The rules that a JSON text breaks, as `$.path: what`, in the schema's order; a text that isn't JSON (or null) has the one `$: not JSON`.

    Known words of a schema: type, required, properties, additionalProperties (false), items, enum (of strings), minimum, maximum, minLength, maxLength, pattern, minItems,
    maxItems. A null value is of type null. One column expression, evaluated in the JVM; objects and arrays may nest as the schema does.
    """
    v = F.try_parse_json(document)
    return F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(F.array_compact(_check(v, schema, F.lit("$"))))
