"""Normalisation of values, keys and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that are never indexed, and statuses that say "not exposed".
DENIED_KEYS = ("nationality", "gender", "sex", "country", "document_type", "issuer", "issuing_authority", "issuing_country")
NOT_EXPOSED = ("", "no", "none", "false", "not a pep", "n/a", "-")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_value(c: Column) -> Column:
    """Blanks collapsed, lower case; separators dropped if there is a digit; nothing left is null."""
    v = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return blank_to_null(F.when(v.rlike(r"\p{Nd}"), F.regexp_replace(v, r"[\s\-/.]", "")).otherwise(v))


def is_eligible(key: Column, value: Column) -> Column:
    return ~F.lower(F.trim(key)).isin(*DENIED_KEYS) & (F.length(value) >= 3) & ~value.rlike(r"^\d{4}$")


def value_vid(value: Column) -> Column:
    return F.concat(F.lit("value:"), F.substring(F.sha1(value), 1, 32))


def classify_pep(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s.isNull() | s.isin(*NOT_EXPOSED), F.lit(None)).when(s.rlike("family|associate|relative|spouse|rca"), "associate").otherwise("self")


def sanitize_identifier(text: Column, fallback: str) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(text, r"\W+", "_"), "^_+|_+$", ""))
    s = F.coalesce(blank_to_null(s), F.lit(fallback))
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def normalize_identifier(c: Column) -> Column:
    """National ids, passports, account numbers: blanks and hyphens dropped, upper case."""
    return F.upper(F.regexp_replace(c, r"[\s\-]", ""))


def normalize_email(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when(e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), e)


def deterministic_key(entity_type: Column, props: dict[str, Column]) -> Column:
    """The key that identifies an entity for certain, or null."""
    raw = lambda name: props.get(name, F.lit(None).cast("string"))
    got = lambda name: blank_to_null(normalize_identifier(raw(name)))
    kind = F.coalesce(blank_to_null(F.upper(F.trim(raw("document_type")))), F.lit("DOCUMENT"))
    return (
        F.when(entity_type == "Person", F.concat(F.lit("national_id:"), got("national_id")))
        .when(entity_type == "Email", F.concat(F.lit("email:"), normalize_email(raw("address"))))
        .when(entity_type == "Phone", F.concat(F.lit("phone:"), got("number")))
        .when(entity_type == "Document", F.concat(F.lit("document:"), kind, F.lit(":"), got("number")))
        .when(entity_type == "BankAccount", F.concat(F.lit("account:"), F.coalesce(*[blank_to_null(F.upper(F.regexp_replace(raw(n), r"\s", ""))) for n in ("iban", "account_number")])))
        .when(entity_type == "Vehicle", F.concat(F.lit("vehicle:"), blank_to_null(F.regexp_replace(F.upper(F.coalesce(blank_to_null(raw("plate")), raw("registration"))), "[^A-Z0-9]", ""))))
        .when(entity_type == "Country", F.concat(F.lit("country:"), got("iso2")))
    )


def coerce(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, is it an error): blanks are null and right; a bool is never an error."""
    if kind == "bool":
        return F.when(F.trim(raw) != "", F.lower(F.trim(raw)).isin("true", "yes")), F.lit(False)
    value = raw.try_cast({"int": "bigint", "float": "double"}.get(kind, "string"))
    return value, (F.trim(raw) != "") & value.isNull()
