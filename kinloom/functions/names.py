"""Names of records: one spelling for each IRI, entity and blank node, as JVM-side column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_BASE = "http://www.wikidata.example/entity/"
# A graph 2 entity in any spelling: bare, prefixed, or an IRI of the entity base with any path before the Q number.
ENTITY_PATTERN = r"(?i)^(?:[a-z]+:|https?://(?:www\.)?wikidata\.example/(?:[a-z]+/)*)?(q[0-9]+)/*$"
# What stands for "no identifier" after brackets and outer space are gone.
MISSING_NAMES = ["", "_:", "-", "?", "n/a", "na", "none", "null", "nil", "unknown", "undefined"]


def unwrap(c: Column) -> Column:
    """Without outer white space and angle brackets."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s<]+", ""), r"[\s>]+$", "")


def record_name(c: Column) -> Column:
    """The one name of a record, or null if the value holds no identifier.

    Blank nodes stay as they are, entities become ENTITY_BASE + Q number, page IRIs get ``http``, a lower-case host and
    no final slash. Null, blank and placeholder values, a bare ``_:`` and an entity path without number are null.
    """
    u = unwrap(c)
    q = F.upper(F.regexp_extract(u, ENTITY_PATTERN, 1))
    host = F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#]+)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"(?i)^https?://[^/?#]+", ""), r"/+$", "")
    number_missing = u.rlike(r"(?i)^https?://(?:www\.)?wikidata\.example(?:/(?:entity|wiki)?)?/*$")
    return (
        F.when(u.isNull() | F.lower(u).isin(MISSING_NAMES) | number_missing, F.lit(None).cast("string"))
        .when(u.startswith("_:"), u)
        .when(q != "", F.concat(F.lit(ENTITY_BASE), q))
        .when(host != "", F.concat(F.lit("http://"), host, rest))
        .otherwise(u)
    )


ENTITY = re.compile(ENTITY_PATTERN)
HOST = re.compile(r"^https?://([^/?#]+)(.*)$", re.I | re.S)
NO_NUMBER = re.compile(r"^https?://(?:www\.)?wikidata\.example(?:/(?:entity|wiki)?)?/*$", re.I)


@lru_cache(maxsize=50_000)
def record_name_of(text: str) -> str | None:
    """record_name for one value, for maps that see every row anyway."""
    if text.startswith("_:") and len(text) > 2 and text[-1] not in "> \t\r\n":
        return text
    u = re.sub(r"[\s>]+$", "", re.sub(r"^[\s<]+", "", text))
    if u.lower() in MISSING_NAMES or NO_NUMBER.match(u):
        return None
    if u.startswith("_:"):
        return u
    if m := ENTITY.match(u):
        return ENTITY_BASE + m[1].upper()
    if m := HOST.match(u):
        return "http://" + m[1].lower() + re.sub(r"/+$", "", m[2])
    return u


@lru_cache(maxsize=10_000)
def schema_term_of(text: str, base: str = "http://schema.example/", prefix: str = "schema:") -> str:
    """schema_term for one value."""
    u = re.sub(r"[\s>]+$", "", re.sub(r"^[\s<]+", "", text))
    u = base + u[len(prefix):] if u.lower().startswith(prefix) else u
    return re.sub(r"/+$", "", re.sub(r"^https://", "http://", u.lower()))


def predicate_name(c: Column) -> Column:
    """A predicate in one spelling: no brackets, outer space or final slash, ``http``, all lower case."""
    u = F.lower(unwrap(c))
    return F.regexp_replace(F.regexp_replace(u, r"^https://", "http://"), r"/+$", "")


def schema_term(c: Column, base: str = "http://schema.example/", prefix: str = "schema:") -> Column:
    """predicate_name with the vocabulary's prefix written out."""
    return predicate_name(F.regexp_replace(unwrap(c), f"^(?i){prefix}", base))


def literal_text(c: Column) -> Column:
    """Lexical form of an RDF-ish literal: quotes, language tag and datatype removed, escapes kept; bare values as is."""
    quoted = F.regexp_extract(c, r'^\s*"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9_-]*|\^\^\S*)?\s*\.?\s*$', 1)
    return F.when(c.rlike(r'^\s*"'), F.when(quoted != "", quoted).otherwise(F.regexp_replace(c, r'^\s*"|"[^"]*$', ""))).otherwise(F.trim(c))


def literal_tag(c: Column) -> Column:
    """Language tag of a quoted literal in lower case, '' if none."""
    return F.lower(F.regexp_extract(c, r'"@([A-Za-z0-9-]+)\s*\.?\s*$', 1))
