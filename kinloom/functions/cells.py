"""Typed values from the many ways a literal is written; a text that leaves more than one value open gives none."""

from __future__ import annotations

import datetime
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinloom.functions.statements import unescape

QUOTED = re.compile(r'\s*"(.*)"(?:@([A-Za-z0-9_-]*)|\^\^\S*)?\s*\.?\s*', re.S)
MONTHS = {m: i + 1 for names in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar marz april mai juni juli august september oktober november dezember",
    "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
) for i, m in enumerate(names.split())} | {"sept": 9, "mrz": 3, "okt": 10, "dez": 12, "jänner": 1}
TRUE = {"true", "yes", "y", "t", "1", "ja", "oui", "si", "wahr", "vrai", "verdadero"}
FALSE = {"false", "no", "n", "f", "0", "nein", "non", "falsch", "faux", "falso"}
NUMBER = r"[+-]?[0-9]+(?:[.,][0-9]+)?|[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
COUNTED = {
    "num_tracks": re.compile(rf"(?:(?:tracks?|titel|titres?|pistas?)\s*:?\s*)?({NUMBER})(?:\s*(?:tracks?|songs?|titel|titres?|pistas?))?"),
    "number_of_pages": re.compile(rf"(?:(?:pp?\.?|pages?|seiten|s\.)\s*:?\s*)?({NUMBER})(?:\s*(?:pp?\.?|pages?|pgs?\.?|seiten?|s\.?|paginas?))?"),
}
METRES = {"": 1, "m": 1, "m.": 1, "metre": 1, "metres": 1, "meter": 1, "meters": 1, "metros": 1, "metro": 1, "km": 1000, "ft": Decimal("0.3048"), "feet": Decimal("0.3048"), "foot": Decimal("0.3048")}
ISO = re.compile(r"p(?:([0-9]+)d)?(?:t(?:([0-9]+)h)?(?:([0-9]+)m)?(?:([0-9]+(?:[.,][0-9]+)?)s)?)?")
SPOKEN = re.compile(r"(?:([0-9]+)\s*h(?:(?:ou)?rs?|ours?|\.)?)?\s*(?:([0-9]+)\s*m(?:in(?:s|ute[ns]?|uto?s)?)?\.?)?\s*(?:([0-9]+(?:[.,][0-9]+)?)\s*s(?:ec(?:s|onds?)?|ek(?:unden)?)?\.?)?")
CLOCK = re.compile(r"(?:([0-9]+):)?([0-9]{1,3}):([0-5][0-9])")
YMD = re.compile(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?:[T\s][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?\s*(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?", re.I)
COMPACT = re.compile(r"([0-9]{4})([0-9]{2})([0-9]{2})")
DMY = re.compile(r"([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})")
DAY_NAME = re.compile(r"([0-9]{1,2})(?:\.|st|nd|rd|th|er)?[\s-]+(?:de\s+)?([a-z]+)\.?,?[\s-]+(?:de\s+)?([0-9]{4})")
NAME_DAY = re.compile(r"([a-z]+)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})")


def lexical(t: str) -> tuple[str, str]:
    """Text and language tag of a literal, quoted or bare."""
    if m := QUOTED.fullmatch(t):
        return unescape(m[1]).strip(), (m[2] or "").lower()
    return t.strip().strip('"').strip(), ""


def plain(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))


def number(x: str, tag: str = "") -> Decimal | None:
    """The one number a text stands for: 1,234 is a thousand unless the tag writes decimals with a comma."""
    if not re.fullmatch(NUMBER, x):
        return None
    grouped = re.fullmatch(r"[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?", x)
    if grouped and tag[:2] not in ("de", "fr", "es"):
        return Decimal(x.replace(",", ""))
    return Decimal(x.replace(",", "."))


def _whole(x: Decimal | None) -> str | None:
    return str(int(x)) if x is not None and x == x.to_integral_value() and abs(x) < 2 ** 63 else None


def _day(y: str, m: int, d: str) -> str | None:
    try:
        return datetime.date(int(y), int(m), int(d)).isoformat()
    except ValueError:
        return None


def as_date(x: str, tag: str) -> str | None:
    if m := YMD.fullmatch(x):
        return _day(m[1], int(m[3]), m[4])
    if m := COMPACT.fullmatch(x):
        return _day(m[1], int(m[2]), m[3])
    if m := DMY.fullmatch(x):
        # dots put the day first; with others, every reading that is a date counts
        reads = {_day(m[4], int(m[3]), m[1])} if m[2] == "." else {_day(m[4], int(m[3]), m[1]), _day(m[4], int(m[1]), m[3])}
        reads.discard(None)
        return reads.pop() if len(reads) == 1 else None
    p = plain(x)
    if (m := DAY_NAME.fullmatch(p)) and m[2] in MONTHS:
        return _day(m[3], MONTHS[m[2]], m[1])
    if (m := NAME_DAY.fullmatch(p)) and m[1] in MONTHS:
        return _day(m[3], MONTHS[m[1]], m[2])
    return None


def as_boolean(x: str, tag: str) -> str | None:
    p = re.sub(r"^<?(?:https?://schema\.example/|schema:)|[/>]+$", "", plain(x))
    return "true" if p in TRUE else "false" if p in FALSE else None


def as_seconds(x: str, tag: str) -> str | None:
    p = plain(x)
    if (n := number(p, tag)) is not None:
        return _whole(n) if n >= 0 else None
    if m := CLOCK.fullmatch(p):
        return str(int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])) if not m[1] or int(m[2]) < 60 else None
    for pattern, units in ((ISO, (86400, 3600, 60, 1)), (SPOKEN, (3600, 60, 1))):
        if (m := pattern.fullmatch(p)) and any(g is not None for g in m.groups()) and not p.endswith("t"):
            return _whole(sum(Decimal(g.replace(",", ".")) * u for g, u in zip(m.groups(), units) if g))
    return None


def as_rating(x: str, tag: str) -> str | None:
    if re.fullmatch("★+☆*", x):
        n = Decimal(x.count("★"))
    else:
        m = re.fullmatch(rf"({NUMBER})(?:\s*(?:/|out of|von|sur|de)\s*(?:{NUMBER})|\s*(?:stars?|sterne|etoiles|estrellas))?", plain(x))
        n = number(m[1], tag) if m else None
    return f"{n:.1f}" if n is not None and abs(n) < 100 and n * 10 == (n * 10).to_integral_value() else None


def as_whole(x: str, tag: str, col: str, unit: str | None) -> str | None:
    p = plain(x)
    if unit == "metre":
        m = re.fullmatch(rf"({NUMBER})\s*([a-z]*\.?)", p)
        n = number(m[1], tag) if m and m[2] in METRES else None
        return _whole(n * METRES[m[2]]) if n is not None else None
    m = COUNTED[col].fullmatch(p) if col in COUNTED else re.fullmatch(f"({NUMBER})", p)
    return _whole(number(m[1], tag)) if m else None


def cell(col: str, kind: str, unit: str | None, t: str) -> str | None:
    x, tag = lexical(t)
    if kind == "string":
        return x or None
    if kind == "date":
        return as_date(x, tag)
    if kind == "boolean":
        return as_boolean(x, tag)
    if kind == "decimal(3,1)":
        return as_rating(x, tag)
    if kind == "bigint":
        return as_seconds(x, tag) if unit == "second" else as_whole(x, tag, col, unit)
    m = re.fullmatch(r"([+-]?(?:[0-9]+(?:[.,][0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)\s*°?\s*([nsew]?)", plain(x))
    n = float(m[1].replace(",", ".")) if m else None
    return None if n is None else repr(-n if m[2] in ("s", "w") and m[2] else n)


@F.pandas_udf(StringType())
def cell_column(col: pd.Series, kind: pd.Series, unit: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([cell(c, k, u if isinstance(u, str) else None, x) for c, k, u, x in zip(col, kind, unit, t)], dtype=object)
