"""One line of a dump as one N-Triples or N-Quads statement: its terms, or the reason why it has none."""

from __future__ import annotations

import calendar
import re

FIELDS = ["s", "p", "o", "g", "reason"]
XSD = "http://www.w3.example/2001/XMLSchema#"
UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
IRI = rf'<[A-Za-z][A-Za-z0-9+.\-]*:(?:[^\x00-\x20<>"{{}}|^`\\]|{UCHAR})*>'
_U = (r"A-Za-z0-9_:\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C\u200D\u2070-\u218F"
      r"\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF")
_C = _U + r"\u00B7\u0300-\u036F\u203F\u2040\-"
BLANK = rf"_:[{_U}](?:[{_C}.]*[{_C}])?"
LITERAL = rf'"(?:[^"\\\r\n]|\\[tbnrf"\'\\]|{UCHAR})*"(?:\^\^{IRI}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
STATEMENT = re.compile(
    rf"[ \t]*({IRI}|{BLANK})[ \t]*({IRI})[ \t]*({IRI}|{BLANK}|{LITERAL})[ \t]*(?:({IRI}|{BLANK})[ \t]*)?\.[ \t]*(?:#[^\r\n]*)?[\r\n]*")
ESCAPE = re.compile(rf'{UCHAR}|\\([tbnrf"\'\\])')
CONTROL = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
TYPED = re.compile(r'"(.*)"\^\^<(.*)>', re.S)

ZONE = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
DATE = r"(-?(?:[1-9][0-9]{3,}|0[0-9]{3}))-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
LEXICAL = {
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "double": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "boolean": r"true|false|1|0",
    "date": DATE + ZONE,
    "dateTime": DATE + "T" + TIME + ZONE,
}
LEXICAL = {k: re.compile(v) for k, v in LEXICAL.items()}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return CONTROL.get(m[1], m[1])
        code = int(m[0][2:], 16)
        return chr(code) if code < 0x110000 else "\ufffd"
    return ESCAPE.sub(one, text) if "\\" in text else text


def in_type(text: str, kind: str) -> bool:
    """Whether a lexical form belongs to an XSD type of LEXICAL, days of the month included."""
    m = LEXICAL[kind].fullmatch(text)
    if not m or not kind.startswith("date"):
        return m is not None
    year, month, day = (int(x) for x in m.groups()[:3])
    return day <= (29 if month == 2 and calendar.isleap(year) else 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)


def parse_line(line: str | None) -> tuple:
    """(s, p, o, g, reason): terms as written and no reason, or a reason; all null for blank lines and comments."""
    if line is None or not (text := line.strip()) or text.startswith("#"):
        return None, None, None, None, None
    m = STATEMENT.fullmatch(line)
    if not m:
        return None, None, None, None, "grammar"
    if (t := TYPED.fullmatch(m[3])) and (kind := unescape(t[2])).startswith(XSD):
        kind = kind[len(XSD):]
        if kind in LEXICAL and not in_type(unescape(t[1]), kind):
            return None, None, None, None, f"not a {kind}"
    return *m.groups(), None
