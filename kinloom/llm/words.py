"""Words of dirty texts: markup, mis-encodings, case, accents and punctuation aside."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"<[^<>]{0,400}>")
BROKEN = re.compile("[Â-ô][\u0080-¿Œ-ŸŽžƒˆ˜–-›€™]{1,3}")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20f0]")
WORD = re.compile(r"[^\W_]+")
SINGLE_LETTER = re.compile("[øßæœłđðþ]")
SINGLE = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"})


def _mend(m: re.Match) -> str:
    raw = b""
    for c in m[0]:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return m[0]
            raw += bytes([ord(c)])
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def mended(text: str) -> str:
    """UTF-8 read as a one-byte encoding turned back, up to two layers; entities, tags and invisible characters gone."""
    for _ in range(2):
        if not BROKEN.search(text):
            break
        text = BROKEN.sub(_mend, text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else INVISIBLE.sub("", text)


def folded(text: str) -> str:
    """Lower case without accents, compatibility forms resolved."""
    if text.isascii():
        return text.lower()
    low = MARK.sub("", unicodedata.normalize("NFKD", text.lower()))
    return low.translate(SINGLE) if SINGLE_LETTER.search(low) else low


def words(text: str | None) -> list[str]:
    return WORD.findall(folded(mended(text))) if text else []
