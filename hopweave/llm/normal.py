"""Folding of texts to plain words: case, spacing, punctuation, quoting, markup, accents, encoding."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other alphabets that look like Latin ones, one to one.
_ALIKE = dict(zip("асеорхуіјѕԁһкмтвнԛԝɡɑοαιντκρχυςεγ", "aceopxyijsdhkmtbhqwgaoaivtkpxyseg", strict=False))
ALIKE = str.maketrans({k: v for k, v in _ALIKE.items() if ord(k) > 0x2FF and k not in "ςεγαντρ"})
# Letters that do not decompose.
_PLAIN = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i"})

# what stands in a tag: attributes of any length, or anything short
_INSIDE = r"(?:(?:\s+[^\s=<>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?|[^<>]{0,200})>"
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|blockquote|pre)\b" + _INSIDE, re.I)
_TAG = re.compile(r"</?(?:[a-zA-Z][a-zA-Z0-9:-]*" + _INSIDE + r"|[a-zA-Z!][^<>]{0,200}>)")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n[\s>|*]*(?=[^\W\d_])")
# marks that combine with a letter, and characters without width
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\xad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]+")
_INNER = re.compile(r"(?<=\w)['’ʼ‘`´](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MOJI = re.compile("[ÂÃÄÅ][\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]?")


_ENTITY = re.compile(r"&[A-Za-z]{2,31};")


def _entity(m: re.Match) -> str:
    """A named character whose name was written in another case."""
    s = html.unescape(m.group())
    return s if s != m.group() else html.unescape(m.group().lower())


def _mend(m: re.Match) -> str:
    s = m.group()
    raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252", "replace") for c in s)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return s


def mended(text: str) -> str:
    """Undoes UTF-8 that was read as a one-byte encoding, once or twice."""
    for _ in range(2):
        if not any(c in text for c in "ÂÃÄÅâ"):
            break
        fixed = _MOJI.sub(_mend, text)
        if fixed == text:
            break
        text = fixed
    return text


def plain(text: str | None, cased: bool = False) -> str:
    """Text without markup, accents, odd encoding and case; words may still have punctuation between."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(html.unescape(_ENTITY.sub(_entity, text)))
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "\n" in text and ("-" in text or "‐" in text or "\xad" in text):
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", mended(text)))
        if not text.isascii():
            text = (text if cased else text.lower()).translate(_PLAIN).translate(ALIKE)
    return _INNER.sub("", text if cased else text.lower())


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text))
