"""Plain words of texts in any writing: markup, escapes, broken encoding, look-alike letters and hidden characters undone."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁɡһԛԝьАВЕКМНОРСТУХІЈЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧı",
    "abekmhopctyxijsdghqwbABEKMHOPCTYXIJSaveikvoptuxABEZHIKMNOPTYXi",
)
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt])|\\([\"'/\\])")
_INLINE = re.compile(r"</?(?:b|i|em|strong|span|a|u|s|mark|small|sub|sup|font|wbr|code)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*(?:\r\n|\r|\n)[>\s]*(?=[^\W\d_])")
#: What a line-end hyphen and misread UTF-8 can't do without; both are rare, and these are quick to look for.
_HYPHEN = re.compile(r"-[ \t]*[\r\n]")
_MISREAD = re.compile("[ÃÂÅâðÐ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_GROUPED = re.compile(r"(?<=\d)[.,’'\s](?=\d{3}(?!\d))")
_WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans({"ø": "o", "æ": "a", "ß": "ss", "đ": "d", "ł": "l", "œ": "o", "ð": "d", "þ": "th"})
_DIGRAPH = re.compile(r"aa|ae|oe")


def _repaired(m: re.Match) -> str:
    """Text that was UTF-8 and read as a one-byte encoding."""
    s = m[0]
    if not any("\x80" <= c <= "\xff" for c in s) or not any(c in s for c in "ÃÂÅâðÐ"):
        return s
    try:
        return bytes(b for c in s for b in (c.encode("cp1252", "ignore") or c.encode("latin-1"))).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return s


def unescape(text: str) -> str:
    """The text without markup, escapes, hidden characters and line-end hyphens, with its encoding repaired."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " " if m[3] else m[4], text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if _HYPHEN.search(text):
        text = _BREAK.sub("", text)
    if not text.isascii():
        if _MISREAD.search(text):
            text = _NOT_ASCII.sub(_repaired, text)
        text = _HIDDEN.sub("", text)
    return text


def folded(text: str) -> str:
    """Lower case, composed compatibility characters, look-alikes Latin, accents off."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(LOOKALIKES)
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.casefold()
    if not text.isascii():
        text = text.translate(_FOLD)
    return text


#: Written tokens whose words a task remembers.
REMEMBERED = 400_000
_KNOWN: dict[str, tuple[str, ...]] = {}


def token_words(raw: str) -> tuple[str, ...]:
    """Folded words of a token without white space."""
    w = _KNOWN.get(raw)
    if w is None:
        if len(_KNOWN) >= REMEMBERED:
            _KNOWN.clear()
        w = _KNOWN[raw] = tuple(_WORD.findall(_DIGRAPH.sub(lambda m: m[0][0], folded(raw))))
    return w


def raw_tokens(text: str) -> list[str]:
    """Tokens between white space, with markup, escapes and thousands separators gone."""
    return _GROUPED.sub("", unescape(text)).split()


def words(text: str) -> list[str]:
    """Folded words; thousands separators in numbers and the two writings of Nordic letters don't show."""
    return [w for raw in raw_tokens(text) for w in token_words(raw)]
