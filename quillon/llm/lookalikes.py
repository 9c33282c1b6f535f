"""Tables of characters that look alike, and of those that show nothing."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other alphabets with the shape of a Latin letter, as pairs of strings.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХЗҮԌԚԜҺ" "аеіјорсухѕһԛԝԁӏ", "ABESIJKMHOPCTYX3YGQWH" "aeijopcyxshqwdl")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ" "ονιϲɑ", "ABEZHIKMNOPTYXCj" "ovıca")
_ARMENIAN = ("ՕՍօոսհզց", "OUonuhqg")
_LATIN = ("ɡɩɪʏıȷ", "gııʏıj")
_PUNCT = ("‐‑", "--")

#: code point -> Latin letter of the same shape, one for one
LATIN_OF: dict[int, str] = {}
for _from, _to in (_CYRILLIC, _GREEK, _ARMENIAN, _LATIN, _PUNCT):
    LATIN_OF |= {ord(a): b for a, b in zip(_from, _to, strict=True)}

#: full-width forms of ASCII, one for one (U+FF01..U+FF5E stand 0xFEE0 above ASCII)
NARROW_OF = {0xFF01 + i: chr(0x21 + i) for i in range(94)}

#: one-for-one table that leaves offsets as they are
SAME_LENGTH = NARROW_OF | LATIN_OF


@lru_cache(maxsize=65536)
def is_unseen(c: str) -> bool:
    """Whether a character shows nothing: format characters, soft hyphen, variation selectors, fillers."""
    o = ord(c)
    if 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return True
    return unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Cc" and c not in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f")


@lru_cache(maxsize=65536)
def unit(c: str) -> str:
    """What a single character looks like: width, composition and joined letters undone, look-alikes in Latin."""
    if is_unseen(c):
        return ""
    if c not in "\n\r" and c.isspace() and c not in "\x0b\x0c\x85  ":
        return "\t" if c == "\t" else " "
    if c in "  \x85":
        return "\n"
    wide = unicodedata.normalize("NFKC", c)
    if unicodedata.category(c) in ("No", "Nl", "So", "Sk", "Sm") or c in "…‥ªºª" or "<super>" in unicodedata.decomposition(c) or "<sub>" in unicodedata.decomposition(c):
        wide = unicodedata.normalize("NFC", c)  # raised, circled or spaced forms do look different
    return wide.translate(LATIN_OF)


# Letters that are a mere stroke, which may stand for a capital i or a small L
STROKES = "Ӏӏǀꓲⵏ𐌉"


@lru_cache(maxsize=65536)
def readings(c: str) -> tuple[str, ...]:
    """All that a single character may be read as, the table's reading first."""
    shown = unit(c)
    return tuple(dict.fromkeys((shown, "l", "I"))) if c in STROKES else (shown,)
