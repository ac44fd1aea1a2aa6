"""Plain words of dirty text: shared by leakage search and toxicity scoring."""

from __future__ import annotations

import re
import unicodedata

# Letters that look like Latin ones, and what they look like.
LOOKALIKES = str.maketrans("аеорсухіѕјһкмтвнԁАЕОРСУХІЅЈНКМТВοαενικρτυΟΑΕΝΙΚΡΤΥ", "aeopcyxisjhkmtbhdAEOPCYXISJHKMTBoaevikptuOAENIKPTY")
_UNUSUAL = re.compile("[^\\x00-\\xff–-‟…€]|\xad")
_INVISIBLE = re.compile("[\xad​-‏⁠﻿️]")
_LINE_HYPHEN = re.compile(r"(?<=\w)-[ \t]*(?:\r\n|\n|\r)[ \t>]*(?=\w)")
WORD = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    """Compatibility forms resolved, invisible characters dropped, look-alike letters made Latin, line hyphens closed."""
    if _UNUSUAL.search(text):
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).translate(LOOKALIKES)
    if "-\n" in text or "-\r" in text or "- " in text:
        text = _LINE_HYPHEN.sub("", text)
    return text


def words(text: str) -> list[str]:
    return WORD.findall(clean(text).lower())
