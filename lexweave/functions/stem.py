"""English stemming (the public Porter2 algorithm) and stop words; stems are made over the distinct vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.session import ship

# A short public list of English function words.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

_V = "aeiouy"
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
_KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"(gener|commun|arsen)", w)
    if m:
        r1 = m.end()
    else:
        m = re.search(r"[aeiouy][^aeiouy]", w)
        r1 = m.end() if m else len(w)
    m = re.search(r"[aeiouy][^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w)) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2 or not w.isascii():
        return w
    w = w.removeprefix("'")
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in _KEPT:
        return w
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        base = w[: m.start()]
        if m.group().startswith("eed"):
            w = base + "ee" if m.start() >= r1 else w
        elif re.search(r"[aeiouy]", base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for table, at in ((_STEP2, r1), (_STEP3, r1)):
        for end, new in table:
            if w.endswith(end):
                if len(w) - len(end) >= at:
                    w = w[: -len(end)] + new
                break
        else:
            if table is _STEP2:
                if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
                    w = w[:-1]
                elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
                    w = w[:-2]
            elif w.endswith("ative") and len(w) - 5 >= r2:
                w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in "st":
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of distinct words."""
    ship(words.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: stem(x) if isinstance(x, str) else None)

    return words.select(word).distinct().select(word, run(F.col(word)).alias("stem"))


def postings(docs: DataFrame, key: str, text: str, stemmed: bool = True) -> DataFrame:
    """(key, term, tf): terms without stop words and words over 40 bytes, stemmed over the vocabulary and joined back."""
    each = docs.where(F.col(text).isNotNull()).select(F.col(key), F.explode(T.tokens(text)).alias("word"))
    each = each.where((F.octet_length("word") <= 40) & ~F.col("word").isin(STOP)).groupBy(key, "word").agg(F.count("*").alias("tf"))
    if not stemmed:
        return each.select(key, F.col("word").alias("term"), "tf")
    return each.join(stems(each.select("word")), "word").groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
