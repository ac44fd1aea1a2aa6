"""Problem 7: noise in text from scanned pages.

Page furniture is what repeats at the edges of a file's pages; its keys are folded so that misread letters do not matter.
Words cut by a line end are joined with the next line of running text, unless the cut falls on a hyphen of the word's
own. Every distinct word is then looked up in the corpus vocabulary: a Levenshtein automaton (bit-parallel) is intersected
with a trie of the vocabulary, which finds all candidates. What the recognition confuses is learned from those pairs: what
stands in many rare words for what their frequent neighbours have, and hardly ever the other way round. The likeliest
candidate by confusions, context and frequency is the repair. Nothing is grouped by file alone: windows run within a page,
and pages carry their sums on.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import ship, staged

# What recognition is known to confuse, as (written, meant); the corpus's own confusions are learned on top.
CONFUSED = [
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("m", "rn"), ("n", "ri"), ("d", "cl"), ("h", "b"), ("b", "h"),
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("i", "l"), ("l", "i"), ("!", "l"), ("!", "i"), ("0", "o"), ("5", "s"), ("@", "a"), ("+", "t"), ("6", "b"),
    ("6", "g"), ("9", "g"), ("8", "b"), ("2", "z"), ("c", "e"), ("e", "c"), ("$", "s"), ("l", "t"), ("f", "t"), ("t", "f"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("m", "in"), ("nn", "m"), ("q", "g"), ("g", "q"), ("h", "li"),
]
HYPHENS = "-‐‑¬\xad"
MIN_COUNT, RATIO = 3, 8  # a vocabulary word; how much more frequent a repair has to be than what it repairs


SUPPORT, ASYMMETRY = 5, 3  # pairs of words that show a confusion, at least; how much rarer the reverse has to be


class Confusions(dict):
    """written -> what it may stand for, from pairs (written, meant)."""

    def __init__(self, pairs):
        super().__init__()
        for written, meant in pairs:
            self.setdefault(written, set()).add(meant)


KNOWN = Confusions(CONFUSED)


def recognition_cost(written: str, meant: str, confusions: Confusions = KNOWN) -> float:
    """Least number of confusions that turn ``meant`` into ``written``; other edits cost 3 each."""
    n, m = len(written), len(meant)
    best = [[99.0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            now = best[i][j]
            if now > 6:
                continue
            if i < n and j < m and written[i] == meant[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], now)
            for a in (1, 2):
                for x in confusions.get(written[i : i + a], ()) if i + a <= n else ():
                    if meant.startswith(x, j):
                        k = j + len(x)
                        best[i + a][k] = min(best[i + a][k], now + 1)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], now + 3)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], now + 3)
            if i < n and j < m:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], now + 3)
    return best[n][m]


def difference(written: str, meant: str) -> tuple[str, str] | None:
    """The one place where two words differ, if both have one or two letters there; None otherwise."""
    most = min(len(written), len(meant))
    head = next((i for i in range(most) if written[i] != meant[i]), most)
    tail = next((i for i in range(most - head) if written[-1 - i] != meant[-1 - i]), most - head)
    a, b = written[head : len(written) - tail], meant[head : len(meant) - tail]
    return (a, b) if 0 < len(a) <= 2 and 0 < len(b) <= 2 else None


class Trie:
    """Vocabulary trie: per node its children, the word that ends there with its count, and of the words below the least and
    greatest length and the greatest count."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root: list = [{}, None, 0, 0, 0, 0]
        self.counts = dict(words)
        for w, n in words:
            node = self.root
            size = len(w)
            for ch in w:
                node[5] = max(node[5], n)
                child = node[0].get(ch)
                if child is None:
                    child = node[0][ch] = [{}, None, 0, size, size, n]
                else:
                    child[3], child[4] = min(child[3], size), max(child[4], size)
                node = child
            node[1], node[2], node[5] = w, n, max(node[5], n)

    def within(self, word: str, k: int, least: int = 0) -> list[tuple[str, int, int]]:
        """(candidate, distance, count) of all words within ``k`` edits that come ``least`` times or more: the automaton's k+1
        bit vectors of live positions go down the trie together and a branch ends when none is left, or when no word below
        it has the length or the count."""
        mask: dict[str, int] = {}
        size = len(word)
        for i, ch in enumerate(word):
            mask[ch] = mask.get(ch, 0) | (1 << i)
        final = 1 << size
        start = tuple((1 << (e + 1)) - 1 for e in range(k + 1))  # e skipped letters of the word
        full = (final << 1) - 1
        out = []
        stack = [(self.root, tuple(s & full for s in start))]
        while stack:
            node, live = stack.pop()
            if node[1] is not None and node[2] >= least:
                for e in range(k + 1):
                    if live[e] & final:
                        out.append((node[1], e, node[2]))
                        break
            for ch, child in node[0].items():
                if child[5] < least or child[3] > size + k or child[4] < size - k:
                    continue
                m = mask.get(ch, 0)
                new = (live[0] & m) << 1
                nxt = [new]
                for e in range(1, k + 1):
                    # match, insertion of ch, substitution, then skipping letters of the word
                    new = ((live[e] & m) << 1) | live[e - 1] | (live[e - 1] << 1) | (nxt[e - 1] << 1)
                    nxt.append(new & full)
                if nxt[k]:
                    stack.append((child, tuple(nxt)))
        return out


def neighbours(queries: DataFrame, vocabulary: DataFrame, shard_words: int = 200_000, slice_words: int = 20_000) -> DataFrame:
    """(word, candidate, dist, n, written, meant): for every distinct query word (word, n) all words of (word, n) vocabulary within
    two edits (three from eight letters on) that are ``RATIO`` times as frequent, with the place where they differ if it is one; and
    itself, at distance 0.

    The vocabulary is cut into shards of about ``shard_words`` and the queries into slices (more, if that keeps more cores
    busy); every slice meets every shard, so the retrieval is complete and no task holds more than one of each.
    """
    spark = ship(queries.sparkSession).sparkContext
    asked = queries.count()
    shards = max(1, -(-vocabulary.count() // shard_words))
    slices = max(1, -(-asked // slice_words), min(spark.defaultParallelism, asked // 250))
    one = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")
    voc = vocabulary.select(F.col("word").alias("known"), F.col("n").alias("times"), one.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    ask = queries.select("word", "n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("slice"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:  # an empty side has no columns
            return pd.DataFrame([], columns=["word", "candidate", "dist", "n", "written", "meant"])
        trie = Trie(list(zip(right["known"], right["times"])))
        out = []
        for word, n in zip(left["word"], left["n"]):
            if word in trie.counts:
                out.append((word, word, 0, trie.counts[word], None, None))
            for cand, dist, count in trie.within(word, 2 if len(word) < 8 else 3, RATIO * max(n, 1)):
                if dist:
                    out.append((word, cand, dist, count, *(difference(word, cand) or (None, None))))
        return pd.DataFrame(out, columns=["word", "candidate", "dist", "n", "written", "meant"])

    return ask.groupBy("shard", "slice").cogroup(voc.groupBy("shard", "slice")).applyInPandas(run, "word string, candidate string, dist int, n bigint, written string, meant string")


def learned(pairs: DataFrame) -> list[tuple[str, str]]:
    """(written, meant) confusions that ``neighbours`` show: in ``SUPPORT`` words of four letters or more, and ``ASYMMETRY`` times as
    often as the reverse (words that are merely alike differ both ways). At most one per two strings of two letters."""
    seen = pairs.where(F.col("written").isNotNull() & (F.length("word") >= 4)).groupBy("written", "meant").agg(F.countDistinct("word").alias("n"))
    back = seen.select(F.col("written").alias("meant"), F.col("meant").alias("written"), F.col("n").alias("reverse"))
    kept = seen.join(back, ["written", "meant"], "left").where((F.col("n") >= SUPPORT) & (F.col("n") >= ASYMMETRY * (F.coalesce("reverse", F.lit(0)) + 1)))
    return sorted((r.written, r.meant) for r in kept.select("written", "meant").toLocalIterator())


def candidates(pairs: DataFrame, confusions: Confusions) -> DataFrame:
    """(word, candidate, cost, n): the likely meanings among ``neighbours``. Letters may only be confused; a sign within a word may
    stand for anything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for word, cand, dist, n in zip(pdf["word"], pdf["candidate"], pdf["dist"], pdf["n"]):
                clean = word.replace("-", "").isalpha()
                if dist == 0 or unicodedata.normalize("NFKC", word) == cand:  # a ligature is read right
                    if clean:
                        out.append((word, cand, 0.0, n))
                    continue
                cost = recognition_cost(word, cand, confusions)
                if cost < 3 or (not clean and dist == 1 and len(word) > 3):
                    out.append((word, cand, cost, n))
            yield pd.DataFrame(out, columns=["word", "candidate", "cost", "n"])

    return pairs.mapInPandas(run, "word string, candidate string, cost double, n bigint")


def _fold(x: Column) -> Column:
    """Letters of a line as recognition cannot tell them apart."""
    x = F.translate(x, "1|!i05$@+698uhe", "llllossatbgbbbc")
    for a, b in (("rl", "n"), ("rn", "m"), ("cl", "d"), ("ll", "b"), ("vv", "w")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, r"[^\p{L}]", "")


def lines_of(elements: DataFrame) -> DataFrame:
    """One row per (doc_sha, page, seq): repeated rows once (of different texts the greatest), no empty lines; white space single, with the place in
    the page from its top and its bottom, whether the line is cut at its end and whether it is running text.

    Rows without file, page or seq cannot be placed and are left out. One shuffle by page serves all.
    """
    cut = rf"[\p{{L}}0-9@+|][{HYPHENS}]\s*$"
    rows = elements.select("doc_sha", "page", "seq", "text", F.coalesce("element_type", F.lit("")).alias("type")).where(
        F.col("doc_sha").isNotNull() & F.col("page").isNotNull() & F.col("seq").isNotNull() & (F.trim("text") != "")
    )
    page = Window.partitionBy("doc_sha", "page")
    return (
        rows.repartition("doc_sha", "page")
        .groupBy("doc_sha", "page", "seq")
        .agg(F.max(F.struct("text", "type")).alias("x"))
        .select("doc_sha", "page", "seq", F.when(F.col("x.text").rlike(r"[^\S ]|  "), F.trim(F.regexp_replace("x.text", r"\s+", " "))).otherwise(F.trim("x.text")).alias("text"), "x.type", F.row_number().over(page.orderBy("seq")).alias("from_top"), F.count("*").over(page).alias("in_page"))
        .select(
            "doc_sha", "page", "seq", "text", "type", "from_top", (F.col("in_page") - F.col("from_top") + 1).cast("int").alias("from_bottom"),
            F.col("text").rlike(cut).alias("cut"), _is_running(F.col("text"), F.col("type")).alias("running"),
        )
    )


AT_EDGE = "from_top <= 2 OR from_bottom <= 2"


_NUMBER = r"[0-9lI|OSoi]{1,4}"
_ROMAN = r"[ivxlcdm1|]{1,8}"


def _page_value(text: Column) -> Column:
    """Number that a line of nothing but a page number holds (roman ones too); null for other lines."""
    digits = F.regexp_extract(text, rf"^(?:(?:[Pp]age|[Pp]\.?|[Pp]g\.?)\s*)?[\-–—\[(]*\s*({_NUMBER})\s*[\-–—\])]*(?:\s+of\s+{_NUMBER})?$", 1)
    plain = F.translate(digits, "lI|iOoS", "1111005").try_cast("int")
    roman = F.regexp_extract(F.lower(text), rf"^(?:(?:page|p\.?)\s*)?[\-–—\[(]*\s*({_ROMAN})\s*[\-–—\])]*$", 1)
    roman = F.translate(roman, "1|", "il")
    value = F.lit(0)
    for sign, worth in (("m", 1000), ("cm", 800), ("d", 500), ("cd", 300), ("c", 100), ("xc", 80), ("l", 50), ("xl", 30), ("x", 10), ("ix", 8), ("v", 5), ("iv", 3), ("i", 1)):
        # a subtractive pair adds its letters' worth less twice the smaller: handled by counting letters and then pairs
        count = (F.length(roman) - F.length(F.replace(roman, F.lit(sign), F.lit("")))) / len(sign)
        value = value + count * (worth if len(sign) == 1 else -2 * {"cm": 100, "cd": 100, "xc": 10, "xl": 10, "ix": 1, "iv": 1}[sign])
    only_roman = (roman != "") & ~text.rlike(r"[0-9]")
    return F.when(only_roman, value.cast("int")).otherwise(plain)


def furniture(lines: DataFrame) -> DataFrame:
    """(doc_sha, page, seq, defect) of running headers, footers and page numbers.

    Only the two outermost lines at the top and at the bottom of a page come into question. A running line is one whose
    folded text, without a number at either end, stands at an edge of two pages of the file or more. A page number
    holds nothing else, and is decorated or in step with the page count on two pages or more (or marked as header or
    footer by the extractor).
    """
    edges = (
        lines.where(AT_EDGE)
        .select("doc_sha", "page", "seq", "text", "type")
        .withColumn("value", _page_value(F.col("text")))
        .withColumn("bare", F.regexp_replace(F.regexp_replace("text", rf"\s+{_NUMBER}$", ""), rf"^{_NUMBER}\s+", ""))
        .withColumn("key", _fold(F.lower("bare")))
    )
    edges = staged(edges.drop("bare"), "edges")  # few lines, and four ways to look at them
    per_file = Window.partitionBy("doc_sha")  # of distinct keys and offsets, not of lines
    worded = F.col("value").isNull() & (F.length("key") >= 6) & ~F.col("text").rlike(r"[.;:,]$|^§|^\[.*\]$")
    keys = (
        edges.where(worded)
        .groupBy("doc_sha", "key")
        .agg(F.countDistinct("page").alias("pages"), F.max((F.col("type") == "table").cast("int")).alias("table"))
        .where("pages >= 2 AND table = 0")
        .select("doc_sha", F.col("key").alias("known"))
    )
    # A badly read one is still near one of the file's running lines (few per file).
    distance = F.levenshtein("key", "known")
    like = (
        edges.where(worded)
        .select("doc_sha", "key")
        .distinct()
        .join(keys, "doc_sha")
        .where(distance * 6 <= F.greatest(F.length("key"), F.length("known")))
        .select("doc_sha", "key", F.lit(True).alias("running"))
        .distinct()
    )
    steps = (
        edges.where(F.col("value").isNotNull())
        .groupBy("doc_sha", (F.col("value") - F.col("page")).alias("offset"))
        .agg(F.countDistinct("page").alias("pages"))
        .withColumn("most", F.max("pages").over(per_file))
        .where("pages >= 2 AND pages = most")
        .select("doc_sha", "offset", F.lit(True).alias("in_step"))
    )
    decorated = F.col("text").rlike(r"(?i)^(page|pg|p\.?)\s*\S|^[\-–—]\s*\S+\s*[\-–—]$|^\[\S+\]$|\sof\s")
    marked = F.col("type").isin("header", "footer")
    return (
        edges.withColumn("offset", F.col("value") - F.col("page"))
        .join(like, ["doc_sha", "key"], "left")
        .join(steps, ["doc_sha", "offset"], "left")
        .withColumn(
            "defect",
            F.when(F.col("value").isNotNull() & (F.col("in_step") | decorated | marked), "page_number").when(F.col("value").isNull() & F.col("running"), "header"),
        )
        .where(F.col("defect").isNotNull())
        .select("doc_sha", "page", "seq", "defect")
    )


def single_furniture(body: DataFrame) -> DataFrame:
    """(doc_sha, page, seq, defect) of running lines that a file shows once, in ``body`` as left by ``furniture``.

    The extractor calls the line furniture (or a heading), it stands at an edge of its page, opens with a capital or a number
    and closes no sentence; and the text around it runs on without it: what comes before is unfinished, or what
    follows does not continue it.
    """
    w = Window.partitionBy("doc_sha", "page")
    near = body.select("*", F.row_number().over(w.orderBy("seq")).alias("t"), F.row_number().over(w.orderBy(F.desc("seq"))).alias("b")).where("t = 1 OR b = 1")
    unlike = F.col("type").isin("header", "footer", "other", "heading") & F.col("text").rlike(r"^[\p{Lu}0-9]") & ~F.col("text").rlike(r"[.;:,]$|^§|^\[.*\]$") & ~F.col("cut")
    unfinished = F.col("text_before").isNotNull() & ~F.col("text_before").rlike(r"[.;:!?][\p{Pf}\")\]]*$|^§")
    continued = F.coalesce(F.col("next_word").rlike(r"^\p{Ll}"), F.lit(False))
    return near.where(unlike & (unfinished | ~continued)).select("doc_sha", "page", "seq", F.lit("header").alias("defect"))


def _is_running(text: Column, type_: Column) -> Column:
    """Running text or a heading: it holds words or the rest of a citation, and is no row of a table."""
    return text.rlike(r"\p{Ll}{2}|^[0-9]+\.[0-9]+(\([a-z0-9]+\))*[.,;]?$") & ~((type_ == "table") & (F.size(F.split(text, r"\s+")) <= 4))


def body_of(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Running lines with the first word of the next running line (of this or a later page) as ``next_word``. ``marks`` are lines
    at the edges of pages."""
    keys, kept = ["doc_sha", "page", "seq"], ["doc_sha", "page", "seq", "text", "type", "cut"]
    inner = lines.where(f"running AND NOT ({AT_EDGE})").select(*kept)
    edge = lines.where(f"running AND ({AT_EDGE})").select(*kept).join(marks.select(*keys), keys, "left_anti")
    body = inner.unionByName(edge.select(*kept)).withColumn("word", F.regexp_extract("text", r"^\S+", 0))
    in_page = Window.partitionBy("doc_sha", "page").orderBy("seq")
    firsts = body.groupBy("doc_sha", "page").agg(F.min(F.struct("seq", "word", "text")).alias("first"), F.max(F.struct("seq", "cut", "text")).alias("last"), F.max(F.length("text")).alias("widest"))
    of_pages = Window.partitionBy("doc_sha").orderBy("page")  # one row per page
    pages = firsts.select("doc_sha", "page", "widest", F.lead("first").over(of_pages).alias("after"), F.lag("last").over(of_pages).alias("before"))
    return (
        body.join(pages, ["doc_sha", "page"], "left")
        .withColumn("next_word", F.coalesce(F.lead("word").over(in_page), F.col("after.word")))
        .withColumn("next_seq", F.coalesce(F.lead("seq").over(in_page), F.col("after.seq")))
        .withColumn("after_cut", F.coalesce(F.lag("cut").over(in_page), F.col("before.cut"), F.lit(False)))
        .withColumn("text_before", F.coalesce(F.lag("text").over(in_page), F.col("before.text")))
        .drop("after", "before", "word")
    )


def _core(word: Column) -> Column:
    """A word without the punctuation around it, in small letters."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}0-9@+|$]+|[^\p{L}0-9@+|$]+$", ""))


def _wordlike(word: Column) -> Column:
    return (F.length(word) >= 3) & word.rlike(r"\p{L}") & ~word.rlike(r"^[0-9]+[.(]|^[0-9]+\p{L}{0,2}$|^\p{L}[0-9]+$|[.()§]")


def _words() -> Column:
    return F.split("text", " ")  # lines_of has left single blanks only


def _whole() -> Column:
    """The words of a running line that are whole: without one cut at its end and the rest of one cut before it."""
    head, tail = F.col("after_cut").cast("int"), F.col("cut").cast("int")
    return F.slice(_words(), 1 + head, F.greatest(F.size(_words()) - head - tail, F.lit(0)))


def layout(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, body): page furniture, and the running lines without it."""
    lines = staged(lines_of(elements), "lines")
    repeated = staged(furniture(lines), "furniture")
    first = staged(body_of(lines, repeated), "body")
    once = staged(single_furniture(first), "furniture")
    marks = repeated.unionByName(once)
    # Lines that fall away change the neighbours of others in their file; only such files are laid out again.
    files = once.select("doc_sha").distinct()
    again = body_of(lines.join(files, "doc_sha", "left_semi"), marks.join(files, "doc_sha", "left_semi"))
    return marks, first.join(files, "doc_sha", "left_anti").unionByName(staged(again, "body").select(*first.columns))


def repair(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, words, body): the disturbed lines (doc_sha, page, seq, defect), the repairs of words, and the running lines.

    words: doc_sha, page, seq, pos (0 the first word), written, meant; a word cut by the line end has its line's last pos,
    ``joined`` true and the whole word as meant.
    """
    marks, body = layout(elements)
    keys = ["doc_sha", "page", "seq"]
    # Words are counted as they are written, and only the distinct ones taken apart.
    raws = staged(body.select(F.explode(_whole()).alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).withColumn("word", _core(F.col("raw"))).where(_wordlike(F.col("word"))), "raws")
    counts = raws.groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = counts.where((F.col("n") >= MIN_COUNT) & F.col("word").rlike(r"^\p{L}+(-\p{L}+)*$"))

    cut_here = F.col("cut") & F.col("next_word").isNotNull() & F.col("next_word").rlike(r"^[\p{Ll}0-9@+|I]")
    cuts = body.where(cut_here).select(*keys, (F.size(_words()) - 1).alias("pos"), "next_seq", _core(F.regexp_extract("text", r"\S+$", 0)).alias("head"), _core(F.col("next_word")).alias("tail"))
    cuts = cuts.withColumn("joined", F.concat("head", "tail")).withColumn("hyphened", F.concat("head", F.lit("-"), "tail"))
    cuts = staged(cuts.where((F.col("head") != "") & (F.col("tail") != "")), "cuts")
    asked = counts.unionByName(cuts.select(F.explode(F.array("joined", "hyphened")).alias("word"), F.lit(0).cast("bigint").alias("n")))
    asked = asked.groupBy("word").agg(F.max("n").alias("n"))
    near = staged(neighbours(staged(asked, "asked"), staged(vocabulary, "vocabulary")), "neighbours")
    cand = staged(candidates(near, Confusions([*CONFUSED, *learned(near)])), "candidates")
    # A word that is itself in the vocabulary and has no far more frequent look-alike stands as it is.
    best = cand.groupBy("word").agg(
        F.min_by("candidate", F.struct("cost", -F.col("n"), "candidate")).alias("nearest"),
        F.min("cost").alias("cost"),
        F.min(F.when(F.col("cost") > 0, F.struct("cost", (-F.col("n")).alias("rare"), "candidate"))).alias("other"),
        F.count_if(F.col("cost") > 0).alias("others"),
    )
    wrong = best.where(F.col("other").isNotNull()).select("word", F.col("other.candidate").alias("meant"), "others").join(raws.select("raw", "word"), "word")
    hits = body.select(*keys, F.posexplode(_whole()).alias("pos", "raw"), "after_cut").join(wrong, "raw").withColumn("pos", F.col("pos") + F.col("after_cut").cast("int"))

    # Cut words: the reading, joined or with a hyphen of its own, that is nearer to a known word.
    as_ = lambda name: best.select(F.col("word").alias(name), F.struct("nearest", "cost", F.col("other").alias("other")).alias(f"{name}_best"))
    meaning = lambda x: F.coalesce(F.col(f"{x}_best.other.candidate"), F.col(f"{x}_best.nearest"))
    # (cost, frequency) of a reading: a look-alike that is far more frequent replaces the reading itself.
    solved = cuts.join(as_("joined"), "joined", "left").join(as_("hyphened"), "hyphened", "left")
    n_of = counts.select(F.col("word").alias("m"), "n")
    cost = lambda x: F.coalesce(F.col(f"{x}_best.cost"), F.lit(9.0))
    solved = (
        solved.join(n_of.select(F.col("m").alias("joined"), F.col("n").alias("joined_n")), "joined", "left")
        .join(n_of.select(F.col("m").alias("hyphened"), F.col("n").alias("hyphened_n")), "hyphened", "left")
        .withColumn(
            "own",
            F.when(cost("hyphened") < cost("joined"), True)
            .when(cost("hyphened") > cost("joined"), False)
            .otherwise(F.coalesce("hyphened_n", F.lit(0)) > F.coalesce("joined_n", F.lit(0))),
        )
        .withColumn("written", F.when(F.col("own"), F.col("hyphened")).otherwise(F.col("joined")))
        .withColumn("meant", F.coalesce(F.when(F.col("own"), meaning("hyphened")).otherwise(meaning("joined")), F.col("written")))
    )
    solved = staged(solved.select(*keys, "pos", "next_seq", "head", "tail", "own", "written", "meant"), "solved")
    hyphen = solved.where(~F.col("own")).select(*keys, F.lit("hyphen").alias("defect"))
    heads = solved.where((F.col("written") != F.col("meant")) & ~F.startswith("meant", "head")).select(*keys)
    tails = solved.where((F.col("written") != F.col("meant")) & ~F.endswith("meant", "tail")).select("doc_sha", F.col("next_seq").alias("seq"))
    tails = tails.join(body.select(*keys), ["doc_sha", "seq"]).select(*keys)
    bad = hits.select(*keys).unionByName(heads).unionByName(tails).distinct().withColumn("defect", F.lit("misread"))
    found = marks.unionByName(hyphen).unionByName(bad)
    words_out = _in_context(body, hits, raws, cand).unionByName(solved.select(*keys, "pos", "written", "meant", F.lit(True).alias("joined")))
    return found, words_out, body


def _in_context(body: DataFrame, hits: DataFrame, raws: DataFrame, cand: DataFrame) -> DataFrame:
    """(doc_sha, page, seq, pos, written, meant, joined): the repair of every misread word; where several are possible, of equal cost,
    the one most often seen after the word before it."""
    keys = ["doc_sha", "page", "seq"]
    clear = hits.where("others = 1").select(*keys, "pos", "word", "meant")
    likely = cand.where("cost > 0").select("word", "candidate", "cost", "n")
    place = hits.where("others > 1").select(*keys, "pos", "word")
    unclear = place.join(body.select(*keys, _words().alias("words")), keys).select(*keys, "pos", "word", _core(F.get("words", F.col("pos") - 1)).alias("left")).join(likely, "word")
    # Pairs are counted for the words in question alone.
    wanted = hits.where("others > 1").select("word").distinct().join(likely, "word").select(F.col("candidate").alias("word")).distinct().join(raws.select("raw", "word"), "word")
    two = F.arrays_zip(F.slice(_words(), 1, F.greatest(F.size(_words()) - 1, F.lit(0))).alias("l"), F.slice(_words(), 2, F.greatest(F.size(_words()) - 1, F.lit(0))).alias("r"))
    pairs = body.select(F.explode(two).alias("p")).select(F.col("p.l").alias("l"), F.col("p.r").alias("raw")).join(wanted.withColumnRenamed("word", "candidate"), "raw")
    pairs = pairs.groupBy("l", "candidate").agg(F.count("*").alias("n2")).groupBy(_core(F.col("l")).alias("left"), "candidate").agg(F.sum("n2").alias("together"))
    ranked = unclear.join(pairs, ["left", "candidate"], "left").groupBy(*keys, "pos", "word").agg(
        F.min_by("candidate", F.struct("cost", -F.coalesce("together", F.lit(0)), -F.col("n"), "candidate")).alias("meant")
    )
    return clear.unionByName(ranked.select(*clear.columns)).select(*keys, "pos", F.col("word").alias("written"), "meant", F.lit(False).alias("joined"))


def found(elements: DataFrame) -> DataFrame:
    """(doc_sha, page, seq, defect) of the disturbed lines, one row each."""
    return repair(elements)[0].distinct()


def paragraphs(elements: DataFrame) -> DataFrame:
    """(doc_sha, para, page, text): the running text of every file, repaired, in continuous paragraphs.

    A paragraph ends at a heading, before a label like ``(a)``, and after a line that closes a sentence well before the
    page's right edge. ``page`` is where it starts. Files without running text give none.
    """
    _, words, body = repair(elements)
    fixes = words.groupBy("doc_sha", "page", "seq").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("meant", "joined")))).alias("fixes"))
    used = words.where("joined").join(body.select("doc_sha", "page", "seq", "next_seq"), ["doc_sha", "page", "seq"]).select("doc_sha", F.col("next_seq").alias("seq"), F.lit(True).alias("used"))
    edge = r"^([^\p{L}0-9@+|$]*).*?([^\p{L}0-9@+|$]*)$"

    def mended(word: Column, i: Column) -> Column:
        fix = F.element_at("fixes", i)
        head, tail = F.regexp_extract(word, edge, 1), F.regexp_extract(F.when(fix["joined"], F.col("next_word")).otherwise(word), edge, 2)
        large = F.substring(F.ltrim(F.regexp_replace(word, r"^[^\p{L}]+", "")), 1, 1).rlike(r"^\p{Lu}")
        meant = F.when(large, F.concat(F.upper(F.substring(fix["meant"], 1, 1)), F.substring(fix["meant"], 2, 10_000))).otherwise(fix["meant"])
        return F.when(F.col("fixes").isNull() | fix.isNull(), word).otherwise(F.concat(head, meant, tail))

    text = F.array_join(F.transform(F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), mended(w, i).alias("w"))), lambda x: (x["i"] > 0) | ~F.coalesce(F.col("used"), F.lit(False))), lambda x: x["w"]), " ")
    closed = F.col("text_before").rlike(r"[.!?:][\p{Pf}\")\]]*$") & (F.length("text_before") < 0.85 * F.col("widest"))
    starts = F.col("text_before").isNull() | F.col("text").rlike(r"^§|^\([a-z0-9]{1,4}\)") | F.col("text_before").rlike("^§") | closed
    lines = body.withColumn("words", _words()).join(fixes, ["doc_sha", "page", "seq"], "left").join(used, ["doc_sha", "seq"], "left").select("doc_sha", "page", "seq", text.alias("line"), starts.cast("int").alias("start"))
    in_page = Window.partitionBy("doc_sha", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_sha").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # one row per page
    offset = lines.groupBy("doc_sha", "page").agg(F.sum("start").alias("starts")).select("doc_sha", "page", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("offset"))
    numbered = lines.withColumn("k", F.sum("start").over(in_page)).join(offset, ["doc_sha", "page"])
    return (
        numbered.groupBy("doc_sha", (F.col("k") + F.col("offset")).cast("int").alias("para"))
        .agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("page", "seq", "line"))).alias("lines"))
        .select("doc_sha", "para", "page", F.array_join(F.filter(F.transform("lines", lambda x: x["line"]), lambda x: x != ""), " ").alias("text"))
    )
