"""Repetition inside a document: measures and thresholds, compiled into one Spark projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, words

STRETCH = 8  # words

# Common words of languages, of which prose in the language has some.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "ein", "eine", "mit", "von", "zu", "nicht", "auf"],
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "a", "is", "in", "for"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "con", "para", "por"],
    "fr": ["le", "la", "les", "des", "et", "est", "un", "une", "dans", "avec", "pour", "que"],
    "it": ["il", "lo", "gli", "di", "che", "e", "un", "una", "con", "per", "non", "sono"],
    "ja": ["の", "は", "を", "に", "が", "と", "で", "た"],
    "ko": ["및", "그", "이", "또는", "상기", "하는", "있는", "것을"],
    "nl": ["de", "het", "een", "en", "van", "met", "voor", "niet", "op", "is", "dat", "te"],
    "pt": ["o", "os", "as", "de", "que", "e", "um", "uma", "com", "para", "não", "por"],
    "ru": ["и", "в", "не", "на", "что", "с", "по", "для", "из", "от"],
    "zh": ["的", "是", "在", "和", "一", "不", "有", "了", "其", "所"],
}


@dataclass(frozen=True)
class Threshold:
    """A document is flagged as ``name`` if ``measure`` is at least ``least`` or, if that is given, at most ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def compiled(self) -> Column:
        m, no = F.col(self.measure), F.lit(False)
        low = m >= self.least if self.least is not None else no
        high = m <= self.most if self.most is not None else no
        return F.coalesce(low | high, no)


REPEATS = Threshold("repeats", "repeated_share", least=0.35)
THRESHOLDS = [
    REPEATS,
    Threshold("same_lines", "same_line_share", least=0.30),
    Threshold("same_paragraphs", "same_paragraph_share", least=0.30),
    Threshold("symbols", "symbol_share", least=0.10),
    Threshold("odd_words", "mean_word_length", least=10.0, most=2.0),
    Threshold("unfinished_lines", "ellipsis_line_share", least=0.30),
    Threshold("no_prose", "stop_words", most=1.0),
]


def stretches(word: Column, size: int = STRETCH) -> Column:
    """One hash for each stretch of ``size`` words, by its first word."""
    starts = lambda h: F.when(F.size(h) >= size, F.sequence(F.lit(0), F.size(h) - size)).otherwise(F.array().cast("array<int>"))
    return let(F.transform(word, lambda w: F.xxhash64(w)), lambda h: F.transform(starts(h), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))


def repeated_words(hashes: Column, size: int = STRETCH) -> Column:
    """How many words lie in a stretch that also starts at an earlier word. Most documents have no such stretch and end at the count of distinct ones."""

    def again(h: Column) -> Column:
        places = F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        later = let(F.sort_array(places), lambda s: F.filter(s, lambda x, k: (k > 0) & (x["x"] == F.get(s, k - 1)["x"])))
        inorder = F.sort_array(F.transform(later, lambda x: x["i"]))
        zero = F.struct(F.lit(-(1 << 30)).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(inorder, zero, lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(size), i - acc["at"])).alias("n")), lambda acc: acc["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(again(h)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _same_share(text: Column, separator: str) -> Column:
    """The share of non-blank parts that an earlier part equals."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")
    return let(parts, lambda p: _share((F.size(p) - F.size(F.array_distinct(p))).cast("double"), F.size(p)))


def _most_stop_words(word: Column) -> Column:
    """How many different stop words of one language there are, in the language that has most of them; what lang says doesn't matter."""
    every = sorted({x for ws in STOP_WORDS.values() for x in ws})
    has = lambda ws, found: F.size(F.array_intersect(found, F.array(*map(F.lit, ws))))
    return let(F.array_intersect(word, F.array(*map(F.lit, every))), lambda found: F.greatest(*[has(ws, found) for ws in STOP_WORDS.values()]).cast("double"))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the measures of its text; null text has none, and a share of nothing is null.

    Every measure is an expression over the row: documents aren't shuffled, whatever they hold, and those that nothing
    reads aren't computed.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    base = documents.filter(text.isNotNull()).select("doc_id", "text", words(text).alias("w"))
    n = F.size("w")
    return base.select(
        "doc_id",
        n.alias("words"),
        _share(repeated_words(stretches(F.col("w"))).cast("double"), n).alias("repeated_share"),
        _same_share(text, "\n").alias("same_line_share"),
        _same_share(text, "\n\n+").alias("same_paragraph_share"),
        # a hash sign, an ellipsis, or three dots for one
        _share(F.regexp_count(text, F.lit(r"#|…|\.{3}")).cast("double"), n).alias("symbol_share"),
        _share(F.aggregate("w", F.lit(0), lambda acc, x: acc + F.length(x)).cast("double"), n).alias("mean_word_length"),
        let(lines, lambda p: _share(F.size(F.filter(p, lambda x: F.rtrim(x).endswith("…") | F.rtrim(x).endswith("..."))).cast("double"), F.size(p))).alias("ellipsis_line_share"),
        _most_stop_words(F.col("w")).alias("stop_words"),
    )


def flagged(documents: DataFrame, thresholds: list[Threshold] = THRESHOLDS) -> DataFrame:
    """doc_id, the measures that the thresholds use, and one boolean column for each threshold."""
    used = list(dict.fromkeys(t.measure for t in thresholds))
    return measured(documents).select("doc_id", *used, *[t.compiled().alias(t.name) for t in thresholds])
