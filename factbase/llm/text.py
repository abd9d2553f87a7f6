"""Words of a text, as Spark expressions that stay in the JVM.

NFKC comes from the ICU library among Spark's own jars, called by name, as Spark has no function for it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ranges of characters that are words by themselves.
SINGLES = [(0x3040, 0x30FF), (0x3400, 0x9FFF)]
SINGLE = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SINGLES)
WORD = rf"[{SINGLE}]|[[\p{{L}}\p{{N}}]&&[^{SINGLE}]]+"


def nfkc(text: Column) -> Column:
    """Unicode form NFKC, by the ICU library that Spark carries. Null stays null."""
    return F.when(text.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))


def plain(text: Column) -> Column:
    """NFKC, without characters of category Cf, in lower case. Null stays null."""
    return F.lower(F.regexp_replace(nfkc(text), r"\p{Cf}", ""))


def words(text: Column) -> Column:
    """The words of a text in order; empty for a text without words, null for null."""
    return F.regexp_extract_all(plain(text), F.lit(WORD), F.lit(0))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once a row, also where a lambda inside uses it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)
