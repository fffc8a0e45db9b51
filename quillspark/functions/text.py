"""Text functions (D1, D3, D8, D10, D15, D20-D23, G1, P2, P21, T3). All native but those that say otherwise."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str, keep_spacing: bool = False) -> Column:
    """One kind of line end, no-break spaces as blanks, no zero-width spaces; unless spacing is kept (code, tables), runs
    of blanks and tabs as one, lines trimmed and at most one empty line in a row."""
    c = F.regexp_replace(F.regexp_replace(_c(c), "\r\n?", "\n"), " ", " ")
    c = F.regexp_replace(c, "​", "")
    if not keep_spacing:
        c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), " ?\n ?", "\n")
        c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def separator_class(c: Column | str) -> Column:
    """D3: which separators suit a text: zh for 3 and more Chinese characters to a Latin one, en for 4 and more the other way."""
    zh, en = F.regexp_count(_c(c), F.lit("[㐀-鿿]")), F.regexp_count(_c(c), F.lit("[A-Za-z]"))
    return F.when(zh >= en * 3, "zh").when(en >= zh * 4, "en").otherwise("mixed")


def contains_literal(c: Column | str, value: str) -> Column:
    """Literal substring without regard to case; % and _ are ordinary characters."""
    return F.contains(F.lower(_c(c)), F.lower(F.lit(value)))


def grounded(source: Column | str, quote: Column | str, value: Column | str) -> Column:
    """The quote stands in the source and the value in the quote."""
    return F.contains(_c(source), _c(quote)) & F.contains(_c(quote), _c(value))


def compact(c: Column | str) -> Column:
    """Without white space, and without punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\s+", ""), r"^[,.;:!?]+|[,.;:!?]+$", "")


def fingerprint(c: Column | str) -> Column:
    """SHA-256 of the UTF-8 text."""
    return F.sha2(_c(c), 256)


def set_fingerprint(order: str, c: str) -> Column:
    """An aggregate: one hash of the texts of a group in their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, fingerprint(c).alias("h")))), lambda r: r["h"]), ""), 256)


def position(text: Column | str, quote: Column | str) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.call_function("instr", _c(text), _c(quote)) - 1


def span_of(text: Column | str, quote: Column | str) -> Column:
    """struct(start, end) of the first occurrence in code points, end exclusive; null if there is none."""
    at = position(text, quote)
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.char_length(_c(quote))).alias("end")))


def quote_holds(text: Column | str, quote: Column | str, start: Column | str, end: Column | str) -> Column:
    """The quote is exactly what stands at its offsets."""
    return F.substring(_c(text), _c(start) + 1, _c(end) - _c(start)) == _c(quote)


def cells(c: Column | str) -> Column:
    """Cells of a pipe-table row, trimmed."""
    inner = F.regexp_replace(F.trim(_c(c)), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def is_separator_row(c: Column | str) -> Column:
    """A row of dashes and colons alone."""
    return _c(c).rlike(r"^\s*\|?(\s*:?-{3,}:?\s*\|)+\s*(:?-{3,}:?)?\s*\|?\s*$")


def markdown_row(values: Column | str) -> Column:
    """An array of cells as a table row; pipes escaped, line ends as <br>."""
    safe = F.transform(_c(values), lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), "\n", "<br>"))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def bigrams(value: str) -> list[str]:
    """The distinct character pairs of a query, white space left out."""
    v = re.sub(r"\s+", "", value)
    return sorted({v[i : i + 2] for i in range(len(v) - 1)})


def contained_either_way(a: Column | str, b: Column | str) -> Column:
    """D22."""
    return F.contains(_c(a), _c(b)) | F.contains(_c(b), _c(a))


def token_count(c: Column | str) -> Column:
    """D9, offline: a word or a single Chinese character is a token, and so is any other sign."""
    return F.regexp_count(_c(c), F.lit("[㐀-鿿]|[\\p{L}\\p{N}&&[^㐀-鿿]]+|[^\\s\\p{L}\\p{N}]"))


@F.pandas_udf(StringType())
def canonical_name(names: pd.Series) -> pd.Series:
    """G1: NFKC, case folded, white space as one blank, commas and full stops off the ends. Spark has no NFKC, so Arrow."""

    def one(x):
        return None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).casefold()).strip().strip("，,。.").strip()

    return names.map(one)


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; no built-in equals it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])
