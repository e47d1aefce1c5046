"""Text functions over columns: words, lines, n-grams, normalisation, masks, markup, heuristics."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line breaks of Unicode, as classes that Java and RE2 read alike.
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

#: The same for Java, where single characters below 256 are one look-up and the others are tried only within their range; a character of a break; an ellipsis that ends a line, white space aside.
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
SPACES_JVM = rf"[\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x{{85}}\x{{A0}}{_WIDE}]+"
_BREAK = r"[\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}]"
_ELLIPSIS = rf"\.\.\.[\x09\x1F\x20\x{{A0}}{_WIDE}&&[^\x{{2028}}\x{{2029}}]]*+(?={_BREAK}|\z)"

# Patterns and replacements of the masks, the pre-token pattern, thresholds of the heuristics.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\b(?:\+?1[\s.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
EMAIL_MARK, PHONE_MARK, IP_MARK = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Java, whose own white space is ASCII; the pattern means Unicode's property, which has no separators U+001C to U+001F.
_WHITE = SPACES.replace(r"\x1C-\x20", r"\x20")[1:-2]
PRETOKEN_JVM = PRETOKEN.replace(r"[^\s", "[^" + _WHITE).replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
# A word boundary of Unicode letters and numbers: Java's own is that of ASCII words.
_W = r"[\p{L}\p{N}_]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _unicode(pattern: str) -> str:
    """A mask's pattern for Java with Unicode's white space and word boundaries."""
    return pattern.replace(r"\b", _EDGE).replace(r"\s", SPACES[1:-2])


PHONE_JVM, IPV4_JVM = _unicode(PHONE), _unicode(IPV4)
MIN_WORDS, MAX_WORDS, MIN_MEAN, MAX_MEAN, MAX_ELLIPSIS, MIN_ALPHA = 50, 100_000, 3, 10, 0.3, 0.8


def words(text: Column) -> Column:
    """Maximal runs without Unicode white space; null gives null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def lines(text: Column) -> Column:
    """Lines at all Unicode breaks; a final break does not begin another line."""
    parts = F.split(text, BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def one_line(text: Column) -> Column:
    """Line feeds and returns become one space each."""
    return F.translate(text, "\n\r", "  ")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and their base letters, from Unicode's own tables."""
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize(text: Column) -> Column:
    """Lower case, no accents, no punctuation (underscore stays), single spaces, no space at the ends.

    Letters are decomposed by a table, so the plan stays in the JVM. Hangul syllables
    stay composed, which does not change which texts are equal.
    """
    plain = F.regexp_replace(F.translate(F.lower(text), *_accents()), r"\p{Mn}", "")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_" + SPACES[1:-2] + "]", ""), SPACES, " "))


def ngrams(text: Column, n: int) -> Column:
    """The distinct word n-grams; fewer words are one n-gram, none gives none."""
    made = F.transform(
        F.array(words(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) < n, F.array(F.array_join(w, " ")))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))),
    )
    return made[0]


def mask(text: Column, pattern: str, mark: str) -> Column:
    """``struct(text, n)``: the text with each match replaced, and the number of matches."""
    return F.struct(F.regexp_replace(text, pattern, mark).alias("text"), F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).alias("n"))


def mask_emails(text: Column) -> Column:
    return mask(text, EMAIL, EMAIL_MARK)


def mask_phones(text: Column) -> Column:
    return mask(text, PHONE_JVM, PHONE_MARK)


def mask_ips(text: Column) -> Column:
    return mask(text, IPV4_JVM, IP_MARK)


#: Elements whose content is no text, elements that end a line, and character references in the order of their decoding.
DROPPED = ("head", "script", "style", "noscript", "template")
LINE_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
REFERENCES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&"))


def html_to_text(page: Column) -> Column:
    """All visible text of a page, a line for each block element; rules of our own, in built-in functions only."""
    text = F.regexp_replace(page, "(?s)<!--.*?-->", " ")
    for name in DROPPED:
        text = F.regexp_replace(text, f"(?is)<{name}\\b.*?</{name}\\s*>", " ")
    text = F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{LINE_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(F.regexp_replace(text, " *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def decode_bytes(payload: Column, errors: str = "replace") -> Column:
    """UTF-8 text of a binary column: bad bytes replaced, dropped with ``ignore``, or the whole null with ``strict``."""
    if errors == "strict":
        return F.try_validate_utf8(payload.cast("string"))
    if errors == "ignore":
        return F.pandas_udf(_without_bad_bytes, "string")(payload)
    return F.make_valid_utf8(payload.cast("string"))


def _without_bad_bytes(payload: pd.Series) -> pd.Series:
    """In Arrow batches: a replacement character of the text itself must stay, which no built-in tells from a bad byte."""
    return payload.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


#: Characters of the common western encoding where ISO 8859-1 has controls: 0x80 to 0x9F, undefined ones as they are.
_WESTERN = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace").replace("\ufffd", "")
_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", errors="replace") != "\ufffd")


def decode_page(payload: Column) -> Column:
    """Text of a page in the encoding that it shows: a byte order mark, valid UTF-8, a name in its first 1024 bytes, else western.

    Of named encodings those of Unicode and the western ones are known; bytes in others
    are read as western, so that markup and ASCII are right at least. Null gives null.
    """
    byte = F.decode(payload, "ISO-8859-1")
    named = F.lower(F.regexp_extract(F.substring(byte, 1, 1024), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))
    western = F.translate(byte, _CONTROLS, _WESTERN)
    utf8 = F.try_validate_utf8(payload.cast("string"))
    return (
        F.when(byte.startswith("\u00ef\u00bb\u00bf"), F.make_valid_utf8(F.substring(payload, F.lit(4), F.length(payload)).cast("string")))
        .when(byte.startswith("\u00ff\u00fe") | byte.startswith("\u00fe\u00ff"), F.decode(payload, "UTF-16"))
        .when(utf8.isNotNull(), utf8)
        .when(named.isin("utf-8", "utf8"), F.make_valid_utf8(payload.cast("string")))
        .otherwise(western)
    )


def heuristics(text: Column) -> dict[str, Column]:
    """Measures and verdicts of the quality heuristics; each rule is a column, so that a reason can be told."""
    text = F.coalesce(text, F.lit(""))
    # A blank before, between and after words; what is rare is matched, so that no array of words or lines is made.
    spaced = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), SPACES_JVM, " ")
    solid = F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    n_words = F.length(spaced) - solid - 1
    pairs = F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    open_end = (text != "") & ~F.substring(text, -1, 1).rlike(_BREAK)
    return {
        "n_words": n_words.cast("long"),
        "n_chars_in_words": solid.cast("long"),
        "n_lines": (F.regexp_count(text, F.lit(_BREAK)) - pairs + open_end.cast("int")).cast("long"),
        "n_ellipsis": F.regexp_count(text, F.lit(_ELLIPSIS)).cast("long"),
        "n_alpha": (n_words - F.regexp_count(spaced, F.lit(r" [^ \p{L}]++(?= )"))).cast("long"),
    }


#: Verdicts over the measures, in the order in which they are tried; SQL that Spark and DuckDB share.
RULES = {
    "count_ok": f"n_words BETWEEN {MIN_WORDS} AND {MAX_WORDS}",
    "length_ok": f"n_words > 0 AND n_chars_in_words >= {MIN_MEAN} * n_words AND n_chars_in_words <= {MAX_MEAN} * n_words",
    "ellipsis_ok": f"10 * n_ellipsis <= {round(10 * MAX_ELLIPSIS)} * n_lines",
    "alpha_ok": f"10 * n_alpha >= {round(10 * MIN_ALPHA)} * n_words",
}
