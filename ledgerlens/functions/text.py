"""Text cleaning and tokenisation as Spark Column expressions.

All functions take and return ``Column``s, so they run inside whole-stage
codegen (regexes compile once per task) and need no Python worker.
"""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NULL_SENTINEL

# Fixed values.  Python's ``\s`` (str.isspace) is wider than Java's default
# ``\s``; this explicit class is the Python set, valid in Java and RE2 alike.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"
# Letters kept by the accent-preserving normaliser (plus digits, space, hyphen).
ACCENTED_LETTERS = "àâäéèêëïîôùûüçœæ"
# After normalisation only these accented letters survive; unicode accent
# stripping maps them as follows (œ and æ have no decomposition and stay).
ACCENT_FROM = "àâäéèêëïîôùûüç"
ACCENT_TO = "aaaeeeeiiouuuc"
BREAK_TAG = r"(?i)<br" + WS_CLASS + r"*/?>"
ANY_TAG = r"<[^>]+>"
WORD_TOKEN = r"(?U)\b\w\w+\b"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col: str | Column) -> Column:
    """Runs of (Python) whitespace → one space, then trim."""
    return F.trim(F.regexp_replace(_c(col), WS_RUN, " "))


def _entity_tables() -> tuple[str, str, dict[int, str]]:
    """(JSON of all named references, pattern of those valid without a semicolon, odd code points).

    All from the standard library's HTML5 table: nothing is listed here."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    odd = {n: html.unescape(f"&#{n};") for n in range(0xA0)}
    return json.dumps(html5), "^(" + "|".join(bare) + ")", {n: t for n, t in odd.items() if t != chr(n)}


_NAMED, _BARE, _ODD = _entity_tables()


def _code_point(n: Column) -> Column:
    """Character of a numeric reference, by the HTML rules for invalid ones."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    odd = F.from_json(F.lit(json.dumps({str(k): v for k, v in _ODD.items()})), "map<string,string>")
    low = n.bitwiseAND(0xFFFF)
    return (F.when(n < 0xA0, F.coalesce(F.try_element_at(odd, n.cast("string")), char))
            .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\uFFFD"))
            .when(n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE), F.lit(""))
            .otherwise(char))


def _after_ampersand(p: Column) -> Column:
    """Text after an ampersand, with a reference at its start decoded (else the ampersand is put back)."""
    digits = F.regexp_extract(p, "^#([0-9]+);?", 1)
    hexed = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
    number = F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(0x110000))).otherwise(
        F.when(F.length(F.ltrim(hexed, F.lit("0"))) > 6, F.lit(0x110000)).otherwise(F.conv(hexed, 16, 10).cast("bigint")))
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    closed, bare = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(p, _BARE, 1)
    tail = lambda head: F.substring(p, F.length(head) + 1, F.length(p))
    return (F.when((digits != "") | (hexed != ""), F.concat(_code_point(number), F.regexp_replace(p, "^#([0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .otherwise(F.coalesce(
                F.when(closed != "", F.concat(F.try_element_at(named, closed), tail(closed))),
                F.when(bare != "", F.concat(F.try_element_at(named, bare), tail(bare))),
                F.concat(F.lit("&"), p))))


#: The usual references.  A text with no others is decoded by plain replacement, ``&amp;`` last.
COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "#x27": "'", "nbsp": "\u00a0", "copy": "©",
          "middot": "·", "amp": "&"}


def decode_entities(col: str | Column) -> Column:
    """Decode all HTML character references in one pass: named ones (also the legacy ones without semicolon)
    and numeric ones.  A text without ampersand is returned as it is, and one with nothing but common
    references takes a short way; others are cut at their ampersands and looked up."""
    raw = _c(col)
    short = raw
    for name, char in COMMON.items():
        short = F.replace(short, F.lit(f"&{name};"), F.lit(char))
    others = F.regexp_replace(raw, "&(?:" + "|".join(COMMON) + ");", "").contains("&")
    parts = F.split(raw, "&", -1)
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(
        F.transform(F.slice(parts, F.lit(2), F.size(parts)), _after_ampersand), ""))
    return F.when(~raw.contains("&"), raw).when(~others, short).otherwise(decoded)


def _without_tags(raw: Column) -> Column:
    """References decoded, ``<br>`` and tags turned into spaces.  A text without ampersand and ``<`` is left as it is.

    A text that still holds a ``<`` then (an unclosed or empty tag, a plain sign) goes through the rules of an HTML
    parser once more: nothing after it can close, so all of it is text, whose character references are decoded."""
    text = decode_entities(raw)
    text = F.regexp_replace(text, BREAK_TAG, " ")
    text = F.regexp_replace(text, ANY_TAG, " ")
    # bound to a variable, so that the text is worked out once, however often it is referred to
    text = F.element_at(F.transform(F.array(text), lambda t: F.when(
        t.contains("<") & t.contains("&"), decode_entities(t)).otherwise(t)), 1)
    return F.when(raw.contains("&") | raw.contains("<"), text).otherwise(raw)


def strip_html(col: str | Column) -> Column:
    """sentinel/empty → ""; decode entities; ``<br>`` → space; tags → space;
    collapse whitespace; trim."""
    raw = _c(col)
    return (F.when(raw.isNull() | (raw == "") | (raw == NULL_SENTINEL), F.lit(""))
             .otherwise(collapse_ws(_without_tags(raw))))


def _kept_runs(text: Column, keep: str) -> Column:
    """The runs of ``keep`` characters, joined by one space.  Finding them costs a third of replacing what lies between."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[{keep}\\-]+"), F.lit(0)), " ")


def normalize_text(col: str | Column, preserve_accents: bool = True) -> Column:
    """Lower, collapse, keep [a-z0-9 -] (plus French accents), collapse, trim."""
    keep = "a-z0-9" + (ACCENTED_LETTERS if preserve_accents else "")
    # white space is not kept either, so every run of other characters becomes a space
    return _kept_runs(F.lower(F.coalesce(_c(col), F.lit(""))), keep)


def normalize_html(col: str | Column) -> Column:
    """C2 of C1, ``normalize_text(strip_html(col))``: its white space need not be collapsed twice."""
    raw = _c(col)
    return normalize_text(F.when((raw == "") | (raw == NULL_SENTINEL), F.lit("")).otherwise(_without_tags(raw)))


def clean_for_extraction(col: str | Column) -> Column:
    """Decode entities, ``&nbsp;`` → space, collapse whitespace; tags are kept.
    Null, "", "NULL" and "nan" (any case) → ""."""
    raw = _c(col)
    text = F.replace(decode_entities(raw), F.lit("&nbsp;"), F.lit(" "))
    return (F.when(raw.isNull() | (raw == "") | (raw == NULL_SENTINEL)
                   | (F.lower(raw) == "nan"), F.lit(""))
             .otherwise(collapse_ws(text)))


def strip_accents(col: str | Column) -> Column:
    """C4: unicode accent stripping, exact on normalised text."""
    return F.translate(_c(col), ACCENT_FROM, ACCENT_TO)


def word_tokens(col: str | Column) -> Column:
    """tokens = runs of two or more word characters (Unicode-aware)."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_TOKEN), 0)


def word_ngrams(tokens: str | Column, n_min: int = 1, n_max: int = 2) -> Column:
    """All n-grams of consecutive tokens for n in [n_min, n_max], space-joined.

    Built from shifted slices zipped together: every array argument is
    evaluated once per row (a lambda that referred to the token array would
    re-evaluate it for every element)."""
    toks = _c(tokens)
    size = F.size(toks)
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(toks)
            continue
        count = F.greatest(size - (n - 1), F.lit(0))
        shifted = [F.slice(toks, k + 1, count) for k in range(n)]
        zipped = F.arrays_zip(*[s.alias(f"t{k}") for k, s in enumerate(shifted)])
        parts.append(F.when(size >= n, F.transform(zipped, _join_fields(n)))
                     .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def _join_fields(n: int):
    # one-argument lambdas only: a two-argument lambda is (element, index)
    return lambda z: F.concat_ws(" ", *[z[f"t{k}"] for k in range(n)])


def _char_gram_pattern(n: int) -> str:
    """n characters inside one space-padded word: spaces only at the ends."""
    w = "[^ ]"
    alts = [f"{w}{{{n}}}", f" {w}{{{n - 1}}}", f"{w}{{{n - 1}}} ", f" {w}{{{n - 2}}} "]
    return "(?=(" + "|".join(alts) + "))"


def char_wb_ngrams(col: str | Column, n_min: int = 3, n_max: int = 5) -> Column:
    """T4: character n-grams inside words, each word padded by one space on both
    sides: every n-gram with n_min <= n <= min(n_max, padded length).

    Words are re-joined with two spaces and padded, so each padded word stands
    alone; a look-ahead capture then returns every overlapping n-gram whose
    spaces sit only at its ends -- exactly the grams of single padded words.
    One JVM regex pass per n (no per-word lambdas).  Order is by position per
    n, the multiset equals the per-word enumeration."""
    text = F.regexp_replace(F.trim(F.regexp_replace(_c(col), WS_RUN, " ")), " ", "  ")
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    grams = [F.regexp_extract_all(padded, F.lit(_char_gram_pattern(n)), 1)
             for n in range(n_min, n_max + 1)]
    return F.when(F.length(text) == 0, F.array().cast("array<string>")) \
            .otherwise(F.flatten(F.array(*grams)))
