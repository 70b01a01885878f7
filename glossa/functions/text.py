"""Cleaning, normalising and tokenising of text columns, as native expressions."""

from __future__ import annotations

import hashlib
import html
import unicodedata
from functools import reduce
from itertools import islice
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glossa.functions import rules

#: Upper-case Roman numerals that stand alone: no letter, digit or underscore of any script beside them.
ROMAN = r"(?<![\p{L}\p{N}_])[IVXLCDM]{2,}(?![\p{L}\p{N}_])"
SPACES = r"(?U)\s+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(c: str | Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


@F.arrow_udf(StringType())
def _unescaped(c: pa.Array) -> pa.Array:
    """One text at a time: a batch's texts and results are never all Python strings at once."""
    done = (pa.array([html.unescape(x.as_py()) if x.is_valid else None], pa.string()) for x in c)
    slices = iter(lambda: list(islice(done, 256)), [])
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.concat_arrays(s) for s in slices)])


def unescaped(c: str | Column) -> Column:
    """All HTML entities decoded, named and numeric; only texts that hold an ampersand go through Python."""
    c = col(c)
    return F.coalesce(_unescaped(F.when(F.contains(c, F.lit("&")), c)), c)


def clean_article(c: str | Column, min_len: int = 50) -> Column:
    """Headers, wiki markup and stray tags out, each leaving a blank; null for what is left shorter than min_len."""
    out = unescaped(c)
    for pattern in (rules.HEADER, rules.MARKUP, "(?i)" + rules.MARKUP_ANY_CASE, rules.STRAY):
        out = F.regexp_replace(out, pattern, " ")
    out = collapsed(out)
    return F.when(F.length(out) >= min_len, out)


def clean_plainly(c: str | Column, min_len: int = 50) -> Column:
    """`clean_article` as the queries' SQL has it, natively: entities without a semicolon and those beyond a few stay,
    only blanks of ASCII are collapsed, and any blanks at the ends go."""
    out = col(c)
    for entity, character in rules.ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(character))
    out = F.regexp_replace(out, "&amp;?", "&")
    for pattern in (rules.HEADER, rules.PLAIN_MARKUP, rules.PLAIN_MARKUP_ANY_CASE, rules.STRAY, r"[\t\n\f\r ]+"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"^\p{Zs}+|\p{Zs}+\z", "")
    return F.when(F.length(out) >= min_len, out)


def _folding() -> tuple[str, str]:
    """Characters below U+2000 that decompose to one letter and combining marks, and those letters."""
    found = {}
    for i in range(0xC0, 0x2000):
        base = [x for x in unicodedata.normalize("NFD", chr(i)) if not 0x300 <= ord(x) <= 0x36F]
        if len(base) == 1 and base[0] != chr(i):
            found[chr(i)] = base[0]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(found) + marks, "".join(found.values())


FOLD_FROM, FOLD_TO = _folding()


def without_diacritics(c: str | Column) -> Column:
    """Letters without combining marks, precomposed or not."""
    return F.translate(col(c), FOLD_FROM, FOLD_TO)


ONE_FOR_ONE = {a: b for a, b in rules.LETTERS.items() if len(b) == 1}
SPELLED_OUT = {a: b for a, b in rules.LETTERS.items() if len(b) > 1 and a == a.lower()}


def aggressive_normalise(c: str | Column) -> Column:
    """a-z and single blanks only: special letters spelled out, upper-case Roman numerals and digits out, marks off."""
    out = F.translate(F.replace(col(c), F.lit("ß"), F.lit("ss")), "".join(ONE_FOR_ONE), "".join(ONE_FOR_ONE.values()))
    out = F.lower(F.regexp_replace(out, ROMAN, " "))
    for a, b in SPELLED_OUT.items():
        out = F.replace(out, F.lit(a), F.lit(b)) if a != "ß" else out
    return collapsed(F.regexp_replace(without_diacritics(out), r"[^a-z\s]", " "))


def is_sentence(c: str | Column, min_len: int = 30) -> Column:
    """Long enough, with a lower-case word, and ended like a sentence."""
    c = col(c)
    last = F.substring(F.regexp_replace(c, r"(?U)\s+$", ""), -1, 1)
    return (F.length(c) >= min_len) & c.rlike("[a-z]") & c.rlike(r"(?U)(^|\s)[a-z]") & last.isin(rules.TERMINATORS)


def native_drop(c: str | Column, code: str | Column) -> Column:
    """Whether a variety's rules for native text drop a sentence."""
    c, code = col(c), col(code)
    out = F.lit(False)
    for k, subs in rules.NATIVE_SUBSTRINGS.items():
        hay = F.lower(c) if k == "vec" else c
        held = reduce(or_, [F.contains(hay, F.lit(s)) for s in subs])
        out = out | ((code == k) & held)
    for k, patterns in rules.NATIVE_PATTERNS.items():
        out = out | ((code == k) & reduce(or_, [c.rlike("(?iU)" + p) for p in patterns]))
    return out | ((code == "lmo") & (F.length(c) < 14))


def rule_drop(c: str | Column, code: str | Column, groups: dict[str, list[tuple[str, ...]]] | None = None, max_len: int = 500) -> Column:
    """Whether normalised text is too long or holds all strings of one of its variety's groups."""
    c, code = col(c), col(code)
    out = F.length(c) > max_len
    for k, gs in (groups or rules.DROP_GROUPS).items():
        table = F.array(*[F.array(*map(F.lit, g)) for g in gs])
        out = out | ((code == k) & F.exists(table, lambda g: F.forall(g, lambda s: F.contains(c, s))))
    return out


#: Blanks after the end of a sentence; quotes and brackets that close there belong to it.
AFTER_END = r"(?<=[" + rules.SENTENCE_END + "][" + rules.CLOSERS.replace("]", r"\]") + r"]{0,8})\s++"


def merged_sentences(c: str | Column) -> Column:
    """Split after terminators; a fragment that begins in lower case belongs to the sentence before it.

    No split is made there in the first place, so a text of any number of sentences takes one pass.
    """
    parts = F.transform(F.split(col(c), AFTER_END + r"(?!\p{IsLowercase})"), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), AFTER_END + r"(?=\p{IsLowercase})", " "))
    return F.filter(parts, lambda s: s != "")


def fingerprint(c: str | Column) -> Column:
    """Roman numerals as R, digits as N, lower case: sentences that differ in numbers only are alike."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), ROMAN, "R"), r"(?U)\d+", "N"))


def for_words(c: str | Column, lower: bool = True, mask: str | None = "#", strip_punct: bool = True) -> Column:
    out = F.lower(col(c)) if lower else col(c)
    if mask is not None:
        out = F.regexp_replace(out, r"\d+", mask)
    if strip_punct:
        out = F.regexp_replace(out, r"[!-/:-@\[-`{-~«»‘’“”–—…]", " ")
    return collapsed(out)


def letter_tokens(c: str | Column) -> Column:
    """Runs of letters, kept together over apostrophes."""
    run = r"[\p{L}\p{Nl}\p{No}]+"
    return F.regexp_extract_all(col(c), F.lit(f"{run}(?:[’']{run})*"), F.lit(0))


def blank_tokens(c: str | Column) -> Column:
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def clean_cell(c: str | Column) -> Column:
    """A table cell without footnotes, tags, entities and the blanks around it; fixed blanks are blanks."""
    out = F.regexp_replace(F.regexp_replace(col(c), r"(?s)<sup.*?</sup>", ""), r"<[^>]+>", "")
    return F.regexp_replace(F.translate(unescaped(out), "\u00a0", " "), r"(?U)^\s+|\s+$", "")


def language_code(c: str | Column) -> Column:
    name = F.lower(F.trim(col(c)))
    table = F.create_map(*[F.lit(x) for kv in rules.LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def clean_prediction(c: str | Column) -> Column:
    """One numbering prefix, else one bullet, then one layer of matching quotes off."""
    s = F.trim(col(c))
    numbered = F.regexp_replace(s, r"^\s*\d+\s*[.):\]\-]\s+", "")
    s = F.trim(F.when(numbered != s, numbered).otherwise(F.regexp_replace(s, r"^\s*[-*•]\s+", "")))
    out = s
    for a, b in reversed(rules.QUOTES):
        out = F.when((F.length(s) >= 2) & F.startswith(s, F.lit(a)) & F.endswith(s, F.lit(b)), F.trim(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(out)
    return out


def sound_classes(word: str | Column, code: str | Column) -> Column:
    """A spelling as sound classes: letters only, the variety's digraphs in order, single letters, marks off."""
    code = col(code)
    base = F.replace(F.regexp_replace(F.lower(F.trim(col(word))), r"(?U)[^\w\s]", ""), F.lit(" "), F.lit(""))
    out = base
    for rows in dict.fromkeys(map(tuple, rules.SOUNDS.values())):
        one = base
        for a, b in rows:
            one = F.replace(one, F.lit(a), F.lit(b))
        out = F.when(code.isin([k for k, v in rules.SOUNDS.items() if tuple(v) == rows]), one).otherwise(out)
    return without_diacritics(F.translate(out, "".join(rules.SOUND_LETTERS), "".join(rules.SOUND_LETTERS.values())))


def edit_distance(a: str | Column, b: str | Column) -> Column:
    """Levenshtein by code points over the longer length; 0 for two empty strings, 1 for one."""
    a, b = col(a), col(b)
    return F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def classified_forms(cell: str | Column) -> Column:
    """Comma-separated forms of a cell as (form, gender): a trailing m, f or n mark off, glosses in brackets off."""
    parts = F.filter(F.transform(F.split(col(cell), ","), F.trim), lambda p: p != "")
    mark = r"\s+([mfn])\b(?:\s+(?:sg|pl|near|far))*\s*(?=$|\)|;|/)"
    gloss = lambda s: F.trim(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""))
    return F.transform(parts, lambda p: F.struct(gloss(F.regexp_replace(p, mark, "")).alias("form"), F.nullif(F.regexp_extract(p, mark, 1), F.lit("")).alias("gender")))


def masculine_feminine(cell: str | Column) -> Column:
    """(m, f) of a cell: the marked forms; else the first and second unmarked; else one form for both."""
    forms = classified_forms(cell)
    of = lambda *g: F.get(F.filter(forms, lambda x: x["gender"].isin(*g)), F.lit(0))["form"]
    plain = F.filter(forms, lambda x: x["gender"].isNull())
    m = F.coalesce(of("m", "n"), F.get(plain, F.lit(0))["form"], F.get(forms, F.lit(0))["form"], F.lit(""))
    second = F.when((F.size(plain) >= 2) & (m == F.get(plain, F.lit(0))["form"]), F.get(plain, F.lit(1))["form"])
    return F.struct(m.alias("m"), F.coalesce(of("f"), second, m).alias("f"))


def vocabulary_number(point: Column, ranges: list[tuple[int, int]] = rules.CODE_POINTS) -> Column:
    """A code point's number: 0 pads, 1 is unknown, then the ranges one after another."""
    out, at = F.lit(1), 2
    for a, b in ranges:
        out = F.when(point.between(a, b), point - a + at).otherwise(out)
        at += b - a + 1
    return out


def codepoint_index(c: str | Column, ranges: list[tuple[int, int]] = rules.CODE_POINTS) -> Column:
    """Characters as vocabulary numbers."""
    return F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: vocabulary_number(F.ascii(x), ranges))


#: Of numbers from -LOWEST on: decimal digits and a comma, in 8 bytes with zeros behind.
LOWEST = 100
_NUMERALS: list[np.ndarray] = []


def numerals(numbers: np.ndarray) -> bytes:
    """Decimal numbers joined by commas; from -100 to the last code point."""
    if not _NUMERALS:
        _NUMERALS.append(np.array([f"{i}," for i in range(-LOWEST, 0x110000)], "S8").view(np.uint64))
    return _NUMERALS[0][numbers + LOWEST].tobytes().translate(None, b"\0")[:-1]


def numbers_of(points: np.ndarray, ranges: list[tuple[int, int]] = rules.CODE_POINTS) -> np.ndarray:
    """Vocabulary numbers of code points, as vocabulary_number gives them."""
    out, at = np.ones(len(points), np.int32), 2
    for a, b in ranges:
        inside = (points >= a) & (points <= b)
        out[inside] = points[inside] - (a - at)
        at += b - a + 1
    return out


def points_of(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int32)


@F.arrow_udf(StringType())
def _index_md5(c: pa.Array) -> pa.Array:
    return pa.array([hashlib.md5(numerals(numbers_of(points_of(x.as_py())))).hexdigest() if x.is_valid else None for x in c], pa.string())


def codepoint_digest(c: str | Column) -> Column:
    """MD5 of a text's vocabulary numbers, joined by commas: the array of codepoint_index is never a column."""
    return _index_md5(col(c))
