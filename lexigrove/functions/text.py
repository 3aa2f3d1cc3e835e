"""Analyzer rules as Column functions; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the analyzer, in Java's spelling and, where it differs, in RE2's.
SHY = "­"
HYPHEN = f"[-–{SHY}]"
TOKEN = r"[A-Za-zÄÖÜäöü][a-zäöüß\[A-ZÄÖÜ|–/.'’]*[A-ZÄÖÜa-zäöüß]"
COMPOUND = r"([A-ZÄÖÜ][a-zäöüß]*)" + HYPHEN + r"([A-ZÄÖÜ][a-zäöüß]*)"
WORD_JAVA, WORD_RE2 = r"\w", r"[\p{L}\p{N}_]"


def elision_head(word: str) -> str:
    return word + "+" + HYPHEN + r"([.,]|\sund\s)"


def elision_tail(word: str) -> str:
    return r"(\sund\s|,\s)" + HYPHEN + word + "+"


def expand_abbreviations(text: Column, pairs: Iterable[tuple[str, str]], case_insensitive: bool = False) -> Column:
    """Replaces ' abbr ' by ' expansion ', one entry after the other. Entries are folded but the text is not, unless asked for."""
    for abbr, expansion in pairs:
        old, new = f" {abbr.casefold()} ", f" {expansion.casefold()} "
        if case_insensitive:
            text = F.regexp_replace(text, F.lit(r"(?iu)\Q" + old + r"\E"), F.lit(new))
        else:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def collapse_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, HYPHEN + "{2}", "-")


def drop_elisions(text: Column) -> Column:
    """'An- und Abreise' becomes 'Abreise', 'Spielspaß und -freude' becomes 'Spielspaß'."""
    # from a word's first letter and without going back, so that a long word is read once
    text = F.regexp_replace(text, "(?U)" + elision_head(rf"(?<!{WORD_JAVA}){WORD_JAVA}+"), "")
    return F.regexp_replace(text, "(?U)" + elision_tail(WORD_JAVA), "")


def join_breaks(text: Column) -> Column:
    """Joins words that were broken at the end of a line or by a hyphen and a space."""
    text = F.regexp_replace(text, HYPHEN + r"[\n\r]+", "")
    text = F.regexp_replace(text, "(?U)" + HYPHEN + r"\s[\n\r]*", "")
    return F.regexp_replace(text, r"(?U)\s[-–]\s", " ")


def split_compounds(text: Column) -> Column:
    """'Data-Science' becomes 'Data Science DataScience'."""
    return F.regexp_replace(text, COMPOUND, "$1 $2 $1$2")


def delete_hyphens(text: Column) -> Column:
    return F.translate(text, f"-–{SHY}", "")


def normalize_hyphens(text: Column) -> Column:
    """All rules in their order; a text without any hyphen, to which none of them applies, is spared them."""
    rules = delete_hyphens(split_compounds(join_breaks(drop_elisions(F.translate(collapse_hyphens(text), "/", " ")))))
    return F.when(text.rlike(HYPHEN), rules).otherwise(F.translate(text, "/", " "))


def tokens(text: Column) -> Column:
    """The words of a text in order: letters first and last, two characters at least."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def casefold(word: Column) -> Column:
    """Case folding on the token alphabet, where only ß differs from lower case."""
    return F.replace(F.lower(word), F.lit("ß"), F.lit("ss"))


def sentences(text: Column, abbreviations: Iterable[str] = ()) -> Column:
    """Sentences end at . ! or ? before white space, but not at the period of an abbreviation, in any case."""
    end = r"(?<=[.!?])"
    known = "|".join(re.escape(a.rstrip(".")) for a in sorted(set(abbreviations)) if a.endswith("."))
    if known:
        end += rf"(?<!(?:^|[\s(])(?:{known})\.)"
    return F.filter(F.split(text, rf"(?iu){end}\s+"), lambda s: F.length(F.trim(s)) > 0)


# Word shapes in order of precedence, and what they are called. A word that begins with a
# digit is a number and one that begins with a small letter is downcase, whatever follows.
UPCASE = r"^[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]*(-[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]*)*-?$"
SHAPES = [("number", r"^[0-9]|^[.,][0-9]+$"), ("punct", r"^\W+$"), ("upcase", UPCASE), ("downcase", r"^[a-zäöüß]"), ("mixedcase", r"^\w")]


def shape(word: Column) -> Column:
    out = None
    for name, pattern in SHAPES:
        out = F.when(word.rlike("(?U)" + pattern), name) if out is None else out.when(word.rlike("(?U)" + pattern), name)
    return out.otherwise("other")
