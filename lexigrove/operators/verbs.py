"""Steps on tagged words; a tagger is a function from words to tags that the user brings."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import text as X

# Tags whose words are not indexed, and the tag patterns of separable verbs, the first that fits counts.
EXCLUDED_TAGS = ["$.", "CARD", "$,", "$(", "ITJ"]
VERB_PATTERNS = [
    ["V.*", ".*", "PTKVZ"],
    ["V.*", "(ART|PIAT)?", "(PTKA)?", "(ADJA)?", "NN", "APPR"],
    ["V.*", "(ART|PIAT)?", "(CARD|PIDAT|PROAV)?", "NN", "APPR"],
    ["V.*", "NE|PPER", "APPR"],
    ["V.*", "(ADV)?", "APPR"],
]
TAGGED = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("pos", T.StringType())]))


def features(words: list[str], at: int, history: list[str]) -> dict[str, str | None]:
    """What a tagger that goes from left to right knows of a word: itself, the two before it and their tags."""
    word = words[at]
    back = lambda xs, k: xs[at - k] if at >= k else None
    prevword, prevtag, prevprevtag = back(words, 1), back(history, 1), back(history, 2)
    return {
        "word": word, "lower": word.lower(), "suffix3": word.lower()[-3:], "prefix1": word[:1], "prevword": prevword, "prevprevword": back(words, 2),
        "prevtag": prevtag, "prevprevtag": prevprevtag, "prevword+word": f"{prevword}+{word}", "prevtag+word": f"{prevtag}+{word}", "prevprevtag+word": f"{prevprevtag}+{word}", "shape": shape_of(word),
    }


def shape_of(word: str) -> str:
    return next((name for name, pattern in X.SHAPES if re.match(pattern, word)), "other")


def sequential(classify: Callable[[dict[str, str | None]], str]) -> Callable[[list[str]], list[str]]:
    """A tagger that gives one word after the other to a classifier of its features."""

    def run(words: list[str]) -> list[str]:
        tags: list[str] = []
        for at in range(len(words)):
            tags.append(classify(features(words, at, tags)))
        return tags

    return run


def tag(words: Column, tagger: Callable[[list[str]], list[str]]) -> Column:
    """array<string> to array<struct<word, pos>>."""

    @F.pandas_udf(TAGGED)
    def run(batches: pd.Series) -> pd.Series:
        return batches.map(lambda ws: [{"word": w, "pos": t} for w, t in zip(ws, tagger(list(ws)), strict=True)])

    return run(words)


def kept_by_tag(tagged: Column) -> Column:
    """Without excluded tags and words of one character."""
    return F.filter(tagged, lambda x: ~x["pos"].isin(EXCLUDED_TAGS) & (F.length(x["word"]) > 1))


def _match(tags: list[str], at: int, pattern: list[str]) -> int | None:
    """End of the pattern that begins at a place, optional parts taken where they fit."""
    if not pattern:
        return at
    part = pattern[0]
    optional = part.startswith("(") and part.endswith(")?")
    if at < len(tags) and re.fullmatch(part.rstrip("?") if optional else part, tags[at]):
        end = _match(tags, at + 1, pattern[1:])
        if end is not None:
            return end
    return _match(tags, at, pattern[1:]) if optional else None


def merge_verbs(pairs: list[tuple[str, str]], is_word: Callable[[str], bool]) -> list[tuple[str, str]]:
    """Joins particle and verb where the joined word exists; the verb's place is used and the particle's goes."""
    tags, out, gone = [t for _, t in pairs], list(pairs), set()
    at = 0
    while at < len(pairs):
        end = next((e for p in VERB_PATTERNS if (e := _match(tags, at, p)) is not None), None)
        if end is None:
            at += 1
            continue
        joined = pairs[end - 1][0] + pairs[at][0]
        if is_word(joined):
            out[at] = (joined, pairs[at][1])
            gone.add(end - 1)
        at = end
    return [x for i, x in enumerate(out) if i not in gone]


def merged_verbs(tagged: Column, is_word: Callable[[str], bool]) -> Column:
    @F.pandas_udf(TAGGED)
    def run(batches: pd.Series) -> pd.Series:
        return batches.map(lambda ps: [{"word": w, "pos": t} for w, t in merge_verbs([(p["word"], p["pos"]) for p in ps], is_word)])

    return run(tagged)


#: Tags of nouns, which may make a compound, and the tag of an apostrophe's s.
NOUNS, PRONOUN = ("NN", "NE"), "PPER"


def join_nouns(pairs: list[tuple[str, str]], is_word: Callable[[str], bool]) -> list[tuple[str, str]]:
    """Joins nouns that follow each other, or a noun, an 's and nouns, where the joined word exists; the first one's place is used and the others go."""
    out, at = [], 0
    while at < len(pairs):
        end = at
        while end < len(pairs) and pairs[end][1] in NOUNS:
            end += 1
        if end == at + 1 and end < len(pairs) and pairs[end][1] == PRONOUN:
            end += 1
            while end < len(pairs) and pairs[end][1] in NOUNS:
                end += 1
        joined = "".join(w if k == at else w.lower() if t in NOUNS else "s" if w == "'s" else "" for k, (w, t) in enumerate(pairs[at:end], at))
        if end - at > 1 and is_word(joined):
            out.append((joined, "NN"))
        else:
            end = max(end, at + 1)
            out += pairs[at:end]
        at = end
    return out


def joined_nouns(tagged: Column, is_word: Callable[[str], bool]) -> Column:
    @F.pandas_udf(TAGGED)
    def run(batches: pd.Series) -> pd.Series:
        return batches.map(lambda ps: [{"word": w, "pos": t} for w, t in join_nouns([(p["word"], p["pos"]) for p in ps], is_word)])

    return run(tagged)


def stemmed(word: Column, stems: Callable[[str], list[str]]) -> Column:
    """The last stem that a dictionary, which the user brings, gives for a word, or the word itself."""

    @F.pandas_udf(T.StringType())
    def run(words: pd.Series) -> pd.Series:
        known = {w: (stems(w) or [w])[-1] for w in set(words.dropna())}
        return pd.Series([known.get(w) for w in words], dtype=object)

    return run(word)


def indexed_words(sentences: Column, tagger: Callable[[list[str]], list[str]], is_word: Callable[[str], bool], compounds: bool = False) -> Column:
    """array<array<string>>, the words of each sentence, to array<string>: tagged by sentence, compound nouns joined (if asked for), verbs merged, and without excluded tags and single letters."""

    def one(words: list[str]) -> list[str]:
        pairs = list(zip(words, tagger(words), strict=True))
        if compounds:
            pairs = join_nouns(pairs, is_word)
        return [w for w, t in merge_verbs(pairs, is_word) if t not in EXCLUDED_TAGS and len(w) > 1]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if ss is None else [w for s in ss if len(s) for w in one(list(s))] for ss in texts], dtype=object)

    return run(sentences)
