"""Text functions as Column expressions; only Unicode normalisation and the phrase map need an Arrow UDF.

Word characters are [\\p{L}\\p{N}_] and white space is Unicode's, in every function.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = "\\p{L}\\p{N}_"
EDGE = " .,!?~-"
PHONE_MARK = "<phone>"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; null stays null. Only text with characters beyond ASCII is sent to Python."""
    return F.coalesce(_composed(F.when(F.octet_length(text) != F.length(text), text)), text)


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def comparison_key(text: Column) -> Column:
    """What exact de-duplication compares: NFC, lower case, single spaces, no blanks or marks at the ends; '' for null."""
    folded = F.lower(nfc(F.coalesce(text, F.lit(""))))
    return F.btrim(F.regexp_replace(folded, "(?U)\\s+", " "), F.lit(EDGE))


def raw_text(text: Column) -> Column:
    """NFC without white space at the ends; '' for null."""
    return F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), "(?U)^\\s+|\\s+$", "")


def tokens(text: Column) -> Column:
    """Array of what white space separates; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def mask_phones(text: Column) -> Column:
    """Phone numbers, whole or partly hidden by x, become a mark; prices, which a point or digit precedes, stay.

    Fixed value: the pattern, which sets what counts as a number.
    """
    return F.regexp_replace(text, f"(?iU)(?<![{WORD}.,])(?:\\+?84|0|x{{2,}})[\\d\\s.\\-x]{{7,12}}\\d", PHONE_MARK)


def cleaned(text: Column) -> Column:
    """Marks, tags, links, addresses and odd characters out; a space after a mark that a letter follows.

    Fixed values: the patterns and their order, which set the cleaned text.
    """
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(PHONE_MARK), F.lit(" "))
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, "(?U)https?://\\S+|www\\.\\S+", " ")
    t = F.regexp_replace(t, "(?U)\\S+@\\S+\\.\\S+", " ")
    t = F.regexp_replace(t, f"(?U)[^{WORD}\\s.,!?;:()\\-/%'\"]", " ")
    t = F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), "([.,!?;:])(?=\\p{L})", "$1 ")
    return one_spaced(t)


def _tone_moves() -> list[tuple[str, str]]:
    """Old to new place of the tone mark in open syllables: on the first vowel of oa, oe and (not after q) uy."""
    tones = ("̀", "́", "̉", "̃", "̣")
    join = lambda a, b: unicodedata.normalize("NFC", a + b)
    open_ = f"(?![{WORD}])"
    moves = [("o" + join(v, t) + open_, join("o", t) + v) for v in "ae" for t in tones]
    return moves + [("(?<![qQ])u" + join("y", t) + open_, join("u", t) + "y") for t in tones]


#: What every pattern of _tone_moves() begins with.
_OLD_TONES = "o[àáảãạèéẻẽẹ]|u[ỳýỷỹỵ]"


def normalized(text: Column) -> Column:
    """NFC, new tone places (lower case only), letters repeated three times or more and repeated marks once."""
    t, moved = nfc(text), nfc(text)
    for old, new in _tone_moves():
        moved = F.regexp_replace(moved, old, new)
    t = F.when(t.rlike(_OLD_TONES), moved).otherwise(t)  # few texts have any
    t = F.regexp_replace(t, "(\\p{L})\\1{2,}", "$1")
    return F.regexp_replace(t, f"(?U)([^{WORD}\\s])\\1+", "$1")


def corrector(mapping: Mapping[str, str]) -> Callable[[Column], Column]:
    """Whole words and phrases by their replacement: any case, longest key first, replacements not looked at again.

    The keys are in lower case. What matches but has no key in lower case stays as it is.
    """
    keys = "|".join(re.escape(k) for k in sorted(mapping, key=len, reverse=True))
    find = re.compile(rf"(?<!\w)({keys})(?!\w)", re.IGNORECASE) if mapping else None
    known = dict(mapping)

    @F.pandas_udf(StringType())
    def correct(text: pd.Series) -> pd.Series:
        return text.map(lambda t: find.sub(lambda m: known.get(m[0].lower(), m[0]), t) if find else t, na_action="ignore")

    return correct


def joined_compounds(phrases: Collection[str], longest: int = 4) -> Callable[[Column], Column]:
    """A segmenter: the longest phrase of the list at each place becomes one token, its words joined by underscores."""
    known = {tuple(p.lower().split()) for p in phrases}
    firsts = {p[0] for p in known if p}  # most words begin no phrase and are looked up once

    def segment(text: str) -> str:
        words, out, i = text.split(), [], 0
        while i < len(words):
            if words[i].lower() not in firsts:
                out.append(words[i])
                i += 1
                continue
            n = next((n for n in range(min(longest, len(words) - i), 1, -1) if tuple(w.lower() for w in words[i : i + n]) in known), 1)
            out.append("_".join(words[i : i + n]))
            i += n
        return " ".join(out)

    @F.pandas_udf(StringType())
    def segmented(text: pd.Series) -> pd.Series:
        return text.map(segment, na_action="ignore")

    return segmented


def unsegmented(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def content_words(segmented: Column, stop: Collection[str] = (), keep: Collection[str] = ()) -> Column:
    """Tokens without odd characters and outer underscores; those under two characters, without a letter or stopped go.

    A word of keep is never stopped.
    """
    bare = F.transform(tokens(segmented), lambda t: F.btrim(F.regexp_replace(t, f"[^{WORD}]", ""), F.lit("_")))
    out = F.filter(bare, lambda t: (F.length(t) >= 2) & t.rlike("\\p{L}"))
    drop = sorted(set(stop) - set(keep))
    return F.array_join(F.filter(out, lambda t: ~t.isin(drop)) if drop else out, " ")


def model_text(text: Column, correct=None, segment=None, stop: Collection[str] = (), keep: Collection[str] = ()) -> Column:
    """Text for bag-of-words models: cleaned, normalised, lower case, corrected, segmented, content words only."""
    return words_text(normalized(cleaned(nfc(F.coalesce(text, F.lit(""))))), correct, segment, stop, keep)


def words_text(plain: Column, correct=None, segment=None, stop: Collection[str] = (), keep: Collection[str] = ()) -> Column:
    """model_text() of a text that is cleaned and normalised."""
    t = F.lower(plain)
    t = correct(t) if correct else t
    return content_words(segment(t) if segment else t, stop, keep)


def sequence_text(text: Column, correct=None, segment=None) -> Column:
    """Text for sequence models: cleaned, normalised, corrected and segmented, case, marks and stop words kept."""
    return running_text(normalized(cleaned(nfc(F.coalesce(text, F.lit(""))))), correct, segment)


def running_text(plain: Column, correct=None, segment=None) -> Column:
    """sequence_text() of a text that is cleaned and normalised."""
    t = correct(plain) if correct else plain
    return segment(t) if segment else t
