"""Scalar columns: labels, numbers, ids, hashes, URLs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_marks

LABELS = ("Negative", "Neutral", "Positive")
#: Spellings of the labels.
ALIASES = {"pos": "Positive", "positive": "Positive", "neu": "Neutral", "neutral": "Neutral", "neg": "Negative", "negative": "Negative"}


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def star_label(star: Column) -> Column:
    """1, 2: Negative; 3: Neutral; 4, 5: Positive; else null."""
    return F.when(star.isin(1, 2), LABELS[0]).when(star == 3, LABELS[1]).when(star.isin(4, 5), LABELS[2])


def parsed_label(label: Column) -> Column:
    """A label from any of its spellings; null for blank, an error for anything else."""
    key = F.lower(F.trim(label))
    known = F.try_element_at(literal_map(ALIASES), key)
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string"))
    )


def parsed_confidence(value: Column) -> Column:
    return F.lower(F.trim(value))


def label_origin(source: Column) -> Column:
    """human for a person's label, llm_accepted for one accepted in bulk, llm for anything else."""
    return F.when(source == "nguoi", "human").when(source == "llm_chap_nhan", "llm_accepted").otherwise("llm")


def comma_number(text: Column) -> Column:
    """A number with a decimal comma or point; null if it is none."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def sold_count(text: Column) -> Column:
    """The number after "Đã bán", times 1000 if k follows; 0 without one.

    Fixed value: the shop's wording.
    """
    number = F.regexp_extract(text, "Đã bán ([\\d.,]+)\\s*(k?)", 1)
    times = F.when(F.regexp_extract(text, "Đã bán ([\\d.,]+)\\s*(k?)", 2) == "k", 1000.0).otherwise(1.0)
    return F.coalesce(F.when(F.coalesce(number, F.lit("")) != "", comma_number(number) * times), F.lit(0.0))


def url_segments(url: Column) -> Column:
    """Segments of a URL's path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.filter(F.split(F.btrim(path, F.lit("/")), "/"), lambda s: s != "")


def content_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, length)


def stable_hash(text: Column) -> Column:
    """First 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def slug(name: Column) -> Column:
    """Lower-case ASCII words joined by underscores."""
    plain = without_marks(F.translate(F.lower(name), "đ", "d"))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))


def numbered_id(prefix: str, width: int, number: Column) -> Column:
    """G001, G002, ...; wider numbers are kept whole."""
    return F.format_string(f"{prefix}%0{width}d", number)


def local_number(value: Column, digits: int = 0) -> Column:
    """Points between thousands and a decimal comma, rounded half up on the decimal digits."""
    return F.translate(F.format_number(F.round(value.cast("string").cast(f"decimal(30,{max(digits, 12)})"), digits), digits), ",.", ".,")


def translated(value: Column, names: Mapping[str, str]) -> Column:
    """A display name; a value without one stays."""
    return F.coalesce(F.try_element_at(literal_map(names), value), value)
