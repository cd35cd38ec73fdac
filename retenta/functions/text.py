"""Text column helpers."""

from __future__ import annotations

import math
import re
from itertools import chain

from pyspark.sql import Column, functions as F

from retenta import schema

# Every character that counts as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(value: Column) -> Column:
    """Remove every kind of whitespace from both ends (plain ``trim`` handles blanks only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def folded(value: Column) -> Column:
    return F.lower(strip(value))


def normalise_name(value: Column) -> Column:
    """Header text to snake case."""
    out = folded(F.regexp_replace(value, "﻿", ""))
    out = F.regexp_replace(out, r"[\s\-\.]+", "_")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_]", "")
    return F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")


def normalise_header(name: str) -> str:
    """:func:`normalise_name` for a header on the driver."""
    out = re.sub(r"[\s\-.]+", "_", name.replace("﻿", "").strip().lower())
    return re.sub("_+", "_", re.sub(r"[^\w]", "", out)).strip("_")


def null_tokens(value: Column) -> Column:
    """Null where the text is one of the spellings of a missing value."""
    return F.when(~folded(value).isin(*schema.NULL_TOKENS), value)


def parse_number(value: Column) -> Column:
    """Number behind currency signs, thousands separators, percent signs and the Unicode minus.

    The shape test keeps out texts that a plain cast would take, such as a type suffix, NaN or infinity.
    """
    # One pass: the minus is replaced, every other listed character is dropped.
    bare = F.translate(value, "−₹$,%" + WHITESPACE, "-")
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def parse_label(value: Column) -> Column:
    """Binary label from its text spellings; null for anything else."""
    return literal_map(schema.LABEL_VALUES)[folded(value.cast("string"))]


def parse_gender(value: Column) -> Column:
    """Gender from its text spellings; other texts pass through."""
    return F.coalesce(literal_map(schema.GENDER_VALUES)[folded(value)], value)


def unfenced(value: Column) -> Column:
    """Body of the first ```json fence, else of the first plain fence, else the whole text."""
    tagged = F.regexp_extract(value, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(value, r"(?s)```(.*?)(?:```|$)", 1)
    return (F.when(F.contains(value, F.lit("```json")), strip(tagged))
            .when(F.contains(value, F.lit("```")), strip(plain))
            .otherwise(value))


def chunks(value: Column, size: int = 300, overlap: int = 50, longer_than: int = 30) -> Column:
    """Array of stripped overlapping windows of ``value`` with more than ``longer_than`` characters."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    body = strip(F.replace(value, F.lit("\x00"), F.lit("")))
    step = size - overlap
    unit = math.gcd(size, step)
    # The text is cut once into pieces of the greatest common length; a window is a run of pieces. Cutting every window
    # out of the whole text would walk it from the start each time.
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{unit}}}"), F.lit(0))

    def windows(p: Column) -> Column:
        last = F.ceil(F.size(p) / F.lit(step // unit)).cast("int") - 1
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                           lambda k: strip(F.array_join(F.slice(p, k * (step // unit) + 1, size // unit), "")))
        return F.filter(runs, lambda w: F.length(w) > longer_than)

    # Binding the pieces to a lambda variable evaluates them once per text.
    return F.coalesce(F.transform(F.array(pieces), windows)[0], F.array().cast("array<string>"))
