"""Text functions on columns."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapsed(text: Column) -> Column:
    """Runs of blanks (Unicode ones too) as single spaces, cut at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def grounding_tokens(text: Column) -> Column:
    """Distinct words of four or more Latin letters or digits, and runs of three or more kanji or
    katakana, of lower-case text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-z0-9]{4,}|[一-鿿゠-ヿ]{3,})"), 1))


# Marks and full-width letters and digits that count as their ASCII forms when a quote is
# looked for leniently; an ellipsis counts as three dots.
_FOLDED = "“”„‟＂‘’‚‛＇—–―ー─" + "".join(chr(0xFF10 + k) for k in range(10)) + "".join(chr(0xFF41 + k) for k in range(26))
_PLAIN = '"' * 5 + "'" * 5 + "-" * 5 + "0123456789abcdefghijklmnopqrstuvwxyz"


def folded_marks(text: Column) -> Column:
    """Collapsed lower-case text with such marks in their ASCII forms."""
    plain = F.translate(F.lower(collapsed(text)), _FOLDED, _PLAIN)
    return collapsed(F.replace(F.replace(plain, F.lit("…"), F.lit("...")), F.lit("‥"), F.lit("...")))


def text_tokens(text: Column) -> Column:
    """ceil(0.4 x ASCII + 1.5 x other UTF-16 units)."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    units = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.ceil(F.lit(0.4) * ascii_ + F.lit(1.5) * (units - ascii_)).cast("long")


@F.pandas_udf(T.StringType())
def concept_slug(label: pd.Series) -> pd.Series:
    """NFKC, lower case, runs of what is neither letter nor digit as one hyphen."""

    def slug(x):
        if x is None:
            return None
        folded = unicodedata.normalize("NFKC", x).lower()
        return "-".join("".join(c if c.isalnum() else " " for c in folded).split())

    return label.map(slug)


@F.pandas_udf(T.StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    """The first balanced JSON object or array in a text (brackets in strings do not count), if it
    can be parsed; else null. For the texts that are not JSON as a whole."""

    def find(x):
        if x is None:
            return None
        for start in (i for i, c in enumerate(x) if c in "{["):
            try:
                value, _ = json.JSONDecoder().raw_decode(x[start:])
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False)
        return None

    return text.map(find)


def model_json(text: Column) -> Column:
    """JSON of model text: the text if it is JSON, else what balanced_json finds in it."""
    bare = F.trim(F.regexp_replace(text, r"```(json)?", ""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(balanced_json(text))
