"""Error classification, masking and canonical JSON as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import (CARD_MASK, CARD_PATTERN, EMAIL_MASK, EMAIL_PATTERN, ERROR_RULES)


def classify_error(raw: Column, quarantined: Column | None = None) -> Column:
    """The first matching rule names the class; no match is ``unknown``, null text is
    the empty class and a quarantined task is always ``loop``."""
    low = F.lower(raw)
    out = F.when(raw.isNull(), "")
    if quarantined is not None:
        out = F.when(quarantined, "loop").when(raw.isNull(), "")
    for name, words in ERROR_RULES:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]),
                       name)
    return out.otherwise("unknown")


def mask_personal_data(text: Column) -> Column:
    """E-mail addresses and card numbers. The regex runs only on texts that can
    match, so most rows pay for one substring search."""
    mails = F.when(F.contains(text, F.lit("@")),
                   F.regexp_replace(text, EMAIL_PATTERN, EMAIL_MASK)).otherwise(text)
    return F.regexp_replace(mails, CARD_PATTERN, CARD_MASK)


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null when the text is not valid JSON."""
    return F.to_json(F.try_parse_json(text))
