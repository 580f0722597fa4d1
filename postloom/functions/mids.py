"""Message-ID columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAND_IN_PREFIX = "no-id-"


def clean_mid(mid: Column) -> Column:
    """Without angle brackets, white space (also folded) and letter case; null when nothing is left."""
    bare = F.lower(F.regexp_replace(mid, r"[\s<>]+", ""))
    return F.when(bare != "", bare)


def is_stand_in(cleaned: Column) -> Column:
    """True for ids made up by the index, and for a missing id."""
    return cleaned.isNull() | cleaned.startswith(STAND_IN_PREFIX)
