"""Column names as expressions: cleaning, normalising, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that say nothing about a field.
STOP_TOKENS = ("id", "ids", "no", "num", "nr", "code", "cd", "key", "flag", "is", "has", "at", "dt", "ts", "ref", "uid")


def clean(name: Column) -> Column:
    """Trimmed; an underscore before each capital but the first character; lower case; spaces as underscores."""
    name = F.trim(name)
    split = F.concat(F.substring(name, 1, 1), F.regexp_replace(F.substring(name, 2, 1 << 20), "([A-Z])", "_$1"))
    return F.replace(F.lower(split), F.lit(" "), F.lit("_"))


def normalized(name: Column) -> Column:
    """Cleaned; only a-z, 0-9 and single underscores between."""
    return F.regexp_replace(F.regexp_replace(clean(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(name: Column) -> Column:
    """Words of the normalised name without stop tokens; duplicates stay."""
    return F.filter(F.split(normalized(name), "_"), lambda x: (x != "") & ~x.isin(*STOP_TOKENS))
