"""Text clean-up as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spellings that say "nothing here" in name, session and
#: condition fields, after folding.
NOTHING = ("", "-", "--", "?", ".", "n/a", "na", "none", "null", "nil", "nan", "unknown", "unspecified", "undefined", "unnamed", "tbd", "tba", "todo", "missing", "empty", "x")


def _fold(text: str) -> str:
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in out if not c.isspace() and unicodedata.category(c)[0] not in "CZ")


@F.pandas_udf(StringType())
def _fold_udf(col: pd.Series) -> pd.Series:
    seen: dict = {}
    return col.map(lambda v: None if v is None else seen[v] if v in seen else seen.setdefault(v, _fold(v)))


def folded(col: Column | str) -> Column:
    """Compatibility-composed, case-folded text without blanks, control and
    invisible characters.  Null stays null.  Printable ASCII, the usual case,
    is folded by built-in functions; Python gets a null in its place."""
    c = F.col(col) if isinstance(col, str) else col
    plain = c.rlike(r"^[\x20-\x7e]*$")
    return F.when(plain, F.lower(F.regexp_replace(c, " +", ""))).otherwise(_fold_udf(F.when(~plain, c)))


def key_or_null(col: Column | str) -> Column:
    """``folded`` text, or null if it names nothing."""
    key = folded(col)
    return F.when(~key.isin(*NOTHING), key)
