"""Personal names: cleaning and keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalized_name(name: Column) -> Column:
    """The name without outer blanks and with inner blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(name, r"[\s 　]+", " "), "^ +| +$", "")


@F.pandas_udf(StringType())
def _casefold(names: pd.Series) -> pd.Series:
    return names.map(lambda v: None if v is None else v.casefold())


def name_key(name: Column) -> Column:
    """Key under which a name is unique: normalised, and case-folded (which is
    more than lower case: sharp s equals ss)."""
    return _casefold(normalized_name(name))


def valid_name(name: Column) -> Column:
    """1 to 64 characters, none of them a control or format character."""
    clean = normalized_name(name)
    return ~clean.rlike(r"\p{C}") & (F.char_length(clean) >= 1) & (F.char_length(clean) <= 64)


#: Outer blanks, the no-break and the ideographic space included.
BLANKS = r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$"


def strip(text: Column | str) -> Column:
    """The text without outer blanks of any kind."""
    return F.regexp_replace(text, BLANKS, "")


def strip_sql(sql: str) -> str:
    """The same in SQL: ``trim(x)`` spelled out."""
    import re

    return re.sub(r"trim\(((?:[^()]|\([^()]*\))*)\)", lambda m: f"regexp_replace({m[1]}, '{BLANKS}', '', 'g')", sql)
