"""Number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_double(x: Column) -> Column:
    """The shortest decimal text of a double, never with an exponent: 3, 0.25, 100000000000000000000."""
    text = x.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.regexp_replace(text, "^-", "")
    exponent = F.coalesce(F.nullif(F.regexp_extract(bare, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole = F.regexp_extract(bare, r"^(\d+)", 1)
    part = F.regexp_replace(F.regexp_extract(bare, r"\.(\d+)", 1), "^0$", "")
    digits = F.concat(whole, part)
    point = F.length(whole) + exponent
    left = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), F.greatest(point, F.lit(1)), "0"))
    right = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substring(digits, point + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    out = F.concat(sign, left, F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))
    return F.when(F.isnan(x) | text.contains("Infinity"), F.regexp_replace(F.regexp_replace(text, "Infinity", "Inf"), "^Inf", "+Inf")).otherwise(out)
