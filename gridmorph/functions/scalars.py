"""Scalar cleaning: numbers, labels, names and paths, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value as a double; null if it is no number, NaN or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number(c: Column) -> Column:
    """The value as a double; null if it is no number or NaN; infinities stay."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def truthy(c: Column) -> Column:
    """Whether a flag of any type says true: true, 1, "True", "true" or "1"; null says no."""
    return F.coalesce(c.cast("string").isin("true", "True", "1"), F.lit(False))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether a is b to within absolute + relative * |b|."""
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where both are finite and b is not 0, else null."""
    return F.when(finite(b) != 0, finite(a) / F.nullif(finite(b), F.lit(0.0)))


def least_present(*c: Column) -> Column:
    """The least of the values that are there."""
    return F.least(*c)


def looked_up(table: dict, key: Column, default) -> Column:
    """The key's value in a small table, or the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def listed(text: Column, kind: str = "string") -> Column:
    """The entries of a comma-separated list, trimmed, empty ones left out; an empty list is an error."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.when(F.size(parts) > 0, F.transform(parts, lambda x: x.cast(kind))).otherwise(F.raise_error(F.lit("at least one value is required")).cast(f"array<{kind}>"))


def general(c: Column, digits: int = 6) -> Column:
    """A number in at most ``digits`` significant digits without trailing zeros, as ``%g`` writes it; null and NaN give the empty text."""
    size = F.floor(F.log10(F.abs(c)))
    # rounding may carry into a further digit, which the rounded value's own size shows
    scaled = F.rint(c * F.pow(F.lit(10.0), digits - 1 - size)) / F.pow(F.lit(10.0), digits - 1 - size)
    rounded = F.floor(F.log10(F.abs(scaled)))
    plain = F.regexp_replace(F.regexp_replace(scaled.cast("decimal(38,10)").cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    mantissa = F.regexp_replace(F.format_string(f"%.{digits - 1}e", c), "\\.?0+e", "e")
    text = F.when(c == 0, "0").when((rounded >= -4) & (rounded < digits), plain).otherwise(mantissa)
    return F.when(c.isNull() | F.isnan(c), "").otherwise(text)


def pixel_label(px: Column) -> Column:
    return F.concat(F.lit("px_"), F.replace(general(px), F.lit("."), F.lit("p")), F.lit("m"))


def order_key(q: Column) -> Column:
    """Column name of a generalized dimension: Dq_2, Dq_-1, Dq_m0p5."""
    encoded = F.replace(F.replace(q.cast("string"), F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))
    return F.concat(F.lit("Dq_"), F.when(q == F.floor(q), F.floor(q).cast("int").cast("string")).otherwise(encoded))


def folded(text: Column) -> Column:
    """A name for comparison: decomposed, without combining marks, case-folded, runs of anything but Latin and Cyrillic letters and digits as one space."""

    @F.pandas_udf("string")
    def fold(s):
        import unicodedata

        def one(x):
            return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

        return s.map(one)

    # names of ASCII characters, which are most, need no Python
    return F.trim(F.regexp_replace(F.coalesce(fold(text), F.lit("")), "[^a-z0-9а-я]+", " "))


def site_title(folder: Column, *names: Column) -> Column:
    """The first name that is there, else the folder's without its resolution."""
    given = [F.when(F.length(n) > 0, n) for n in names]
    return F.coalesce(*given, F.regexp_replace(folder, "_(25|50|100)m$", ""))


def path_part(path: Column, from_end: int) -> Column:
    """The part of a path that is the from_end-th from its end (1: the last)."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def joined_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def tail(text: Column, n: int = 2000) -> Column:
    """The last n characters."""
    return F.right(text, F.lit(n))


def osm_reference(kind: Column, number_: Column) -> Column:
    """R, W or N and the number of a relation, way or node."""
    prefix = F.create_map(*[F.lit(x) for x in ("relation", "R", "way", "W", "node", "N")])
    return F.concat(F.try_element_at(prefix, F.lower(kind)), number_.cast("long").cast("string"))


def every(*conditions: Column) -> Column:
    """Whether all conditions hold; null does not."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])
