"""Signals of garbled text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def reasons(n: Column, n_invalid: Column, n_latin: Column, top: Column, n_top: Column, mojibake: Column) -> Column:
    """Names of the rules that hold; none for short texts."""
    rules = F.array(
        F.when(n_invalid / n >= K.GARBLE_INVALID_SHARE, F.lit("invalid")),
        F.when(n_latin / n >= K.GARBLE_LATIN_SHARE, F.lit("latin1")),
        F.when(
            (n >= K.GARBLE_TOP_MIN_CHARS)
            & (n_top / n >= K.GARBLE_TOP_SHARE)
            & (F.ascii(top) > 127)
            & ~F.lit(K.TOP_CHARS_KEPT).contains(top),
            F.lit("repeated"),
        ),
        F.when(mojibake, F.lit("mojibake")),
    )
    return F.when(n >= K.GARBLE_MIN_CHARS, F.array_compact(rules)).otherwise(F.array().cast("array<string>"))


def suspect_ratio(n: Column, n_invalid: Column, n_latin: Column, n_top: Column) -> Column:
    return F.when(n >= K.GARBLE_MIN_CHARS, F.greatest(n_invalid / n, n_latin / n, n_top / n)).otherwise(F.lit(0.0))
