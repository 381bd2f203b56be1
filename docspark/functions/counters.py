"""Counters of numbered lists in the formats that word processors know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

FORMATS = (
    "decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "chineseCounting", "chineseCountingThousand",
    "chineseLegalSimplified", "ideographDigital", "decimalEnclosedCircle", "aiueo", "iroha", "ordinal", "ordinalText",
    "cardinalText", "hex",
)

ONES, TENS, ORDINALS = K.ONES, K.TENS, K.ORDINALS


def _pick(words, i: Column) -> Column:
    """Word number i, from 1; empty beyond either end."""
    return F.coalesce(F.get(F.array(*[F.lit(w) for w in words]), (i - 1).cast("int")), F.lit(""))


def letters(n: Column, upper: bool = False) -> Column:
    """a to z, then aa, ab and so on; empty from 0 down."""
    first = 65 if upper else 97
    state = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        more = acc["rest"] > 0
        rest = acc["rest"] - 1
        return F.struct(
            F.when(more, F.floor(rest / 26)).otherwise(acc["rest"]).cast("bigint").alias("rest"),
            F.when(more, F.concat(F.char((rest % 26 + first).cast("int")), acc["out"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), state, step, lambda acc: acc["out"])


def roman(n: Column, upper: bool = False) -> Column:
    """Roman numerals place by place; 0 gives i, as the smallest one."""

    def place(power: int, one: str, five: str, ten: str) -> Column:
        digit = F.floor(n / power) % 10
        return _pick([one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten], digit)

    out = F.concat(
        F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(100, "c", "d", "m"), place(10, "x", "l", "c"), place(1, "i", "v", "x")
    )
    out = F.when(out == "", F.lit("i")).otherwise(out)
    return F.upper(out) if upper else out


def chinese(n: Column, digits: str, units: str, zero: str) -> Column:
    """Chinese numerals with the rule for zeros, for 1 to 9999; decimal beyond."""

    def place(power: int, unit: str) -> Column:
        return F.when(F.floor(n / power) % 10 > 0, F.concat(_pick(digits, F.floor(n / power) % 10), F.lit(unit))).otherwise(F.lit("0"))

    full = F.concat(place(1000, units[2]), place(100, units[1]), place(10, units[0]), place(1, ""))
    full = F.regexp_replace(full, "^0+|0+$", "")
    full = F.regexp_replace(full, "0+", zero)
    # Ten to nineteen go without the leading one.
    full = F.when((n >= 10) & (n < 20), F.substring(full, 2, 10)).otherwise(full)
    return F.when((n > 0) & (n < 10000), full).otherwise(n.cast("string"))


def cardinal(n: Column) -> Column:
    """English words below a million; 0 and beyond are decimal."""

    def below_hundred(x: Column) -> Column:
        one = x % 10
        tail = F.when(one > 0, F.concat(F.lit("-"), _pick(ONES, one))).otherwise(F.lit(""))
        return F.when(x < 20, _pick(ONES, x)).otherwise(F.concat(_pick(TENS, F.floor(x / 10)), tail))

    def below_thousand(x: Column) -> Column:
        rest = x % 100
        tail = F.when(rest > 0, F.concat(F.lit(" and "), below_hundred(rest))).otherwise(F.lit(""))
        return F.when(x < 100, below_hundred(x)).otherwise(F.concat(_pick(ONES, F.floor(x / 100)), F.lit(" hundred"), tail))

    rest = n % 1000
    tail = F.when(rest > 0, F.concat(F.lit(" "), below_thousand(rest))).otherwise(F.lit(""))
    thousands = F.concat(below_thousand(F.floor(n / 1000)), F.lit(" thousand"), tail)
    return F.when(n < 1, n.cast("string")).when(n < 1000, below_thousand(n)).when(n < 1000000, thousands).otherwise(n.cast("string"))


def ordinal_words(n: Column) -> Column:
    """first, second, twenty-first; the last word alone changes."""
    words = cardinal(n)
    last = F.regexp_extract(words, r"([a-z]+)$", 1)
    head = F.substring(words, F.lit(1), F.length(words) - F.length(last))
    changed = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))
    for plain, special in ORDINALS.items():
        changed = F.when(last == plain, F.lit(special)).otherwise(changed)
    return F.when(last == "", n.cast("string")).otherwise(F.concat(head, changed))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    suffix = F.when(teen, F.lit("th"))
    for digit, text in ((1, "st"), (2, "nd"), (3, "rd")):
        suffix = suffix.when(n % 10 == digit, F.lit(text))
    return F.concat(n.cast("string"), suffix.otherwise(F.lit("th")))


def circled(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, base in K.CIRCLED:
        signs = F.array(*[F.lit(chr(base + i)) for i in range(hi - lo + 1)])
        out = F.coalesce(out, F.when(n.between(lo, hi), F.get(signs, (n - lo).cast("int"))))
    return F.coalesce(out, n.cast("string"))


def _cycle(signs: str, n: Column) -> Column:
    return F.when(n < 1, n.cast("string")).otherwise(_pick(signs, F.pmod(n - 1, F.lit(len(signs))) + 1))


def counter(n: Column, fmt: Column) -> Column:
    """A counter's text in one of :data:`FORMATS`; other formats are decimal."""
    digits = F.translate(n.cast("string"), "0123456789", K.IDEOGRAPHS)
    known = {
        "lowerLetter": letters(n),
        "upperLetter": letters(n, upper=True),
        "lowerRoman": roman(n),
        "upperRoman": roman(n, upper=True),
        "chineseCounting": chinese(n, K.CN_DIGITS, K.CN_UNITS, K.CN_ZERO),
        "chineseCountingThousand": chinese(n, K.CN_DIGITS, K.CN_UNITS, K.CN_ZERO),
        "chineseLegalSimplified": chinese(n, K.LEGAL_DIGITS, K.LEGAL_UNITS, K.CN_ZERO),
        "ideographDigital": F.when(n < 10000, digits).otherwise(n.cast("string")),
        "decimalEnclosedCircle": circled(n),
        "aiueo": _cycle(K.AIUEO, n),
        "iroha": _cycle(K.IROHA, n),
        "ordinal": ordinal(n),
        "ordinalText": ordinal_words(n),
        "cardinalText": cardinal(n),
        "hex": F.hex(n.cast("bigint")),
    }
    out = F.when(fmt == "decimal", n.cast("string"))
    for name, text in known.items():
        out = out.when(fmt == name, text)
    return out.otherwise(n.cast("string"))
