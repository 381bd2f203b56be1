"""Column functions against values worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from docspark.functions import constants as K
from docspark.functions import counters, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


def test_spaces(spark):
    assert one(spark, text.normal_spaces(F.col("t")), t="a \n  b\t\tc　d\xa0e") == "a b c d e"
    assert one(spark, text.normal_spaces(F.col("t")), t=" \n ") == ""
    assert one(spark, text.normal_spaces(F.col("t")), t="　") == " "
    assert one(spark, text.strip(F.col("t")), t="  a b\x1c") == "a b"
    every = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert one(spark, text.without_spaces(F.col("t")), t=f"a{every}b") == "ab"


@pytest.mark.parametrize(
    "line,want", [("# a", "\\# a"), ("#a", "#a"), ("> q", "\\> q"), ("|x", "\\|x"), (" --- ", "\\ --- "), ("--", "--"), ("a", "a"), ("", "")]
)
def test_escape_line(spark, line, want):
    assert one(spark, text.escape_line(F.col("t")), t=line) == want


def test_cells_and_rows(spark):
    assert one(spark, text.table_cell(F.col("t")), t=" a|b\nc ") == "a\\|b<br>c"
    assert one(spark, text.sheet_cell(F.col("t")), t="a|<b>") == "a\\|&lt;b&gt;"
    assert one(spark, text.split_row(F.col("t")), t="| a \\| b | c\\\\ |d|") == ["a | b", "c\\", "d"]
    for row, want in (("|---|:-:|", True), ("--", True), ("", False), ("| a |", False)):
        assert one(spark, text.is_separator_row(F.col("t")), t=row) is want
    assert one(spark, text.number_text(F.col("v"), F.col("f")), v=2.5, f="0.00") == "2.50"
    assert one(spark, text.number_text(F.col("v"), F.col("f")), v=7.0, f="") == "7"


def test_titles_and_names(spark):
    assert one(spark, text.plain_title(F.col("t")), t="**a** [b](c) `d` *e* ~~f~~") == "a b d e f"
    assert one(spark, text.plain_title(F.col("t")), t="****") == K.EMPTY_TITLE
    assert one(spark, text.safe_name(F.col("t")), t='a/b c?"') == "a_b_c__"
    assert one(spark, text.auto_title(F.col("t"), F.lit("stem")), t="---\nx: 1\ntitle: 'T'\n---\n# a") == "T"
    assert one(spark, text.auto_title(F.col("t"), F.lit("stem")), t="\n# a") is None
    assert one(spark, text.auto_title(F.col("t"), F.lit("stem")), t="a") == "stem"
    assert one(spark, text.is_bold_font(F.col("t")), t="Arial-Black") is True
    assert one(spark, text.is_bold_font(F.col("t")), t="黑体".encode().decode("latin-1")) is True
    assert one(spark, text.is_bold_font(F.col("t")), t="Arial") is False


def test_quotes_and_pages(spark):
    assert one(spark, text.curly_quotes(F.col("t")), t='"a" b "c"') == "“a” b “c”"
    assert one(spark, text.curly_quotes(F.col("t")), t='"a') == '"a'
    assert one(spark, text.pages_of(F.col("t")), t="5-7, 1,6") == [1, 5, 6, 7]
    for bad in ("7-5", "a", "1,,2", ""):
        assert one(spark, text.pages_of(F.col("t")), t=bad) is None
    assert one(spark, text.padded(F.col("n"), F.lit(9)), n=3) == "03"
    assert one(spark, text.padded(F.col("n"), F.lit(1234)), n=56) == "0056"
    box = one(spark, text.crop_box(F.lit(0.1), F.lit(0.0), F.lit(0.55), F.lit(1.0), F.lit(10), F.lit(20)))
    assert tuple(box) == (1, 0, 5, 20)
    assert one(spark, text.crop_box(F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(10), F.lit(20))) is None
    with pytest.raises(re.error):
        text.title_patterns(["("], F.lit(""))


def test_inline_and_style(spark):
    runs = one(spark, text.inline_tokens(F.col("t")), t="a **b** [c](d)<br>")
    assert [(r["kind"], r["text"], r["href"]) for r in runs] == [("text", "a ", ""), ("bold", "b", ""), ("text", " ", ""), ("link", "c", "d"), ("break", "", "")]
    style = one(spark, text.style_map(F.col("t")), t="```yaml\na:\n  b: 1\n  c: 'x'\nd: 2\n```")
    assert style == {"a.b": "1", "a.c": "x", "d": "2"}


WORDS = {
    "lowerLetter": {0: "", 1: "a", 26: "z", 27: "aa", 52: "az", 53: "ba", 703: "aaa"},
    "upperRoman": {1: "I", 4: "IV", 9: "IX", 49: "XLIX", 1994: "MCMXCIV"},
    "lowerRoman": {0: "i", 14: "xiv"},
    "chineseCounting": {0: "0", 1: "一", 10: "十", 11: "十一", 20: "二十", 105: "一百零五", 110: "一百一十", 1005: "一千零五", 1010: "一千零一十", 2024: "二千零二十四"},
    "chineseLegalSimplified": {3: "叁", 12: "拾贰", 101: "壹佰零壹"},
    "ideographDigital": {10: "一〇", 2024: "二〇二四"},
    "decimalEnclosedCircle": {1: "①", 20: "⑳", 21: "㉑", 36: "㊱", 50: "㊿", 51: "51"},
    "ordinal": {1: "1st", 2: "2nd", 3: "3rd", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 111: "111th"},
    "cardinalText": {1: "one", 19: "nineteen", 20: "twenty", 42: "forty-two", 100: "one hundred", 342: "three hundred and forty-two", 1001: "one thousand one"},
    "ordinalText": {1: "first", 2: "second", 12: "twelfth", 20: "twentieth", 21: "twenty-first", 100: "one hundredth", 9: "ninth"},
    "hex": {10: "A", 255: "FF"},
    "aiueo": {1: "あ", 2: "い", 48: "ん", 49: "あ"},
    "iroha": {1: "い", 2: "ろ"},
    "decimal": {7: "7"},
    "unknown": {7: "7"},
}


def test_counters(spark):
    rows = [(f, n, want) for f, values in WORDS.items() for n, want in values.items()]
    df = spark.createDataFrame(rows, "f string, n int, want string")
    bad = [tuple(r) for r in df.withColumn("got", counters.counter(F.col("n"), F.col("f"))).collect() if r["got"] != r["want"]]
    assert not bad
