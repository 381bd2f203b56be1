"""Queries on lists, tables, Markdown blocks and names, out of the business tables."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import counters, text
from ..operators import audit, blocks, layout, lines, numbering, tables
from ..sources import office
from .registry import query, table

WS = K.WS
_STRIP = f"'^{WS}+|{WS}+$'"
_DEPTH = 4


def _lists(spark, sf_dir):
    """Paragraphs of one list per supplier, and each list's levels."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    p = l.select(
        F.col("l_suppkey").alias("num_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * F.col("l_linenumber")) % _DEPTH).cast("int").alias("ilvl"),
    )
    ids = p.select("num_id").distinct().select("num_id", F.explode(F.sequence(F.lit(0), F.lit(_DEPTH - 1))).alias("ilvl"))
    h = F.col("num_id") * 5 + F.col("ilvl") * 3
    levels = ids.select(
        "num_id", "ilvl", F.when(h % 5 == 0, 0).when(h % 5 == 1, 3).otherwise(1).alias("start"), F.when(h % 7 == 0, 0).when(h % 7 == 1, 1).when(h % 7 == 2, 2).cast("int").alias("restart"),
        F.when(h % 11 == 0, 0).when(h % 11 == 1, 1).when(h % 11 == 2, 4).cast("int").alias("override"),
        F.element_at(F.array(*[F.lit(f) for f in ("decimal", "upperRoman", "lowerLetter")]), (h % 3 + 1).cast("int")).alias("fmt"),
        F.element_at(F.array(*[F.lit(".".join(f"%{i + 1}" for i in range(k + 1))) for k in range(_DEPTH)]), F.col("ilvl") + 1).alias("lvl_text"),
        (h % 4 == 0).alias("is_lgl"),
    )
    return numbering.dealt(p, ["num_id", "seq"]).dropDuplicates(["num_id", "seq"]), levels


_LISTS = f"""p AS (SELECT DISTINCT l_suppkey AS num_id, l_orderkey * 8 + l_linenumber AS seq, ((l_orderkey * 7 + l_linenumber * l_linenumber) % {_DEPTH})::INT AS ilvl FROM lineitem),
lv AS (SELECT num_id, k AS ilvl, num_id * 5 + k * 3 AS h FROM (SELECT DISTINCT num_id FROM p), (SELECT unnest(range({_DEPTH})) AS k)),
d AS (SELECT num_id, ilvl, h, CASE h % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS s, CASE h % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS r, CASE h % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 END AS o FROM lv),
e AS (SELECT p.*, d.ilvl AS k, s, r, o, h, row_number() OVER (PARTITION BY p.num_id, d.ilvl ORDER BY seq) AS t FROM p JOIN d USING (num_id)),
a AS (SELECT *, coalesce(ilvl < k AND (r IS NULL OR (r <> 0 AND r = ilvl)), false) AS rs, sum((ilvl = k)::INT) OVER w AS co,
  min(CASE WHEN ilvl = k OR (o IS NOT NULL AND ilvl >= k) THEN t END) OVER w AS e, min(CASE WHEN ilvl >= k THEN t END) OVER w AS tk, min(CASE WHEN ilvl = k THEN t END) OVER w AS f
  FROM e WINDOW w AS (PARTITION BY num_id, k ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, co - coalesce(max(CASE WHEN rs THEN co END) OVER w, 0) AS n, coalesce(max(CASE WHEN rs THEN t END) OVER w, -1) AS lr FROM a
  WINDOW w AS (PARTITION BY num_id, k ORDER BY seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, n - CASE WHEN f = tk THEN 1 ELSE 0 END AS m FROM b),
v AS (SELECT num_id, seq, ilvl, k, (CASE WHEN o IS NOT NULL AND tk IS NOT NULL AND tk > lr THEN CASE WHEN m = 0 OR f IS NULL THEN o WHEN o = 0 THEN CASE WHEN s = 0 THEN 0 ELSE s + m - 1 END ELSE o + m END
  WHEN n > 0 THEN CASE WHEN s = 0 THEN 0 ELSE s + n - 1 END WHEN e <= t THEN 0 ELSE s END)::INT AS v FROM c)"""


@query(f"WITH {_LISTS} SELECT num_id, seq, ilvl, " + ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS v{k}" for k in range(_DEPTH)) + " FROM v GROUP BY ALL")
def list_counters(spark, sf_dir):
    """Counters of every level after each paragraph."""
    p, levels = _lists(spark, sf_dir)
    return numbering.level_values(p, levels, ["num_id"], _DEPTH)


_ROMAN = " || ".join(
    f"['', {', '.join(repr(x) for x in (o, o * 2, o * 3, o + f, f, f + o, f + o * 2, f + o * 3, o + t))}][(v // {p}) % 10 + 1]"
    for p, o, f, t in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))
)
_SHOWN = f"""CASE WHEN lgl THEN v::VARCHAR WHEN fm = 1 THEN CASE WHEN v = 0 THEN 'I' ELSE repeat('M', v // 1000) || {_ROMAN} END
 WHEN fm = 2 THEN CASE WHEN v = 0 THEN '' WHEN v <= 26 THEN chr(96 + v) WHEN v <= 702 THEN chr(96 + (v - 1) // 26) || chr(97 + (v - 1) % 26) ELSE chr(96 + ((v - 1) // 26 - 1) // 26) || chr(97 + ((v - 1) // 26 - 1) % 26) || chr(97 + (v - 1) % 26) END ELSE v::VARCHAR END"""


@query(
    f"""WITH {_LISTS}, x AS (SELECT v.num_id, v.seq, v.ilvl, v.k, v.v, (d.h % 3) AS fm, (v.num_id * 5 + v.ilvl * 3) % 4 = 0 AS lgl FROM v JOIN d ON v.num_id = d.num_id AND v.k = d.ilvl WHERE v.k <= v.ilvl)
SELECT num_id, seq, ilvl, string_agg({_SHOWN}, '.' ORDER BY k) AS number FROM x GROUP BY ALL"""
)
def list_numbers(spark, sf_dir):
    """The number that each paragraph shows."""
    p, levels = _lists(spark, sf_dir)
    return numbering.numbers(p, levels, ["num_id"], _DEPTH).select("num_id", "seq", "ilvl", "number")


@query(
    """WITH n AS (SELECT DISTINCT l_linenumber * 13 + l_quantity::INT AS v FROM lineitem), w AS (
SELECT v, v::VARCHAR AS "decimal", CASE WHEN v <= 26 THEN chr(64 + v) ELSE chr(64 + (v - 1) // 26) || chr(65 + (v - 1) % 26) END AS "upperLetter",
 regexp_replace(regexp_replace(CASE WHEN v >= 100 THEN substr('一二三四五六七八九', v // 100, 1) || '百' ELSE '' END || CASE WHEN (v // 10) % 10 > 0 THEN CASE WHEN v < 20 THEN '' ELSE substr('一二三四五六七八九', (v // 10) % 10, 1) END || '十' ELSE '零' END
  || CASE WHEN v % 10 > 0 THEN substr('一二三四五六七八九', v % 10, 1) ELSE '零' END, '零+$', ''), '^零+', '') AS "chineseCounting",
 translate(v::VARCHAR, '0123456789', '〇一二三四五六七八九') AS "ideographDigital", CASE WHEN v <= 20 THEN chr(9312 + v - 1) WHEN v <= 35 THEN chr(12881 + v - 21) WHEN v <= 50 THEN chr(12977 + v - 36) ELSE v::VARCHAR END AS "decimalEnclosedCircle",
 v || CASE WHEN v % 100 BETWEEN 11 AND 13 THEN 'th' WHEN v % 10 = 1 THEN 'st' WHEN v % 10 = 2 THEN 'nd' WHEN v % 10 = 3 THEN 'rd' ELSE 'th' END AS "ordinal", upper(to_hex(v)) AS "hex" FROM n)
UNPIVOT w ON "decimal", "upperLetter", "chineseCounting", "ideographDigital", "decimalEnclosedCircle", "ordinal", "hex" INTO NAME fmt VALUE shown"""
)
def counter_formats(spark, sf_dir):
    return _counters(spark, sf_dir, ("decimal", "upperLetter", "chineseCounting", "ideographDigital", "decimalEnclosedCircle", "ordinal", "hex"))


def _counters(spark, sf_dir, formats):
    v = (F.col("l_linenumber") * 13 + F.col("l_quantity").cast("int")).alias("v")
    n = table(spark, sf_dir, "lineitem").select(v).distinct()
    n = n.select("v", F.explode(F.array(*[F.lit(f) for f in formats])).alias("fmt"))
    return n.select("v", "fmt", counters.counter(F.col("v"), F.col("fmt")).alias("shown"))


_ORDINAL_ONES = tuple(counters.ORDINALS.get(w, w + "th") for w in counters.ONES)
_ORDINAL_TENS = tuple("tenth" if w == "ten" else w[:-1] + "ieth" for w in counters.TENS)
# The words of 1 to 99, of which the last is an ordinal in the second form.
_BELOW = f"CASE WHEN x < 20 THEN {list(counters.ONES)}[x] ELSE {list(counters.TENS)}[x // 10] || CASE WHEN x % 10 > 0 THEN '-' || {list(counters.ONES)}[x % 10] ELSE '' END END"
_BELOW_TH = f"CASE WHEN x < 20 THEN {list(_ORDINAL_ONES)}[x] WHEN x % 10 = 0 THEN {list(_ORDINAL_TENS)}[x // 10] ELSE {list(counters.TENS)}[x // 10] || '-' || {list(_ORDINAL_ONES)}[x % 10] END"


def _chinese(digits: str, units: str) -> str:
    """SQL for the numerals of 14 to 199."""
    tens = f"CASE WHEN v // 10 % 10 > 0 THEN CASE WHEN v < 20 THEN '' ELSE substr('{digits}', v // 10 % 10, 1) END || '{units[0]}' ELSE '0' END"
    full = f"CASE WHEN v >= 100 THEN substr('{digits}', v // 100, 1) || '{units[1]}' ELSE '' END || {tens} || CASE WHEN v % 10 > 0 THEN substr('{digits}', v % 10, 1) ELSE '0' END"
    return f"regexp_replace(regexp_replace({full}, '0+$', ''), '0+', '{K.CN_ZERO}')"


@query(
    f"""WITH n AS (SELECT DISTINCT l_linenumber * 13 + l_quantity::INT AS v, (l_linenumber * 13 + l_quantity::INT) % 100 AS x FROM lineitem),
w AS (SELECT v, CASE WHEN v <= 26 THEN chr(96 + v) ELSE chr(96 + (v - 1) // 26) || chr(97 + (v - 1) % 26) END AS "lowerLetter", lower({_ROMAN}) AS "lowerRoman", {_ROMAN} AS "upperRoman",
 {_chinese(K.CN_DIGITS, K.CN_UNITS)} AS "chineseCountingThousand", {_chinese(K.LEGAL_DIGITS, K.LEGAL_UNITS)} AS "chineseLegalSimplified",
 substr('{K.AIUEO}', (v - 1) % {len(K.AIUEO)} + 1, 1) AS "aiueo", substr('{K.IROHA}', (v - 1) % {len(K.IROHA)} + 1, 1) AS "iroha",
 CASE WHEN v >= 100 THEN 'one hundred' || CASE WHEN x > 0 THEN ' and ' || {_BELOW} ELSE '' END ELSE {_BELOW} END AS "cardinalText",
 CASE WHEN x = 0 THEN 'one hundredth' WHEN v >= 100 THEN 'one hundred and ' || {_BELOW_TH} ELSE {_BELOW_TH} END AS "ordinalText" FROM n)
UNPIVOT w ON "lowerLetter", "lowerRoman", "upperRoman", "chineseCountingThousand", "chineseLegalSimplified", "aiueo", "iroha", "cardinalText", "ordinalText" INTO NAME fmt VALUE shown"""
)
def counter_words(spark, sf_dir):
    """The other formats: letters, numerals and words."""
    return _counters(spark, sf_dir, ("lowerLetter", "lowerRoman", "upperRoman", "chineseCountingThousand", "chineseLegalSimplified", "aiueo", "iroha", "cardinalText", "ordinalText"))


# Styles of 25 documents, each with ids of its own kind: chains that halve, and in every fifth one a single long chain; some end in a cycle.
_STYLES = """SELECT c_custkey % 25 AS doc, c_custkey // 25 AS style_id, CASE WHEN c_custkey % 25 % 5 = 0 THEN CASE WHEN c_custkey // 25 = 0 THEN 2 ELSE c_custkey // 25 - 1 END WHEN c_custkey % 6 > 0 THEN c_custkey // 50 END AS based_on,
 CASE WHEN c_custkey % 25 % 5 = 0 THEN CASE WHEN c_custkey // 25 = 3 THEN 7 END WHEN c_custkey % 5 = 0 THEN c_custkey END AS num_id, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS ilvl FROM customer"""


@query(
    f"""WITH RECURSIVE s AS ({_STYLES}),
r AS (SELECT doc, style_id, based_on, num_id, ilvl, [style_id] AS seen FROM s
 UNION ALL SELECT r.doc, r.style_id, s.based_on, s.num_id, s.ilvl, list_append(seen, s.style_id) FROM r JOIN s ON r.doc = s.doc AND r.based_on = s.style_id WHERE r.num_id IS NULL AND NOT list_contains(seen, s.style_id))
SELECT doc, style_id, num_id, coalesce(ilvl, 0) AS ilvl FROM r WHERE num_id IS NOT NULL"""
)
def style_chains(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("docspark_customer")
    return numbering.style_numbering(spark.sql(_sparked(_STYLES, "customer")), ["doc"])


def _sparked(sql: str, name: str) -> str:
    """The SQL that makes up rows, as Spark reads it: whole quotients, and the table's view."""
    return re.sub(r"(\w+) // (\d+)", r"(\1 DIV \2)", sql).replace(f"FROM {name}", f"FROM docspark_{name}").replace("::INT", "")


_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _files(spark, sf_dir):
    """A word-processor file per region, all with the same list and style ids: list 5 begins at the region's number,
    list 6 is another one, and a style hands down list 5. The nations are its paragraphs."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    head = lambda num, level: F.concat(F.lit(f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="'), num, F.lit('"/></w:numPr>'))
    own = F.when(n % 4 == 0, F.lit('<w:pStyle w:val="H2"/>')).when(n % 4 == 1, head(F.lit("5"), 0)).when(n % 4 == 2, head(F.lit("5"), 1)).otherwise(head(F.lit("6"), 0))
    gone = F.when(n % 7 == 6, F.lit("<w:rPr><w:del/></w:rPr>")).otherwise(F.lit(""))
    p = F.concat(F.lit("<w:p><w:pPr>"), own, gone, F.lit("</w:pPr><w:r><w:t>"), F.col("n_name"), F.lit("</w:t></w:r></w:p>"))
    p = F.when(n % 3 == 0, F.concat(F.lit("<w:tbl><w:tr><w:tc>"), p, F.lit("</w:tc></w:tr></w:tbl>"))).otherwise(p)
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", p.alias("p")))), lambda x: x["p"]), "").alias("body"))
    level = lambda i, fmt, text, start: F.concat(F.lit(f'<w:lvl w:ilvl="{i}"><w:start w:val="'), start, F.lit(f'"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'))
    lists = F.concat(
        F.lit(f'<w:numbering {_WORD}><w:abstractNum w:abstractNumId="0">'), level(0, "decimal", "%1.", (r + 1).cast("string")), level(1, "decimal", "%1.%2", F.lit("1")),
        F.lit('</w:abstractNum><w:abstractNum w:abstractNumId="1">'), level(0, "upperLetter", "(%1)", F.lit("1")), F.lit("</w:abstractNum>"),
        F.lit('<w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="1"/></w:num></w:numbering>'),
    )
    styles = F.lit(f'<w:styles {_WORD}><w:style w:styleId="H1"><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style><w:style w:styleId="H2"><w:basedOn w:val="H1"/></w:style></w:styles>')
    body = F.concat(F.lit(f"<w:document {_WORD}><w:body>"), F.col("body"), F.lit("</w:body></w:document>"))

    @F.pandas_udf("binary")
    def packed(document: pd.Series, lists: pd.Series, styles: pd.Series) -> pd.Series:
        out = []
        for texts in zip(document, lists, styles):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                for name, text in zip(("document", "numbering", "styles"), texts):
                    z.writestr(f"word/{name}.xml", text)
            out.append(raw.getvalue())
        return pd.Series(out)

    return docs.select(F.concat(F.lit("region "), r.cast("string")).alias("path"), packed(body, lists, styles).alias("content"))


_FILES = """n AS (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS seq FROM nation),
k AS (SELECT *, CASE WHEN n_nationkey % 4 = 3 THEN 6 ELSE 5 END AS num_id, CASE WHEN n_nationkey % 4 = 2 THEN 1 ELSE 0 END AS ilvl FROM n WHERE n_nationkey % 7 <> 6),
c AS (SELECT *, count(*) FILTER (ilvl = 0) OVER w AS tops, n_nationkey % 3 = 0 AS in_table FROM k WINDOW w AS (PARTITION BY n_regionkey, num_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, num_id, tops, ilvl ORDER BY seq) AS sub FROM c),
f AS (SELECT 'region ' || n_regionkey AS path, seq, n_name AS text, num_id, ilvl, in_table, CASE WHEN num_id = 6 THEN '1' ELSE '0' END AS abstract_id,
 CASE WHEN num_id = 6 THEN '(' || chr(64 + tops::INT) || ')' WHEN ilvl = 0 THEN (n_regionkey + tops) || '.' ELSE (n_regionkey + greatest(tops, 1)) || '.' || sub END AS number FROM e)"""


def _file_numbers(spark, sf_dir):
    files = _files(spark, sf_dir)
    return numbering.document_numbers(office.paragraphs(files), office.list_levels(files), office.styles(files), ["path"])


@query(f"WITH {_FILES} SELECT path, seq, text, num_id, ilvl, in_table, abstract_id, number FROM f")
def file_numbers(spark, sf_dir):
    """Numbers of the paragraphs of several files that use the same ids."""
    return _file_numbers(spark, sf_dir).select("path", "seq", "text", "num_id", "ilvl", "in_table", "abstract_id", "number")


@query(f"WITH {_FILES} SELECT path, abstract_id, count(*) AS n, count(*) FILTER (in_table) AS n_in_table, count(*) FILTER (NOT in_table) AS n_outside FROM f WHERE abstract_id <> '0' GROUP BY ALL")
def lists_beside(spark, sf_dir):
    """Numbered paragraphs that are not of the headings' list, by their own."""
    return numbering.by_abstract_list(_file_numbers(spark, sf_dir), ["path"], "0")[1]


@query(f"WITH {_FILES} SELECT path, seq, number FROM f WHERE abstract_id = '0'")
def list_headings(spark, sf_dir):
    return numbering.by_abstract_list(_file_numbers(spark, sf_dir), ["path"], "0")[0].select("path", "seq", "number")


@query(
    """WITH i AS (SELECT o_orderstatus AS k, o_orderpriority AS p, o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS occ FROM orders),
n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS k, CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS p, c_custkey AS seq, c_name AS number FROM customer),
m AS (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY seq) AS occ FROM n)
SELECT i.k, i.p, i.seq, i.occ::INT AS occ, m.number FROM i LEFT JOIN m USING (k, p, occ)"""
)
def numbers_taken(spark, sf_dir):
    """Numbers used once each, in order, by items of their key."""
    i = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("seq"))
    c = F.col("c_custkey")
    p = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (c % 5 + 1).cast("int"))
    n = table(spark, sf_dir, "customer").select(F.when(c % 2 == 0, F.lit("F")).otherwise(F.lit("O")).alias("k"), p.alias("p"), c.alias("seq"), F.col("c_name").alias("number"))
    return numbering.take_in_order(i, n, ["k", "p"])


@query("SELECT l_linenumber * 100 + l_quantity::INT AS number, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS first_seq FROM lineitem GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 10")
def top_numbers(spark, sf_dir):
    """The ten most frequent of some 350 numbers."""
    number = F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    l = table(spark, sf_dir, "lineitem").select(number.alias("number"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))  # noqa: E741
    return numbering.histogram(l, [F.col("number")])


def _sheet(spark, sf_dir):
    """A bill per region: title, header, a section per nation, a row per supplier."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    k = F.col("n_nationkey").cast("bigint")
    head = n.select("n_regionkey", (k * 1000000 + 10).alias("r"), F.array(F.col("n_name"), F.lit(""), F.lit("")).alias("texts"))
    blank = n.select("n_regionkey", (k * 1000000 + 11).alias("r"), F.array(F.lit(""), F.lit(""), F.lit("x")).alias("texts"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        "n_regionkey", (k * 1000000 + 100 + F.col("s_suppkey")).alias("r"),
        F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit("<"), F.col("s_name"), F.lit("|>")), F.floor("s_acctbal").cast("string")).alias("texts"),
    )
    top = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("r"), F.array(F.col("r_name")).alias("texts")), F.struct(F.lit(2).cast("bigint").alias("r"), F.array(F.lit("No"), F.lit("Name"), F.lit("Sum")).alias("texts"))
    )).alias("x")).select("n_regionkey", "x.*")
    return head.unionByName(blank).unionByName(rows).unionByName(top)


@query(
    """WITH n AS (SELECT *, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS section FROM nation),
r AS (SELECT n_regionkey, section, s_suppkey, '| ' || s_suppkey || ' | &lt;' || s_name || '\\|&gt; | ' || floor(s_acctbal)::BIGINT || ' |' AS line FROM supplier JOIN n ON s_nationkey = n_nationkey),
b AS (SELECT n_regionkey, section, string_agg(line, chr(10) ORDER BY s_suppkey) AS body, count(*) AS n_rows FROM r GROUP BY ALL)
SELECT n.n_regionkey, n.section, n_name AS heading, coalesce(n_rows, 0) AS n_rows, CASE WHEN body IS NULL THEN '' ELSE '| No | Name | Sum |' || chr(10) || '| --- | --- | --- |' || chr(10) || body END AS "table" FROM n LEFT JOIN b USING (n_regionkey, section)"""
)
def sheet_sections(spark, sf_dir):
    return tables.sectioned(_sheet(spark, sf_dir), ["n_regionkey"])


@query(
    """WITH n AS (SELECT *, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS section FROM nation),
r AS (SELECT n_regionkey, section, s_suppkey, '| ' || s_suppkey || ' | &lt;' || s_name || '\\|&gt; | ' || floor(s_acctbal)::BIGINT || ' |' AS line FROM supplier JOIN n ON s_nationkey = n_nationkey),
b AS (SELECT n_regionkey, section, string_agg(line, chr(10) ORDER BY s_suppkey) AS body FROM r GROUP BY ALL),
p AS (SELECT n.n_regionkey, section, '## ' || n_name || CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || '| No | Name | Sum |' || chr(10) || '| --- | --- | --- |' || chr(10) || body END AS md FROM n LEFT JOIN b USING (n_regionkey, section))
SELECT n_regionkey, '# ' || r_name || chr(10) || chr(10) || CASE WHEN n_regionkey % 2 = 0 THEN 'as of' || chr(10) || 'today' || chr(10) || chr(10) ELSE '' END || string_agg(md, chr(10) || chr(10) ORDER BY section) || chr(10) AS md FROM p JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name"""
)
def sheet_texts(spark, sf_dir):
    """Sheets as one text each, some with a description below the title."""
    title = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit(" "), F.get("texts", 0), F.lit("\n as of\n\ntoday "))).otherwise(F.get("texts", 0))
    cells = _sheet(spark, sf_dir).withColumn("texts", F.when(F.col("r") == 1, F.array(title)).otherwise(F.col("texts")))
    return tables.sheet_markdown(cells, ["n_regionkey"])


@query(
    """SELECT p_partkey, p_size AS n_rows, (p_partkey % 15)::INT AS n_cols FROM part WHERE p_size >= 2 AND p_partkey % 15 BETWEEN 2 AND 12"""
)
def table_candidates(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n_rows"), (F.col("p_partkey") % 15).cast("int").alias("n_cols"))
    return tables.table_candidates(t)


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber % 4 AS c, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE repeat('x', l_quantity::INT + 15) END AS t FROM lineitem),
g AS (SELECT l_orderkey, count(DISTINCT CASE WHEN t <> '' THEN c END) / 4.0::DOUBLE AS filled_share, max(length(t))::INT AS longest FROM c GROUP BY 1) SELECT *, filled_share <= 0.5 AND longest <= 60 AS is_pseudo FROM g"""
)
def pseudo_tables(spark, sf_dir):
    """Tables that are mere text, out of the lines of orders."""
    t = F.when(F.col("l_partkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.repeat(F.lit("x"), F.col("l_quantity").cast("int") + 15), F.lit(" ")))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4).alias("c"), F.lit(4).alias("n_cols"), t.alias("text"))  # noqa: E741
    return tables.pseudo_tables(l, ["l_orderkey"])


@query(
    """WITH h AS (SELECT c_custkey, (c_custkey % 3 + 2)::INT AS level, CASE c_custkey % 4 WHEN 0 THEN '1. a' WHEN 1 THEN '1.2 b' WHEN 2 THEN '1.2.3 c' ELSE 'plain' END AS text, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 END AS expected FROM customer)
SELECT * FROM h WHERE expected <> level"""
)
def heading_depths(spark, sf_dir):
    """Numbered headings whose level is not that of their number."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("1. a", "1.2 b", "1.2.3 c", "plain")]), (k % 4 + 1).cast("int"))
    return audit.heading_depths(table(spark, sf_dir, "customer").select("c_custkey", (k % 3 + 2).cast("int").alias("level"), name.alias("text")))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, '| ' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag || '\\|' || l_linestatus END || ' | ' || l_partkey || '<br>' || l_quantity::INT || ' | ' || CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END || ' |' AS line FROM lineitem),
h AS (SELECT l_orderkey, '| a | b | c |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, line) AS md FROM c GROUP BY 1) SELECT * FROM h"""
)
def order_tables(spark, sf_dir):
    """The lines of every order as a Markdown table: cells cleaned, short rows padded, empty rows dropped."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    first = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.concat_ws("|", "l_returnflag", "l_linestatus"))
    second = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\n"), F.col("l_quantity").cast("int").cast("string"))
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.array(first, second, F.col("l_linestatus"))).otherwise(F.array(first, second))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", cells.alias("cells"))))
    t = l.groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["cells"]).alias("rows"))
    header = F.array(*[F.lit(x) for x in "abc"])
    return t.select("l_orderkey", tables.rendered_rows(F.concat(F.array(header, F.array(F.lit(" "), F.lit(None).cast("string"))), F.col("rows"))).alias("md"))


@query(
    """SELECT c_custkey, [c_name || '|' || c_mktsegment, floor(c_acctbal)::BIGINT::VARCHAR, c_custkey::VARCHAR] AS cells, c_custkey % 4 = 0 AS is_separator FROM customer"""
)
def row_cells(spark, sf_dir):
    """Cells of Markdown rows with escaped pipes, and whether a rule like |---| is one."""
    c = table(spark, sf_dir, "customer")
    row = F.concat(F.lit(" | "), F.col("c_name"), F.lit("\\|"), F.col("c_mktsegment"), F.lit(" | "), F.floor("c_acctbal").cast("string"), F.lit("|"), F.col("c_custkey").cast("string"), F.lit(" |"))
    rule = F.when(F.col("c_custkey") % 4 == 0, F.lit(" |:---|---:| ")).when(F.col("c_custkey") % 4 == 1, F.lit("| a |")).when(F.col("c_custkey") % 4 == 2, F.lit("")).otherwise(F.lit("|--|x|"))
    return c.select("c_custkey", text.split_row(row).alias("cells"), text.is_separator_row(rule).alias("is_separator"))


# Customers by nation as rows of a table of three columns, some broken into rows without a first cell.
_BROKEN = """SELECT c_nationkey AS k, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INT AS r, CASE WHEN c_custkey % 3 = 0 THEN 'r' || c_custkey ELSE '' END AS c0,
 CASE WHEN c_custkey % 2 = 0 THEN 'x' || c_custkey ELSE '' END AS c1, CASE WHEN c_custkey % 5 < 3 THEN 'y' || c_custkey ELSE '' END AS c2 FROM customer"""
_TAKE = "has_in AND (a = 1 OR (NOT filled AND lag(f) OVER (PARTITION BY k, c ORDER BY a)))"


@query(
    f"""WITH RECURSIVE b AS ({_BROKEN}), u AS (SELECT k, r, 0 AS c, c0 AS t, c0 <> '' AS anchor FROM b UNION ALL SELECT k, r, 1, c1, c0 <> '' FROM b UNION ALL SELECT k, r, 2, c2, c0 <> '' FROM b),
g AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY k, c ORDER BY r ROWS UNBOUNDED PRECEDING) AS a FROM u),
o AS (SELECT k, c, a, max(CASE WHEN anchor THEN r END) AS r, max(CASE WHEN anchor THEN t END) AS t, coalesce(string_agg(CASE WHEN NOT anchor AND t <> '' THEN t END, '<br>' ORDER BY r), '') AS frag FROM g GROUP BY ALL),
i AS (SELECT *, coalesce(t, '') <> '' AS filled, lag(frag) OVER (PARTITION BY k, c ORDER BY a) AS fin FROM o),
q AS (SELECT *, coalesce(fin, '') <> '' AS has_in FROM i),
f AS (SELECT k, c, a, filled OR (a = 1 AND has_in) AS f FROM q WHERE a = (SELECT min(x.a) FROM q x WHERE x.k = q.k AND x.c = q.c AND x.a > 0)
 UNION ALL SELECT q.k, q.c, q.a, q.filled OR (q.has_in AND f.f) FROM f JOIN q ON q.k = f.k AND q.c = f.c AND q.a = f.a + 1),
z AS (SELECT q.*, f.f FROM q LEFT JOIN f USING (k, c, a)),
y AS (SELECT *, coalesce({_TAKE}, false) AS take FROM z),
w AS (SELECT *, frag <> '' AND NOT coalesce(lead(take) OVER (PARTITION BY k, c ORDER BY a), false) AS keep FROM y)
SELECT k, r, c, array_to_string(list_filter([CASE WHEN take THEN fin END, nullif(t, ''), CASE WHEN keep THEN frag END], lambda x: x IS NOT NULL), '<br>') AS text FROM w WHERE r IS NOT NULL"""
)
def continuation_rows(spark, sf_dir):
    """Broken rows put together again."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("docspark_customer")
    b = spark.sql(_BROKEN.replace("FROM customer", "FROM docspark_customer"))
    cells = b.select("k", "r", F.posexplode(F.array("c0", "c1", "c2")).alias("c", "text"))
    return tables.merged_continuations(cells, ["k"])


@query(
    """WITH t AS (SELECT o_custkey, o_orderkey AS tbl, o_orderstatus AS header, (o_orderkey % 3)::INT AS gap FROM orders),
n AS (SELECT *, (NOT coalesce(lag(header) OVER (PARTITION BY o_custkey ORDER BY tbl) = header AND gap <= 1, false))::INT AS new FROM t)
SELECT o_custkey, tbl, header, gap, sum(new) OVER (PARTITION BY o_custkey ORDER BY tbl ROWS UNBOUNDED PRECEDING)::BIGINT AS merged FROM n"""
)
def tables_across_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("tbl"), F.col("o_orderstatus").alias("header"), (F.col("o_orderkey") % 3).cast("int").alias("gap"))
    return tables.merged_across_pages(o, ["o_custkey"])


@query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT (l_linenumber + l_suppkey) % 3) AS n_widths FROM lineitem GROUP BY 1) SELECT *, n_widths > 1 AS ragged FROM c"""
)
def column_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", ((F.col("l_linenumber") + F.col("l_suppkey")) % 3).alias("n_cells"))  # noqa: E741
    return audit.column_counts(l, ["l_orderkey"])


@query(
    """WITH d AS (SELECT o_custkey, o_orderkey // 3 AS n FROM orders UNION ALL SELECT o_custkey, o_orderkey // 3 FROM orders WHERE o_orderkey % 5 = 0),
l AS (SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY n) AS b FROM d)
SELECT o_custkey, b AS after, n AS before, greatest(n - b - 1, 0) AS missing, CASE WHEN n = b THEN 'repeat' ELSE 'gap' END AS kind FROM l WHERE b IS NOT NULL AND n <> b + 1"""
)
def number_gaps(spark, sf_dir):
    """Numbers that are skipped or come twice."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_orderkey") / 3).cast("bigint").alias("n"))
    return audit.gaps(o.unionAll(o.where("o_orderkey % 5 = 0")).select("o_custkey", "n"), ["o_custkey"], "n")


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n_a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_b FROM supplier GROUP BY 1)
SELECT k, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_a, 0) = coalesce(n_b, 0) AS equal FROM a FULL JOIN b USING (k)"""
)
def counts_reconciled(spark, sf_dir):
    return audit.reconciled(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query("SELECT l_orderkey, l_linenumber, abs((l_quantity + l_linenumber) - (l_quantity + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_linenumber END)) <= 0.005 AS holds FROM lineitem")
def row_sums(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    total = F.col("l_quantity") + F.when(F.col("l_suppkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_linenumber"))
    return l.select("l_orderkey", "l_linenumber", audit.sums_hold([F.col("l_quantity"), F.col("l_linenumber")], total).alias("holds"))


# Markdown lines out of customers: every kind of block.
_MD = """SELECT c_nationkey AS k, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INT AS lineno, CASE c_custkey % 13 WHEN 0 THEN '## ' || c_name WHEN 1 THEN '' WHEN 2 THEN '- ' || c_name
 WHEN 3 THEN '3. ' || c_name WHEN 4 THEN '7. ' || c_name WHEN 5 THEN '> ' || c_name WHEN 6 THEN '| ' || c_name || ' |' WHEN 7 THEN '| b |' WHEN 8 THEN '***' WHEN 9 THEN '![' || c_name || '](a.png)'
 WHEN 10 THEN '<div class="date">' || c_name || '</div>' WHEN 11 THEN CASE WHEN c_custkey % 2 = 0 THEN '```' ELSE 'x' END ELSE c_name END AS line FROM customer"""


def _markdown(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("docspark_customer")
    return spark.sql(_MD.replace("FROM customer", "FROM docspark_customer").replace("::INT", ""))


_KINDS = f"""f AS (SELECT *, regexp_matches(line, '{K.FENCE}') AS fence FROM l),
d AS (SELECT *, sum(fence::INT) OVER (PARTITION BY k ORDER BY lineno ROWS UNBOUNDED PRECEDING) AS depth FROM f),
c AS (SELECT *, CASE WHEN fence OR depth % 2 = 1 THEN 'code' WHEN regexp_replace(line, {_STRIP}, '', 'g') = '' THEN 'blank' WHEN line LIKE '<div class="date">%' THEN 'date'
 WHEN regexp_matches(line, '{K.ATX}') THEN 'heading' WHEN regexp_matches(line, '{K.RULE}') THEN 'rule' WHEN starts_with(line, '|') THEN 'table' WHEN starts_with(line, '![') THEN 'image' WHEN starts_with(line, '>') THEN 'quote'
 WHEN regexp_matches(line, '{K.BULLET}') THEN 'bullet' WHEN regexp_matches(line, '{K.ORDERED}') THEN 'ordered' ELSE 'paragraph' END AS kind FROM d),
n AS (SELECT *, (NOT coalesce(lag(kind) OVER w = kind AND kind IN ('code', 'table', 'quote', 'ordered', 'bullet') AND NOT (lag(fence) OVER w AND lag(depth) OVER w % 2 = 0), false))::INT AS new FROM c WINDOW w AS (PARTITION BY k ORDER BY lineno)),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lineno ROWS UNBOUNDED PRECEDING) AS b FROM n)"""


@query(
    rf"""WITH l AS ({_MD}), {_KINDS}, t AS (SELECT k, b, kind, min(lineno) AS first_line, count(*) AS n_lines, string_agg(CASE kind WHEN 'heading' THEN regexp_extract(line, '{K.ATX}', 2) WHEN 'quote' THEN regexp_replace(line, '^\s*>+\s?', '')
 WHEN 'bullet' THEN regexp_extract(line, '{K.BULLET}', 1) WHEN 'ordered' THEN regexp_extract(line, '{K.ORDERED}', 2) WHEN 'date' THEN regexp_extract(line, '>(.+?)</div>', 1) ELSE line END, chr(10) ORDER BY lineno) AS text,
 max(length(regexp_extract(line, '{K.ATX}', 1)))::INT AS level FROM g WHERE kind <> 'blank' GROUP BY ALL)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY first_line) AS block, kind, first_line, n_lines, level, text FROM t"""
)
def markdown_blocks(spark, sf_dir):
    return blocks.blocks(_markdown(spark, sf_dir), "k")


@query(
    rf"""WITH l AS ({_MD}), {_KINDS}, r AS (SELECT *, sum(coalesce((lag_kind <> kind)::INT, 1)) OVER (PARTITION BY k ORDER BY lineno ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY k ORDER BY lineno) AS lag_kind FROM c))
SELECT k, lineno, row_number() OVER (PARTITION BY k, run ORDER BY lineno) AS number, regexp_extract(line, '{K.ORDERED}', 2) AS text FROM r WHERE kind = 'ordered'"""
)
def ordered_items(spark, sf_dir):
    return blocks.renumbered(_markdown(spark, sf_dir), "k")


_CAPTIONS = """SELECT c_nationkey AS k, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INT AS lineno, CASE c_custkey % 5 WHEN 0 THEN '![old](img' || c_custkey || '.png)' WHEN 1 THEN '  图' || c_custkey || ' [' || c_name || ']' WHEN 2 THEN '' WHEN 3 THEN c_name ELSE '![](b.png)' END AS line FROM customer"""


@query(
    rf"""WITH l AS ({_CAPTIONS}), b AS (SELECT *, regexp_replace(line, {_STRIP}, '', 'g') AS bare FROM l),
n AS (SELECT *, first_value(nullif(bare, '') IGNORE NULLS) OVER (PARTITION BY k ORDER BY lineno ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM b)
SELECT k, lineno, CASE WHEN regexp_matches(line, '{K.IMAGE_LINE}') AND regexp_matches(nxt, '{K.CAPTION}') THEN '![' || translate(nxt, '[]', '（）') || '](' || regexp_extract(line, '{K.IMAGE_LINE}', 2) || ')' ELSE line END AS line FROM n"""
)
def image_captions(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("docspark_customer")
    l = spark.sql(_CAPTIONS.replace("FROM customer", "FROM docspark_customer").replace("::INT", ""))  # noqa: E741
    return lines.captions_into_images(l, "k")


@query(
    r"""SELECT p_partkey, replace(replace(replace(p_name, ' ', '_'), '?', '_'), ':', '_') || '_p.png' AS file, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' x' END AS title,
 CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN NULL ELSE 'p' || p_partkey END AS auto, lpad(p_partkey::VARCHAR, greatest(2, 5), '0') AS page, '![](a.files/' || p_partkey || '.png)' AS media,
 '\|' || replace(p_name, '|', '\|') || '&lt;' AS cell FROM part"""
)
def names_and_titles(spark, sf_dir):
    """File names, plain titles, automatic titles, page numbers, media references and cells, out of parts."""
    p = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(k % 2 == 0, F.concat(F.lit("**"), name, F.lit("**"))).otherwise(F.concat(name, F.lit(" [`x`](y)")))
    doc = F.when(k % 3 == 0, F.concat(F.lit('---\ndate: 1\ntitle: "'), name, F.lit('"\n---\ntext'))).when(k % 3 == 1, F.lit("\n# Title")).otherwise(F.lit("plain"))
    return p.select(
        "p_partkey",
        text.safe_name(F.concat(name, F.lit("?p.png"))).alias("file"),
        text.plain_title(title).alias("title"),
        text.auto_title(doc, F.concat(F.lit("p"), k.cast("string"))).alias("auto"),
        text.padded(k, F.lit(10000)).alias("page"),
        text.flat_media(F.concat(F.lit("![](a.files/media/"), k.cast("string"), F.lit(".png)")), F.lit("a")).alias("media"),
        text.sheet_cell(F.concat(F.lit("|"), name, F.lit("<"))).alias("cell"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE list_sort(list_distinct([1, 3, (p_partkey % 20 + 1)::INT, (p_partkey % 20 + 2)::INT, (p_partkey % 20 + 3)::INT])) END AS pages, greatest((p_partkey % 7 - 3)::INT, 1) AS first, least((p_partkey % 30)::INT, 12) AS last,
 CASE WHEN p_size % 10 < 8 THEN (p_size % 10 / 10.0::DOUBLE * 640)::DOUBLE END IS NOT NULL AS good, (least(1.0, 8.5 / (p_size * 40 / 96.0), 6.0 / (p_size * 60 / 96.0)) * (p_size * 60 / 96.0))::DOUBLE AS width FROM part"""
)
def page_numbers(spark, sf_dir):
    """Page lists, ranges, crop boxes and image widths, out of parts."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    spec = F.when(k % 4 == 3, F.lit("5-2")).otherwise(F.concat(F.lit("3, 1,"), (k % 20 + 1).cast("string"), F.lit("-"), (k % 20 + 3).cast("string")))
    span = text.clamp_pages((k % 7 - 3).cast("int"), (k % 30).cast("int"), F.lit(12))
    share = size % 10 / 10
    return p.select(
        "p_partkey",
        text.pages_of(spec).alias("pages"),
        span["first"].alias("first"),
        span["last"].alias("last"),
        text.crop_box(share, F.lit(0.0), F.lit(0.8), F.lit(1.0), F.lit(640), F.lit(480)).isNotNull().alias("good"),
        text.fitted_width(size * 60, size * 40).alias("width"),
    )


@query(
    """SELECT s_suppkey, [{'kind': 'text', 'text': 'a ', 'href': ''}, {'kind': 'bold', 'text': s_name, 'href': ''}, {'kind': 'text', 'text': ' and ', 'href': ''}, {'kind': 'link', 'text': 'l', 'href': 'h' || s_suppkey},
 {'kind': 'code', 'text': 'c', 'href': ''}, {'kind': 'text', 'text': ' ', 'href': ''}, {'kind': 'break', 'text': '', 'href': ''}, {'kind': 'text', 'text': 'end', 'href': ''}] AS runs FROM supplier"""
)
def inline_runs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("a **"), F.col("s_name"), F.lit("** and [l](h"), F.col("s_suppkey").cast("string"), F.lit(")`c`&nbsp;<br/>end"))
    return s.select("s_suppkey", text.inline_tokens(line).alias("runs"))


@query(
    """SELECT n_nationkey, '12' AS size, n_name AS family, CASE WHEN n_nationkey % 2 = 0 THEN '28.0pt' ELSE '1.5x' END AS spacing, 'p{}' AS css, ['--flag'] AS extras, 'page ' AS before FROM nation"""
)
def style_sheets(spark, sf_dir):
    """Own styles over default ones, spacing, fences of style files, footers."""
    n = table(spark, sf_dir, "nation")
    defaults = F.create_map(F.lit("body.size"), F.lit("10"), F.lit("body.family"), F.lit("Serif"), F.lit("table.size"), F.lit("9"))
    own = text.style_map(F.concat(F.lit("# Style\n```yaml\nbody:\n  size: 12\n  # note\n  family: '"), F.col("n_name"), F.lit("'\n```\n")))
    merged = text.merged_style(defaults, own)
    sheet = F.lit("```css\np{}\n```\n```browser-extras\n# none\n\n--flag\n```")
    return n.select(
        "n_nationkey", merged["body.size"].alias("size"), merged["body.family"].alias("family"),
        text.line_spacing(F.when(F.col("n_nationkey") % 2 == 0, F.lit(28.0)), F.lit(1.5)).alias("spacing"),
        text.strip(text.fenced(sheet, "css")).alias("css"), text.fence_entries(sheet, "browser-extras").alias("extras"), F.get(text.footer_parts(F.lit("page {N} of")), 0).alias("before"),
    )


@query(
    """WITH r AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS family FROM part), i AS (SELECT DISTINCT lower(replace(p_brand || p_type, ' ', '')) AS key FROM part WHERE p_partkey % 3 = 0)
SELECT id, family FROM r WHERE lower(replace(family, ' ', '')) NOT IN (SELECT key FROM i)"""
)
def fonts_missing(spark, sf_dir):
    """Required families that are not among the installed ones, however these are written."""
    p = table(spark, sf_dir, "part")
    required = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("family"))
    shown = F.concat(F.upper("p_brand"), F.col("p_type"), F.lit(" & Other (TrueType)"))
    fonts = lambda where: p.where(where).select(F.explode(text.font_names(shown)).alias("family"))
    installed = [fonts("p_partkey % 6 = 0"), fonts("p_partkey % 6 = 3")]
    return audit.missing_names(required, installed, "family", text.font_key)


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || CASE WHEN c_custkey % 4 = 1 THEN '  ' ELSE ' ' END || c_mktsegment END AS shown FROM customer"""
)
def text_cells(spark, sf_dir):
    """Strings as cells show them: line breaks as spaces, null empty."""
    k = F.col("c_custkey") % 4
    gap = F.when(k == 1, F.lit("\r\n")).when(k == 2, F.lit("\n")).otherwise(F.lit("\r"))
    cell = F.when(k != 0, F.concat(F.lit(" \n"), F.col("c_name"), gap, F.col("c_mktsegment"), F.lit("\r\n")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.string_text(cell).alias("shown"))


@query(
    """SELECT n_nationkey, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>a &amp; b</title><style>' || chr(10) || 'p{}' || chr(10) || '</style></head><body>' || chr(10)
 || '<h2>' || n_name || '</h2>' || chr(10) || '<ul><li><strong>' || n_name || '</strong> &lt;x&gt;</li><li>' || n_nationkey || '</li></ul>' || chr(10)
 || CASE WHEN n_nationkey % 2 = 0 THEN '<table><tr><th>a</th><th>' || n_name || '</th></tr><tr><td>1</td><td><a href="u">l</a></td></tr></table>' ELSE '<pre><code>**' || n_name || '** &amp;</code></pre>' END
 || chr(10) || '<blockquote><p>q</p></blockquote>' || chr(10) || '<hr>' || chr(10) || '<p><em>' || n_name || '</em><br>end</p>' || chr(10) || '</body></html>' || chr(10) AS html FROM nation"""
)
def nation_pages(spark, sf_dir):
    """Markdown made out of nations as HTML pages."""
    name, k = F.col("n_name"), F.col("n_nationkey")
    some = F.when(k % 2 == 0, F.concat(F.lit("| a | "), name, F.lit(" |\n|---|---|\n| 1 | [l](u) |"))).otherwise(F.concat(F.lit("```py\n**"), name, F.lit("** &\n```")))
    md = F.concat(F.lit("## "), name, F.lit("\n\n- **"), name, F.lit("** <x>\n- "), k.cast("string"), F.lit("\n\n"), some, F.lit("\n\n> q\n\n***\n\n*"), name, F.lit("*<br/>end\n"))
    docs = table(spark, sf_dir, "nation").select("n_nationkey", md.alias("md"))
    return blocks.html_documents(blocks.blocks(lines.lines_of(docs, "n_nationkey", "md"), "n_nationkey"), "n_nationkey", "p{}", "a & b")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN printf('%.2f', l_quantity::DOUBLE) WHEN l_linenumber % 3 = 1 THEN l_quantity::BIGINT::VARCHAR ELSE (l_quantity::BIGINT)::VARCHAR || '.5' END AS shown FROM lineitem"""
)
def number_cells(spark, sf_dir):
    """Numbers as cells show them."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    v = F.col("l_quantity").cast("double") + F.when(F.col("l_linenumber") % 3 == 2, 0.5).otherwise(0.0)
    look = F.when(F.col("l_linenumber") % 3 == 0, F.lit("#,##0.00"))
    return l.select("l_orderkey", "l_linenumber", text.number_text(v, look).alias("shown"))


@query(
    """WITH p AS (SELECT o_custkey % 20 AS doc, (o_orderkey % 400)::INT AS page, min(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 400 + CASE WHEN o_custkey % 20 = 3 AND o_orderkey % 2 = 0 THEN 1 ELSE 2 END)::INT END) AS doc_page FROM orders GROUP BY ALL)
SELECT doc, count(*) AS n_pages, count(doc_page) AS n_mapped, list_sort(list(page) FILTER (doc_page IS NULL)) AS missing, CASE WHEN count(DISTINCT doc_page - page) = 1 THEN min(doc_page - page) END AS "offset" FROM p GROUP BY 1"""
)
def page_offsets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    printed = F.when(k % 5 > 0, (k % 400 + F.when((c % 20 == 3) & (k % 2 == 0), 1).otherwise(2)).cast("int"))
    p = o.groupBy((c % 20).alias("doc"), (k % 400).cast("int").alias("page")).agg(F.min(printed).alias("doc_page"))
    return layout.page_mapping(p, "doc")


@query(
    f"""WITH l AS ({_CAPTIONS}), i AS (SELECT c_nationkey AS k, 'img' || c_custkey || '.png' AS src, '| ' || c_name || ' |' AS md FROM customer WHERE c_custkey % 2 = 0),
p AS (SELECT *, CASE WHEN regexp_matches(line, '{K.IMAGE_LINE}') THEN regexp_extract(line, '{K.IMAGE_LINE}', 2) END AS src FROM l)
SELECT p.k, lineno, coalesce(md, line) AS line FROM p LEFT JOIN i ON p.k = i.k AND p.src = i.src"""
)
def image_texts_placed(spark, sf_dir):
    """Lines with images replaced by their recognised text."""
    c = table(spark, sf_dir, "customer")
    c.createOrReplaceTempView("docspark_customer")
    l = spark.sql(_CAPTIONS.replace("FROM customer", "FROM docspark_customer").replace("::INT", ""))  # noqa: E741
    k = F.col("c_custkey")
    i = c.where(k % 2 == 0).select(F.col("c_nationkey").alias("k"), F.concat(F.lit("img"), k.cast("string"), F.lit(".png")).alias("src"), F.concat(F.lit("| "), F.col("c_name"), F.lit(" |")).alias("md"))
    return lines.image_texts_placed(l, i, "k")


@query(
    """SELECT c_custkey, 'a ![fig ' || c_custkey || '](fig ' || c_custkey || '.png) b' AS line, (CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END)::INT AS level FROM customer"""
)
def figure_marks(spark, sf_dir):
    """Figure comments as references, and heading levels by the depth of numbers."""
    k = F.col("c_custkey")
    quote = lambda a, b: F.concat(F.lit(f"a <!-- 本页含图: {a}fig "), k.cast("string"), F.lit(f"{b} --> b"))
    line = F.when(k % 3 == 0, quote('"', '"')).when(k % 3 == 1, quote("“", "”")).otherwise(quote("", ""))
    number = F.element_at(F.array(F.lit("1"), F.lit("1.2"), F.lit("1.2.3")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.figure_marks(line).alias("line"), text.numbered_heading_level(number).alias("level"))


@query(
    """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS lineno, l_partkey % 3 > 0 AS is_row FROM lineitem),
g AS (SELECT *, is_row AND NOT lag(is_row) OVER (PARTITION BY k ORDER BY lineno) AND lag(is_row, 2) OVER (PARTITION BY k ORDER BY lineno) AS cut FROM l) SELECT k, lineno FROM g WHERE cut"""
)
def tables_cut(spark, sf_dir):
    """Places where one line may have cut a table in two."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("lineno"), (F.col("l_partkey") % 3 > 0).alias("is_row"))  # noqa: E741
    return audit.split_tables(l, "k")
