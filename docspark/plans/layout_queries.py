"""Queries on page layouts: boxes, spans and lines made out of the business tables, the same way on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import boxes, layout
from .registry import query, table

# A page per 40 parts, with tables on it as boxes.
_BOXES = """SELECT p_partkey // 40 AS page, p_partkey AS tbl, (p_partkey * 7 % 90)::DOUBLE AS x0, (p_partkey * 11 % 90)::DOUBLE AS y0, (p_partkey * 7 % 90 + p_size)::DOUBLE AS x1, (p_partkey * 11 % 90 + p_size)::DOUBLE AS y1 FROM part"""


def _tables(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = k * 7 % 90, k * 11 % 90
    return table(spark, sf_dir, "part").select(
        F.floor(k / 40).cast("bigint").alias("page"), k.alias("tbl"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + size).cast("double").alias("x1"), (y + size).cast("double").alias("y1")
    )


@query(
    f"""WITH t AS ({_BOXES}) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.page = t.page AND t.x0 >= o.x0 AND t.y0 >= o.y0 AND t.x1 <= o.x1 AND t.y1 <= o.y1 AND t.tbl <> o.tbl)"""
)
def outer_tables(spark, sf_dir):
    return layout.nested_tables(_tables(spark, sf_dir), ["page"])


# Lines: small boxes, one per customer, on the same pages; cells: the left half of each table.
_LAYOUT = f"""t AS ({_BOXES}), c AS (SELECT page, x0, y0, x0 + (x1 - x0) * 0.95 AS x1, y1 FROM t),
l AS (SELECT c_custkey % 50 AS page, c_custkey AS line, (c_custkey * 13 % 130)::DOUBLE AS x0, (c_custkey * 17 % 130)::DOUBLE AS y0, (c_custkey * 13 % 130 + 4)::DOUBLE AS x1, (c_custkey * 17 % 130 + 2)::DOUBLE AS y1 FROM customer)"""
_IN = "(l.x0 + l.x1) / 2 BETWEEN {0}.x0 - 1 AND {0}.x1 + 1 AND (l.y0 + l.y1) / 2 BETWEEN {0}.y0 - 1 AND {0}.y1 + 1 AND {0}.page = l.page"


def _lines(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = k * 13 % 130, k * 17 % 130
    return table(spark, sf_dir, "customer").select(
        (k % 50).alias("page"), k.alias("line"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 4).cast("double").alias("x1"), (y + 2).cast("double").alias("y1")
    )


@query(f"WITH {_LAYOUT} SELECT DISTINCT l.page FROM l WHERE EXISTS (SELECT 1 FROM t WHERE {_IN.format('t')}) AND NOT EXISTS (SELECT 1 FROM c WHERE {_IN.format('c')})")
def pages_falling_back(spark, sf_dir):
    """Pages on which a line is in a table but in none of its cells."""
    t = _tables(spark, sf_dir)
    cells = t.withColumn("x1", F.col("x0") + (F.col("x1") - F.col("x0")) * 0.95)
    return layout.uncovered_pages(_lines(spark, sf_dir), t, cells, ["page"])


@query(f"WITH {_LAYOUT} SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE {_IN.format('t')})")
def lines_outside_tables(spark, sf_dir):
    return layout.lines_outside(_lines(spark, sf_dir), _tables(spark, sf_dir), ["page"])


_SPANS = """SELECT l_orderkey % 200 AS doc, l_orderkey AS line, l_linenumber * 1000000 + l_partkey AS span, 'w' || repeat('x', l_quantity::INT % 9) AS text, 8 + (l_partkey % 5) * 0.5 AS size, CASE WHEN l_partkey % 3 = 0 THEN 'Foo-Bold' ELSE 'Foo' END AS font FROM lineitem"""


def _spans(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        (F.col("l_orderkey") % 200).alias("doc"), F.col("l_orderkey").alias("line"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("span"),
        F.concat(F.lit("w"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int") % 9)).alias("text"),
        (8 + (F.col("l_partkey") % 5) * 0.5).alias("size"), F.when(F.col("l_partkey") % 3 == 0, F.lit("Foo-Bold")).otherwise(F.lit("Foo")).alias("font"),
    )


@query(
    f"""WITH s AS ({_SPANS}), z AS (SELECT doc, round(size, 1) AS size, sum(length(text)) AS n FROM s GROUP BY ALL) SELECT doc, arg_max(size, {{'n': n, 's': -size}})::DOUBLE AS body_size FROM z GROUP BY 1"""
)
def body_sizes(spark, sf_dir):
    return layout.body_size(_spans(spark, sf_dir), "doc")


@query(
    f"""WITH s AS ({_SPANS}) SELECT doc, line, string_agg(text, '' ORDER BY span, text) AS txt, arg_max(size, {{'n': length(text), 's': -span}})::DOUBLE AS size,
 sum(CASE WHEN font = 'Foo-Bold' THEN length(text) ELSE 0 END) / sum(length(text)) > 0.8 AS bold FROM s GROUP BY ALL"""
)
def lines_from_spans(spark, sf_dir):
    return layout.lines_of_spans(_spans(spark, sf_dir), ["doc", "line"])


@query(f"WITH s AS ({_SPANS}) SELECT doc, list_sort(list_distinct(list(font)))[1:8] AS fonts FROM s WHERE line % 7 + 1 <= 5 GROUP BY 1")
def fonts_on_first_pages(spark, sf_dir):
    return layout.fonts_of(_spans(spark, sf_dir).withColumn("page", F.col("line") % 7 + 1), "doc")


_HEADS = """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '第' || '一章 ' || c_mktsegment WHEN 1 THEN '附录1' WHEN 2 THEN '概 述' WHEN 3 THEN '1、' || c_mktsegment WHEN 4 THEN '包括' || c_mktsegment
 WHEN 5 THEN c_name WHEN 6 THEN c_mktsegment || '，' || c_name WHEN 7 THEN '目录' ELSE c_name || '..' END AS txt, 10 + (c_custkey % 3)::DOUBLE AS size, c_custkey % 4 = 0 AS bold FROM customer"""


@query(
    rf"""WITH l AS ({_HEADS}), n AS (SELECT *, translate(txt, ' {chr(0x3000)}', '') AS n FROM l),
v AS (SELECT *, CASE WHEN length(n) > 45 OR regexp_matches(n, '^(?:{'|'.join(K.BODY_STARTS)})') OR regexp_matches(n, '{K.BODY_SIGNS}') OR contains(n, '..') OR contains(n, '……') THEN NULL
 WHEN size >= 12 THEN 2 WHEN bold AND size >= 11 AND length(n) <= 30 THEN 3 WHEN {' OR '.join(f"regexp_matches(n, '{p}')" for p in K.HEADING_SECTIONS)} THEN 3 END AS level FROM n)
SELECT c_custkey, level, CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' || txt ELSE txt END AS md FROM v"""
)
def headings_promoted(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("docspark_customer")
    l = spark.sql(_HEADS.replace("FROM customer", "FROM docspark_customer").replace("(c_custkey % 3)::DOUBLE", "CAST(c_custkey % 3 AS DOUBLE)"))  # noqa: E741
    level = layout.heading_level(F.col("txt"), F.col("size"), F.col("bold"), F.lit(11.0))
    return l.withColumn("level", level).select("c_custkey", "level", layout.line_markdown(F.col("txt"), F.col("level")).alias("md"))


_FOOTERS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '第 ' || (o_orderkey % 90) || ' / 90 页' WHEN 1 THEN '打印日期 x 第' || (o_orderkey % 90) || '/90页' WHEN 2 THEN '- ' || (o_orderkey % 900) || ' -' WHEN 3 THEN '第1/2页 x' WHEN 4 THEN '打印日期' ELSE o_orderpriority END AS txt,
 (o_custkey % 100)::DOUBLE AS x0, (o_custkey % 100 + 4)::DOUBLE AS x1, (o_orderkey % 97)::DOUBLE AS y0, (o_orderkey % 97 + 2)::DOUBLE AS y1, 100.0::DOUBLE AS width, 100.0::DOUBLE AS height FROM orders"""


@query(
    rf"""WITH l AS ({_FOOTERS}), f AS (SELECT *, regexp_matches(txt, '{K.PAGE_OF_PAGES}') AND (contains(txt, '{K.PRINT_DATE}') OR regexp_matches(txt, '^{K.PAGE_OF_PAGES}$')) AS of_pages,
 regexp_matches(txt, '{K.BARE_PAGE_NUMBER}') AND (x0 + x1) / 2 BETWEEN 30 AND 70 AND ((y0 + y1) / 2 < 10 OR (y0 + y1) / 2 > 90) AS bare FROM l)
SELECT o_orderkey, of_pages OR bare OR starts_with(txt, '{K.PRINT_DATE}') AS is_footer, CASE WHEN of_pages THEN regexp_extract(txt, '{K.PAGE_OF_PAGES}', 1)::INT WHEN bare THEN regexp_extract(txt, '(\d{{1,4}})', 1)::INT END AS doc_page,
 CASE WHEN of_pages THEN regexp_extract(txt, '{K.PAGE_OF_PAGES}', 2)::INT END AS doc_total FROM f"""
)
def page_footers(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("docspark_orders")
    sql = _FOOTERS.replace("FROM orders", "FROM docspark_orders").replace("100.0::DOUBLE", "CAST(100 AS DOUBLE)")
    for c in ("o_custkey % 100", "o_custkey % 100 + 4", "o_orderkey % 97", "o_orderkey % 97 + 2"):
        sql = sql.replace(f"({c})::DOUBLE", f"CAST({c} AS DOUBLE)")
    return layout.with_footers(spark.sql(sql)).select("o_orderkey", "is_footer", "doc_page", "doc_total")


@query(
    """WITH e AS (SELECT l_orderkey AS page, l_linenumber * 15.0::DOUBLE + l_quantity::DOUBLE AS y0, l_partkey::DOUBLE AS x0, l_linenumber * 15.0::DOUBLE + l_quantity::DOUBLE + 10 AS y1, l_linenumber % 4 = 0 AS is_table, 'line ' || l_linenumber AS md FROM lineitem),
g AS (SELECT *, row_number() OVER w AS n, lag(y1) OVER w IS NOT NULL AND (y0 - lag(y1) OVER w > 20 OR is_table OR lag(is_table) OVER w) AS gap FROM e WINDOW w AS (PARTITION BY page ORDER BY y0, x0, md))
SELECT page, string_agg(CASE WHEN gap THEN chr(10) || md ELSE md END, chr(10) ORDER BY n) AS md FROM g GROUP BY 1"""
)
def pages_assembled(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    y0 = F.col("l_linenumber") * F.lit(15.0) + F.col("l_quantity").cast("double")
    e = l.select(F.col("l_orderkey").alias("page"), y0.alias("y0"), F.col("l_partkey").cast("double").alias("x0"), (y0 + 10).alias("y1"), (F.col("l_linenumber") % 4 == 0).alias("is_table"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("md"))
    return layout.assembled(e, ["page"])


_OCR = """SELECT l_orderkey AS img, l_linenumber * 1000000 + l_partkey AS seq, (l_partkey % 300)::DOUBLE AS x0, (l_linenumber % 3 * 20)::DOUBLE AS y0, (l_partkey % 300 + l_quantity::INT * 2)::DOUBLE AS x1, (l_linenumber % 3 * 20 + 10)::DOUBLE AS y1, repeat('t', l_quantity::INT % 12) AS text FROM lineitem"""
_COLS = """o AS (SELECT *, x0 - max(x1) OVER (PARTITION BY img ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 8 AS far FROM b),
g AS (SELECT *, sum(coalesce(far, true)::INT) OVER (PARTITION BY img ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS col FROM o), k AS (SELECT img, col::BIGINT AS col, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL)"""


def _ocr(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y, q = F.col("l_partkey") % 300, F.col("l_linenumber") % 3 * 20, F.col("l_quantity").cast("int")
    return l.select(
        F.col("l_orderkey").alias("img"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + q * 2).cast("double").alias("x1"), (y + 10).cast("double").alias("y1"), F.repeat(F.lit("t"), q % 12).alias("text"),
    )


@query(f"WITH b AS ({_OCR}), {_COLS} SELECT * FROM k")
def box_columns(spark, sf_dir):
    return boxes.columns_of_boxes(_ocr(spark, sf_dir), "img")


@query(
    f"""WITH b AS ({_OCR}), {_COLS}, r AS (SELECT img, y0, count(*) AS n, sum(length(text)) AS chars FROM b GROUP BY ALL),
s AS (SELECT img, sum(n)::BIGINT AS boxes, sum(chars)::BIGINT AS char_count, count(*) AS n_rows, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS multi FROM r GROUP BY 1),
j AS (SELECT s.*, n_cols, char_count / boxes AS a FROM s JOIN (SELECT img, count(*) AS n_cols FROM k GROUP BY 1) USING (img)),
w AS (SELECT *, CASE WHEN n_cols >= 2 AND n_rows >= 2 AND multi >= 0.6 THEN CASE WHEN a <= 5 AND boxes >= 30 THEN 'many short labels' ELSE 'table structure' END WHEN char_count >= 30 AND a >= 3 THEN 'enough text' WHEN a >= 15 AND char_count >= 15 THEN 'one dense block' ELSE 'sparse labels' END AS reason FROM j)
SELECT img, CASE reason WHEN 'table structure' THEN 'table' WHEN 'enough text' THEN 'text' WHEN 'one dense block' THEN 'text' ELSE 'image' END AS category, boxes, char_count, n_rows, n_cols, round(a, 1) AS avg_chars, reason FROM w"""
)
def images_triaged(spark, sf_dir):
    """What each image is; its boxes stand in rows 20 points apart."""
    return boxes.triage(boxes.rows_of_boxes(_ocr(spark, sf_dir), "img"), "img")


@query(
    f"""WITH b AS ({_OCR}), r AS (SELECT img, y0, string_agg(text, ' ' ORDER BY x0, seq, text) AS line FROM b GROUP BY ALL) SELECT img, string_agg(line, chr(10) ORDER BY y0) AS text FROM r GROUP BY 1"""
)
def image_texts(spark, sf_dir):
    return boxes.text_of_rows(boxes.rows_of_boxes(_ocr(spark, sf_dir), "img"), "img")


@query(
    """WITH i AS (SELECT l_orderkey AS page, l_linenumber AS img, (l_quantity::INT / 50.0)::DOUBLE AS cover, l_partkey::DOUBLE AS area FROM lineitem)
SELECT * FROM i WHERE cover >= 0.9 QUALIFY row_number() OVER (PARTITION BY page ORDER BY cover DESC, area DESC, img) = 1"""
)
def full_page_images(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    i = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("img"), (F.col("l_quantity").cast("int") / 50).alias("cover"), F.col("l_partkey").cast("double").alias("area"))
    return layout.full_page_image(i, ["page"])


@query(
    """WITH t AS (SELECT s_suppkey, starts_with(s_name, 'Supplier') AS ok, greatest((s_suppkey % 3)::INT, 1) AS n FROM supplier) SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN n END AS pages FROM t"""
)
def pdf_page_counts(spark, sf_dir):
    """Pages that the bytes of a PDF declare."""
    from ..functions.text import pdf_pages

    k = F.col("s_suppkey")
    body = F.concat(F.when(k % 5 > 0, F.lit("%PDF-1.4 ")).otherwise(F.lit("x")), F.lit("/Type /Pages "), F.repeat(F.lit("/Type /Page "), (k % 3).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", pdf_pages(F.encode(body, "UTF-8")).alias("pages"))


@query(
    """SELECT s_suppkey, '---' || chr(10) || 'title: ' || s_name || chr(10) || 'date: 2020-01-01' || chr(10) || 'pages: ' || s_suppkey || chr(10) || '---' || chr(10) || chr(10) || '> Page offset: '
 || CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE 'none' END || '; without number: ' || CASE WHEN s_suppkey % 3 = 0 THEN '（无）' ELSE '1,' || s_suppkey END || '; tables: 4' AS header FROM supplier"""
)
def front_matters(spark, sf_dir):
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("name"), k.alias("n_pages"), F.lit(4).alias("tables"), F.when(k % 2 == 0, 2).alias("offset"),
        F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(1).cast("bigint"), k.cast("bigint"))).alias("missing"),
    )
    return layout.front_matter(d, "2020-01-01").select("s_suppkey", "header")


# Boxes whose rows rise and fall across the image, so that a row's mean moves with each box.
_SLANT = """SELECT l_orderkey % 500 AS img, l_linenumber * 1000000 + l_partkey * 10 + l_orderkey // 500 % 10 AS seq, (l_partkey % 300)::DOUBLE AS x0, (l_linenumber % 3 * 60 + l_partkey % 300 // 25)::DOUBLE AS y0 FROM lineitem"""


@query(
    f"""WITH b AS ({_SLANT}) SELECT DISTINCT img, seq, x0, y0, dense_rank() OVER (PARTITION BY img ORDER BY floor(y0 / 60)) AS row FROM b"""
)
def slanting_rows(spark, sf_dir):
    """Rows of boxes that lie up to twelve points apart in one row and at least 48 in two."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    y = F.col("l_linenumber") % 3 * 60 + F.floor(p % 300 / 25)
    b = l.select(
        (k % 500).alias("img"), (F.col("l_linenumber") * 1000000 + p * 10 + F.floor(k / 500) % 10).alias("seq"), (p % 300).cast("double").alias("x0"), y.cast("double").alias("y0"),
        (p % 300 + 9).cast("double").alias("x1"), (y + 10).cast("double").alias("y1"), F.lit("t").alias("text"),
    ).distinct()
    return boxes.rows_of_boxes(b, "img").select("img", "seq", "x0", "y0", F.col("row").cast("bigint").alias("row"))


_TRIAGED = """SELECT CASE l_suppkey % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'text' ELSE 'image' END AS category FROM lineitem"""


@query(f"SELECT string_agg(category || ': ' || n, ' | ' ORDER BY n DESC, category) AS summary FROM (SELECT category, count(*) AS n FROM ({_TRIAGED}) GROUP BY 1)")
def image_summary(spark, sf_dir):
    k = F.col("l_suppkey") % 7
    kind = F.when(k == 0, F.lit("table")).when(k < 3, F.lit("text")).otherwise(F.lit("image"))
    return boxes.category_summary(table(spark, sf_dir, "lineitem").select(kind.alias("category")))


@query(
    """WITH p AS (SELECT o_custkey % 40 AS doc, o_orderkey AS page, (o_orderkey % 4)::INT AS n_tables, o_orderkey % 50 = 0 AS falls_back, o_orderkey % 70 = 1 AS garbled, o_orderkey % 3 > 0 AS has_footer FROM orders),
h AS (SELECT c_custkey % 45 AS doc, count(*) AS n FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1)
SELECT doc, count(*) AS n_pages, sum(n_tables)::BIGINT AS n_tables, coalesce(list_sort(list(page) FILTER (falls_back)), []) AS fallback_pages, coalesce(list_sort(list(page) FILTER (garbled)), []) AS garbled_pages,
 count(*) FILTER (has_footer) AS n_footers, coalesce(max(n), 0) AS n_headings FROM p LEFT JOIN h USING (doc) GROUP BY doc"""
)
def extraction_summaries(spark, sf_dir):
    """What came out of documents whose pages are orders."""
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("doc"), k.alias("page"), (k % 4).cast("int").alias("n_tables"), (k % 50 == 0).alias("falls_back"), (k % 70 == 1).alias("garbled"), (k % 3 > 0).alias("has_footer")
    )
    c = F.col("c_custkey")
    headings = table(spark, sf_dir, "customer").select((c % 45).alias("doc"), (c % 3 + 1).alias("level"))
    return layout.extraction_summary(pages, headings, ["doc"])
