"""Queries on the text of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text
from ..operators import audit, blocks, lines, textlayer, toc
from ..sources import html
from .registry import query, table

WS = K.WS
_STRIP = f"'^{WS}+|{WS}+$'"
_CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,"
    r" '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?i)<(?:meta|link)\b[^>]*>', '', 'g'),"
    r" '(?s)<!--.*?-->', '', 'g'), '(?s)<!\[CDATA\[.*?\]\]>', '', 'g'), '<![^>]*>', '', 'g'), '<\?[^>]*>', '', 'g')"
)
_LINK = r'(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>'
_HREF = r"""regexp_extract(a, '(?i)\bhref="([^"]*)"', 1)"""


def _entities(x: str) -> str:
    for name, sign in html.ENTITIES:
        x = f"replace({x}, '&{name};', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x


def _pages(spark, sf_dir):
    """Pages, some of them with addresses in single quotes or none, and with numeric entities: they say the same."""
    k, h = F.col("page_id") % 4, F.col("html")
    h = F.when(k == 1, F.regexp_replace(h, 'href="([^"]*)"', "href='$1'")).when(k == 2, F.regexp_replace(h, 'href="([^"\\s>]+)"', "HREF = $1 ")).otherwise(h)
    h = F.when(k == 3, F.replace(F.replace(F.replace(h, F.lit("&amp;"), F.lit("&#38;")), F.lit("&copy;"), F.lit("&#xA9;")), F.lit("&quot;"), F.lit("&#x22;"))).otherwise(h)
    return table(spark, sf_dir, "pages").withColumn("html", h)


_TITLE = f"regexp_replace(regexp_replace(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), {_STRIP}, '', 'g')"
_LINKS = (
    f"SELECT page_id, generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS a FROM (SELECT page_id, regexp_extract_all({_CLEAN}, '{_LINK}') AS l FROM pages)"
)
_LABEL = _entities(f"regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), {_STRIP}, '', 'g')")


@query(
    rf"""WITH c AS (SELECT page_id, {_CLEAN} AS h FROM pages),
l AS ({_LINKS}),
m AS (SELECT page_id, string_agg('- [' || {_LABEL} || '](' || {_entities(_HREF)} || ')', chr(10) ORDER BY seq) AS links, count(*) AS n FROM l GROUP BY 1)
SELECT c.page_id, '# ' || {_entities(_TITLE)}
  || chr(10) || chr(10) || coalesce(links, '') AS md, coalesce(n, 0) AS n_links FROM c LEFT JOIN m USING (page_id)"""
)
def page_outline(spark, sf_dir):
    """Title and list of links of every page as Markdown (drops scripts and comments, renders a link list)."""
    pages = _pages(spark, sf_dir)
    clean = html.without_comments(html.without_scripts(F.col("html")))
    title = html.entities(text.strip(html.without_tags(F.regexp_extract(clean, r"(?is)<h1[^>]*>(.*?)</h1>", 1))))
    line = F.concat(F.lit("- ["), F.col("label"), F.lit("]("), F.col("href"), F.lit(")"))
    links = html.links(pages, "page_id", "html").withColumn("line", line).withColumnRenamed("seq", "lineno")
    links = lines.joined(links, "page_id", "line", "links", "n")
    out = pages.select("page_id", title.alias("title")).join(links, "page_id", "left")
    md = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("links", F.lit("")))
    return out.select("page_id", md.alias("md"), F.coalesce("n", F.lit(0)).alias("n_links"))


@query(
    f"""SELECT page_id, seq, {_entities(_HREF)} AS href, {_LABEL} AS label FROM ({_LINKS})"""
)
def page_links(spark, sf_dir):
    return html.links(_pages(spark, sf_dir), "page_id", "html")


_TEXT = f"regexp_replace({_CLEAN}, '<[^>]*>', '', 'g')"
_FOLD = r"regexp_replace(regexp_replace(t, '[ \t]*\r?\n[ \t\r\n]*', ' ', 'g'), '\t+', ' ', 'g')"


@query(
    rf"""WITH c AS (SELECT page_id, {_TEXT} AS t FROM pages)
SELECT page_id, {_entities(f"CASE WHEN NOT regexp_matches(t, '[{chr(0xA0)}{chr(0x3000)}]') AND NOT regexp_matches({_FOLD}, '{K.NOT_WS}') THEN '' ELSE translate({_FOLD}, '{chr(0xA0)}{chr(0x3000)}', '  ') END")} AS txt FROM c"""
)
def page_text(spark, sf_dir):
    """Text of every page with its white space folded and entities resolved."""
    clean = html.without_tags(html.without_comments(html.without_scripts(F.col("html"))))
    return _pages(spark, sf_dir).select("page_id", html.entities(text.normal_spaces(clean)).alias("txt"))


@query(
    f"""SELECT doc_id, md5(regexp_replace(text, '{WS}+', '', 'g')) AS aligned, md5(translate(text, ' {chr(0x3000)}', '')) AS packed,
length(regexp_replace(text, '{WS}+', '', 'g')) AS n FROM documents"""
)
def document_keys(spark, sf_dir):
    """Alignment keys of every document."""
    key = text.without_spaces(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(key).alias("aligned"), F.md5(text.without_blanks(F.col("text"))).alias("packed"), F.length(key).alias("n")
    )


_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS lineno, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_FENCED = f"""f AS (SELECT *, starts_with(regexp_replace(line, {_STRIP}, '', 'g'), '```') AS fence FROM l),
g AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY lineno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM f)"""


@query(
    rf"""WITH l AS ({_LINES}), {_FENCED},
s AS (SELECT doc_id, lineno, CASE WHEN fence OR in_code THEN line WHEN regexp_matches(line, '^{WS}*(?:[-*+]|\d+\.|>|\|)')
  THEN regexp_replace(line, '{WS}+$', '') ELSE regexp_replace(regexp_replace(line, '^{WS}+', ''), '{WS}+$', '') END AS st FROM g),
e AS (SELECT *, regexp_replace(st, {_STRIP}, '', 'g') AS core FROM s)
SELECT doc_id, md5(string_agg(CASE WHEN regexp_matches(st, '^#{{1,6}}{WS}') OR starts_with(st, '>') OR starts_with(st, '|') OR (length(core) >= 3 AND regexp_matches(core, '^[-_*]+$'))
  THEN '\' || st ELSE st END, chr(10) ORDER BY lineno)) AS md, count(*) AS n_lines FROM e GROUP BY 1"""
)
def document_lines_escaped(spark, sf_dir):
    """Every document with indents removed outside code and Markdown-sensitive lines escaped."""
    l = lines.without_indents(lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")  # noqa: E741
    l = l.withColumn("line", text.escape_line(F.col("line")))  # noqa: E741
    out = lines.joined(l, "doc_id", count="n_lines")
    return out.select("doc_id", F.md5("text").alias("md"), "n_lines")


@query(
    rf"""WITH l AS ({_LINES}), t AS (SELECT doc_id, lineno, line, generate_subscripts(k, 1) AS pos, unnest(k) AS token FROM
  (SELECT *, regexp_extract_all(line, '{K.GLUED_TOKEN}') AS k FROM l WHERE NOT regexp_matches(line, '{K.SKIPPED_LINE}')))
SELECT doc_id, lineno, token, left(regexp_replace(line, {_STRIP}, '', 'g'), 60) AS context FROM t WHERE regexp_matches(token, '{K.GLUE}')
QUALIFY row_number() OVER (PARTITION BY doc_id, token ORDER BY lineno, pos) = 1"""
)
def document_glued_tokens(spark, sf_dir):
    return lines.glued_tokens(lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(
    rf"""WITH l AS ({_LINES}), p AS (SELECT doc_id, lineno, regexp_replace(line, '{WS}+$', '') AS cur,
  regexp_replace(lead(line) OVER (PARTITION BY doc_id ORDER BY lineno), '^{WS}+', '') AS nxt FROM l)
SELECT doc_id, lineno, right(cur, 40) AS tail, left(nxt, 20) AS head FROM p WHERE nxt IS NOT NULL AND NOT regexp_matches(cur, '{K.SKIPPED_LINE}')
AND NOT regexp_matches(nxt, '{K.SKIPPED_LINE}') AND regexp_matches(cur, '{K.TAIL_WORD}') AND regexp_matches(nxt, '{K.HEAD_WORD}')"""
)
def document_soft_breaks(spark, sf_dir):
    return lines.soft_breaks(lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


# Lines with faults, made out of customers, as no document has them.
_FAULTS = """SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS lineno, CASE c_custkey % 7
 WHEN 0 THEN '```' WHEN 1 THEN '图' || c_custkey || c_name WHEN 2 THEN c_custkey || '.1' || c_name WHEN 3 THEN 'mso-' || c_name
 WHEN 4 THEN '表' || c_custkey || ' ' || c_name WHEN 5 THEN '1. ' || c_name ELSE c_name || ' PAGEREF' END AS line FROM customer"""


def _faults(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("docspark_customer")
    return spark.sql(_FAULTS.replace("FROM customer", "FROM docspark_customer")).withColumn("lineno", F.col("lineno").cast("int"))


@query(
    rf"""WITH l AS ({_FAULTS}), {_FENCED}, b AS (SELECT *, regexp_replace(line, {_STRIP}, '', 'g') AS bare FROM g WHERE NOT fence AND NOT in_code),
k AS (SELECT doc_id, lineno, CASE WHEN regexp_matches(line, '{K.RESIDUE}') THEN 'residue'
 WHEN regexp_matches(bare, '{K.GLUED_NUMBER}') AND NOT regexp_matches(line, '{K.SKIPPED_LINE}') THEN 'glued number'
 WHEN regexp_matches(bare, '{K.GLUED_CAPTION}') THEN 'glued caption' END AS kind, left(bare, 60) AS context FROM b)
SELECT * FROM k WHERE kind IS NOT NULL"""
)
def line_residues(spark, sf_dir):
    return lines.residues(_faults(spark, sf_dir), "doc_id")


# Faults in the words around, too: glued tokens, and lines that break between two words.
_FLAWED = f"""SELECT doc_id, lineno, CASE lineno % 9 WHEN 3 THEN 'one helloWorld' || lineno || ' two' WHEN 4 THEN 'begins with a word' WHEN 5 THEN 'and goes on' ELSE line END AS line FROM ({_FAULTS})"""


@query(
    rf"""WITH l AS ({_FLAWED}), {_FENCED}, b AS (SELECT *, regexp_replace(line, {_STRIP}, '', 'g') AS bare FROM g),
t AS (SELECT doc_id, lineno, bare, generate_subscripts(k, 1) AS pos, unnest(k) AS token FROM (SELECT *, regexp_extract_all(line, '{K.GLUED_TOKEN}') AS k FROM b WHERE NOT regexp_matches(line, '{K.SKIPPED_LINE}'))),
p AS (SELECT doc_id, lineno, regexp_replace(line, '{WS}+$', '') AS cur, regexp_replace(lead(line) OVER (PARTITION BY doc_id ORDER BY lineno), '^{WS}+', '') AS nxt FROM l),
e AS (SELECT doc_id, 0 AS s, lineno, token || ': ' || left(bare, 60) AS x FROM t WHERE regexp_matches(token, '{K.GLUE}') QUALIFY row_number() OVER (PARTITION BY doc_id, token ORDER BY lineno, pos) = 1
 UNION ALL SELECT doc_id, 1, lineno, right(cur, 40) || ' / ' || left(nxt, 20) FROM p WHERE nxt IS NOT NULL AND NOT regexp_matches(cur, '{K.SKIPPED_LINE}') AND NOT regexp_matches(nxt, '{K.SKIPPED_LINE}')
  AND regexp_matches(cur, '{K.TAIL_WORD}') AND regexp_matches(nxt, '{K.HEAD_WORD}')
 UNION ALL SELECT doc_id, 2, lineno, kind || ': ' || left(bare, 60) FROM (SELECT *, CASE WHEN regexp_matches(line, '{K.RESIDUE}') THEN 'residue' WHEN regexp_matches(bare, '{K.GLUED_NUMBER}') AND NOT regexp_matches(line, '{K.SKIPPED_LINE}') THEN 'glued number'
  WHEN regexp_matches(bare, '{K.GLUED_CAPTION}') THEN 'glued caption' END AS kind FROM b WHERE NOT fence AND NOT in_code) WHERE kind IS NOT NULL
 UNION ALL SELECT n_nationkey, 3, 0, n_name FROM nation WHERE n_nationkey % 2 = 0),
w AS (SELECT doc_id, s, string_agg('- line ' || lineno || ': ' || x, chr(10) ORDER BY lineno, '- line ' || lineno || ': ' || x) AS body FROM e GROUP BY ALL),
d AS (SELECT DISTINCT doc_id FROM l)
SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY i) AS report FROM (SELECT d2.doc_id, d2.i, '## ' || ['Glued tokens', 'Broken lines', 'Residues', 'Missed numbers'][d2.i + 1] || chr(10) || chr(10) || coalesce(w.body, '{K.NOTHING}') AS part
 FROM (SELECT doc_id, unnest(range(4)) AS i FROM d) d2 LEFT JOIN w ON w.doc_id = d2.doc_id AND w.s = d2.i) GROUP BY 1"""
)
def line_checklists(spark, sf_dir):
    """The findings of every document as a report, with numbers that were missed."""
    _faults(spark, sf_dir).createOrReplaceTempView("docspark_faults")
    l = spark.sql(_FLAWED.replace(f"({_FAULTS})", "docspark_faults"))  # noqa: E741
    n = F.col("n_nationkey")
    missed = table(spark, sf_dir, "nation").where(n % 2 == 0).select(n.cast(dict(l.dtypes)["doc_id"]).alias("doc_id"), F.col("n_name").alias("context"))
    return lines.checklist(l, "doc_id", missed)


@query(
    r"""SELECT c_custkey, '1.' || (c_custkey % 9) || ' **' || c_name || '**' || repeat(chr(10), least((c_custkey % 8)::INT, 4)) || 'x' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' **y**' END AS md FROM customer"""
)
def tidied_markdown(spark, sf_dir):
    """Leftovers of office markup, numbers before bold, empty bold and empty lines, made out of customers."""
    k = F.col("c_custkey")
    mark = F.when(k % 3 == 0, F.lit("[if !supportLists]")).when(k % 3 == 1, F.lit("StartFragment")).otherwise(F.lit(""))
    end = F.when(k % 3 == 0, F.lit("[endif]")).when(k % 3 == 1, F.lit("EndFragment")).otherwise(F.lit("****"))
    line = F.concat(mark, F.lit("1."), (k % 9).cast("string"), F.lit("**"), F.col("c_name"), F.lit("**"), end, F.repeat(F.lit("\n"), (k % 8).cast("int")), F.lit("x"))
    line = F.concat(line, F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(" **y**")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.tidy_markdown(line).alias("md"))


def _noisy(spark, sf_dir):
    """Documents, and some of them again garbled in four ways."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mojibake = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    g = (
        F.when(F.col("doc_id") % 4 == 0, mojibake)
        .when(F.col("doc_id") % 4 == 1, F.concat("text", F.repeat(F.lit("(cid:7)�"), F.greatest(F.floor(F.length("text") / 20), F.lit(1)).cast("int"))))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.repeat(F.lit("中"), F.length("text")), F.col("text")))
        .otherwise(F.concat("text", F.lit(K.MOJIBAKE)))
    )
    return d.withColumn("variant", F.lit(0)).unionByName(d.withColumn("text", g).withColumn("variant", F.lit(1)))


_NOISY = f"""d AS (SELECT doc_id, source, text, 0 AS variant FROM documents UNION ALL SELECT doc_id, source, CASE doc_id % 4
  WHEN 0 THEN array_to_string(list_transform(array_slice(range(0, strlen(text)), 1, strlen(text)), lambda i: chr(('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INT)), '')
  WHEN 1 THEN text || repeat('(cid:7){chr(0xFFFD)}', greatest(length(text) // 20, 1)) WHEN 2 THEN repeat('{chr(0x4E2D)}', length(text)) || text
  ELSE text || '{K.MOJIBAKE}' END, 1 FROM documents),
s AS (SELECT *, regexp_replace(text, '{WS}+', '', 'g') AS s FROM d),
c AS (SELECT *, length(s) AS n, len(regexp_extract_all(s, '{K.INVALID_CHARS}')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{K.CID}'), lambda x: length(x))), 0) AS n_invalid,
  len(regexp_extract_all(s, '{K.LATIN_CHARS}')) AS n_latin FROM s),
h AS (SELECT doc_id, variant, x, count(*) AS k FROM (SELECT doc_id, variant, unnest(string_split(s, '')) AS x FROM s WHERE s <> '') GROUP BY ALL),
t AS (SELECT doc_id, variant, arg_max(x, {{'k': k, 'u': -unicode(x)}}) AS top, max(k) AS n_top FROM h GROUP BY ALL),
v AS (SELECT doc_id, variant, source, length(regexp_replace(text, {_STRIP}, '', 'g')) AS chars, n, n_invalid, n_latin, coalesce(n_top, 0) AS n_top, contains(text, '{K.MOJIBAKE}') AS mojibake,
  n >= 30 AND (n_invalid / n >= 0.05 OR n_latin / n >= 0.25 OR (n >= 50 AND n_top / n >= 0.40 AND unicode(top) > 127 AND NOT contains('{K.TOP_CHARS_KEPT}', top)) OR contains(text, '{K.MOJIBAKE}')) AS garbled
  FROM c LEFT JOIN t USING (doc_id, variant))"""


@query(
    f"""WITH {_NOISY} SELECT doc_id, variant, n::INT AS n, n_invalid::INT AS n_invalid, n_latin::INT AS n_latin, n_top::INT AS n_top, garbled,
CASE WHEN n >= 30 THEN greatest(n_invalid / n, n_latin / n, n_top / n) ELSE 0.0::DOUBLE END AS suspect_ratio FROM v"""
)
def garbled_documents(spark, sf_dir):
    """Signals of garbled text for every document and its garbled double."""
    s = textlayer.signals(_noisy(spark, sf_dir), ["doc_id", "variant"], "text")
    return s.select("doc_id", "variant", "n", "n_invalid", "n_latin", "n_top", (F.size("reasons") > 0).alias("garbled"), "suspect_ratio")


@query(
    f"""WITH {_NOISY}, u AS (SELECT doc_id, variant, source, chars, n, garbled FROM v UNION ALL SELECT doc_id, 2, source, NULL, NULL, NULL FROM documents
 UNION ALL SELECT doc_id, 3, source, chars, CASE WHEN doc_id % 3 > 0 THEN 0 ELSE n END, garbled FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 > 0 THEN 0 ELSE chars END AS chars, CASE WHEN doc_id % 3 > 0 THEN false ELSE garbled END AS garbled) FROM v WHERE variant = 0)),
p AS (SELECT source, variant, count(*) AS n_pages, coalesce(sum(chars), 0)::BIGINT AS chars, count(*) FILTER (n > 0) AS n_filled, coalesce(list_sort(list(doc_id) FILTER (coalesce(n, 0) = 0)), []) AS empty_pages,
 coalesce(list_sort(list(doc_id) FILTER (garbled)), []) AS garbled_pages, coalesce(sum(chars), 0) > 100 AND count(*) FILTER (n > 0) / count(*) >= 0.5 AS has_text,
 coalesce(count(*) FILTER (garbled) / nullif(count(*) FILTER (n >= 30), 0) >= 0.05, false) AS bad, count(n) AS n_read FROM u GROUP BY ALL),
z AS (SELECT *, CASE WHEN n_read = 0 THEN 2 WHEN NOT has_text THEN 1 WHEN bad THEN 3 ELSE 0 END AS code FROM p)
SELECT source, variant, n_pages, chars, n_filled, empty_pages, garbled_pages, has_text, has_text AND bad AS garbled, CASE code WHEN 2 THEN 'error' WHEN 0 THEN 'text' ELSE 'image' END AS route, code::INT AS code FROM z"""
)
def source_routes(spark, sf_dir):
    """Per source whether its texts can be used or its pages have to be recognised anew; also if no page can be read,
    and if most are empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    unread = d.withColumn("text", F.lit(None).cast("string")).withColumn("variant", F.lit(2))
    blank = d.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.lit(" ")).otherwise(F.col("text"))).withColumn("variant", F.lit(3))
    pages = _noisy(spark, sf_dir).unionByName(unread).unionByName(blank)
    return textlayer.verdicts(textlayer.signals(pages, ["source", "variant", "doc_id"], "text"), ["source", "variant"], "doc_id")


@query("SELECT conv_id, string_agg('**' || role || ':** ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_parts FROM conversations GROUP BY 1")
def conversation_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("part", F.concat(F.lit("**"), F.col("role"), F.lit(":** "), F.coalesce("text", F.lit(""))))
    return blocks.document_order(c, "conv_id", ["turn"], "part")


@query(
    """WITH q AS (SELECT conv_id, turn, '"' || role || '" said: ' || coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN '"' ELSE '' END AS line FROM conversations),
p AS (SELECT *, string_split(line, '"') AS parts FROM q)
SELECT conv_id, turn, CASE WHEN len(parts) % 2 = 1 AND NOT contains(line, '<!--') THEN array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN '' WHEN i % 2 = 0 THEN '“' ELSE '”' END || x), '') ELSE line END AS line FROM p"""
)
def conversation_quotes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit('"'), F.col("role"), F.lit('" said: '), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, F.lit('"')).otherwise(F.lit("")))
    return c.select("conv_id", "turn", text.curly_quotes(line).alias("line"))


@query(
    """WITH a AS (SELECT doc_id % 50 AS k, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT item_id % 50 AS k, unnest(string_split(text, chr(10))) AS line FROM benchmark),
x AS (SELECT k, line, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT k, line, count(*) AS m FROM b GROUP BY ALL)
SELECT k, coalesce(sum(n), 0)::BIGINT AS n_a, coalesce(sum(m), 0)::BIGINT AS n_b, coalesce(sum(least(coalesce(n, 0), coalesce(m, 0))), 0)::BIGINT AS n_both,
CASE WHEN sum(n) > 0 THEN sum(least(coalesce(n, 0), coalesce(m, 0))) / sum(n) END AS share FROM x FULL JOIN y USING (k, line) GROUP BY k"""
)
def line_overlap(spark, sf_dir):
    """Share of the documents' lines that are lines of the benchmark, as multisets, by a coarse key."""
    split = lambda d, k: d.select((F.col(k) % 50).alias("k"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return audit.overlap(split(table(spark, sf_dir, "documents"), "doc_id"), split(table(spark, sf_dir, "benchmark"), "item_id"), "k", "line")


@query()
def page_blocks(spark, sf_dir):
    """Blocks of every page through the HTML parser."""
    return html.page_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    f"""WITH b AS (SELECT item_id, regexp_replace(text, '{WS}+', '', 'g') AS s, regexp_replace(CASE WHEN item_id % 2 = 0 THEN text ELSE left(text, (length(text) * (90 + item_id % 11)) // 100) END, '{WS}+', '', 'g') AS k FROM benchmark),
p AS (SELECT item_id, CASE WHEN s = '' THEN 100.0::DOUBLE ELSE (100.0::DOUBLE * length(k)) / length(s) END AS percent FROM b) SELECT *, percent < 98.5 AS low FROM p"""
)
def page_coverage(spark, sf_dir):
    """How much of each benchmark passage its Markdown-escaped form keeps, in order; every second one is cut off."""
    b = table(spark, sf_dir, "benchmark")
    k, n = F.col("item_id"), F.length("text")
    kept = F.when(k % 2 == 0, F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), F.floor(n * (90 + k % 11) / 100).cast("int")))
    return audit.matched_share(b.withColumn("md", F.concat(F.lit("\\"), kept)), "item_id", "text", "md")


# Paragraphs of each page: its links in order, every seventh one broken by text.
_PARAGRAPHS = f"p AS (SELECT page_id, seq, CASE WHEN seq % 7 = 6 THEN NULL ELSE {_entities(_HREF)} END AS anchor, {_LABEL} AS label FROM ({_LINKS}))"


@query(
    rf"""WITH {_PARAGRAPHS}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY page_id ORDER BY seq) AS run FROM p WHERE anchor IS NOT NULL AND anchor LIKE '/%'),
n AS (SELECT *, count(*) OVER (PARTITION BY page_id, run) AS n, min(seq) OVER (PARTITION BY page_id, run) AS st FROM r),
b AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY n DESC, st) AS best FROM n WHERE n >= 3)
SELECT page_id, seq, anchor, label FROM b WHERE best = 1"""
)
def toc_runs(spark, sf_dir):
    """The longest run of link paragraphs of every page."""
    links = html.links(table(spark, sf_dir, "pages"), "page_id", "html")
    p = links.select("page_id", "seq", F.when(F.col("seq") % 7 != 6, F.col("href")).alias("anchor"), "label")
    return toc.longest_link_run(p, links.where("href LIKE '/%'").select("page_id", F.col("href").alias("anchor")), "page_id")


@query(
    """WITH e AS (SELECT n_regionkey, n_nationkey AS seq, (n_nationkey % 3 + 1)::INT AS level, CASE WHEN n_nationkey % 2 = 0 THEN '_Toc' || n_nationkey ELSE '' END AS anchor,
 n_nationkey || '.' || n_regionkey AS number, n_name AS title, CASE WHEN n_nationkey % 4 < 3 THEN (n_nationkey * 2)::VARCHAR END AS page FROM nation)
SELECT n_regionkey, string_agg(repeat('  ', level - 1) || '- ' || CASE WHEN anchor <> '' THEN '[' || number || ' ' || title || '](#' || anchor || ')' ELSE number || ' ' || title END
 || CASE WHEN page IS NOT NULL THEN ' · ' || page ELSE '' END, chr(10) ORDER BY seq) AS toc FROM e GROUP BY 1"""
)
def toc_lists(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    e = n.select("n_regionkey", k.alias("seq"), (k % 3 + 1).cast("int").alias("level"), F.when(k % 2 == 0, F.concat(F.lit("_Toc"), k)).otherwise(F.lit("")).alias("anchor"),
                 F.concat_ws(".", k.cast("string"), r.cast("string")).alias("number"), F.col("n_name").alias("title"), F.when(k % 4 < 3, (k * 2).cast("string")).alias("page"))
    return toc.rendered_entries(e, "n_regionkey")


@query(
    rf"""WITH e AS (SELECT c_nationkey AS k, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN '_Toc' || (c_custkey % 40) ELSE '' END AS anchor, (c_custkey % 9 + 1) || '.' || (c_custkey % 4) || ' ' || c_mktsegment || ' ' || (c_custkey % 60) AS label FROM customer),
q AS (SELECT k, seq, anchor, regexp_extract(label, '{K.TOC_NUMBER}', 1) AS number, regexp_extract(label, '{K.TOC_NUMBER}', 2) AS title FROM e),
h AS (SELECT c_nationkey AS k, c_custkey AS hs, '_Toc' || (c_custkey % 50) AS ha, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 9 + 1) || '.' || (c_custkey % 4) || ' ' ELSE '' END || c_mktsegment || ' ' || (c_custkey % 60) AS ht FROM customer),
hk AS (SELECT *, regexp_replace(regexp_replace(ht, '^\d+(?:\.\d+)*\s*', ''), '{WS}+', '', 'g') AS hkey FROM h),
a AS (SELECT k, ha, hs, ht FROM hk QUALIFY row_number() OVER (PARTITION BY k, ha ORDER BY hs) = 1),
t AS (SELECT k, hkey, min(hs) AS hs, min(ht) AS ht FROM hk GROUP BY ALL HAVING count(*) = 1),
j AS (SELECT q.*, a.hs AS a_seq, coalesce(a.hs, t.hs) AS hs, coalesce(a.ht, t.ht) AS ht FROM q LEFT JOIN a ON q.k = a.k AND q.anchor = a.ha LEFT JOIN t ON q.k = t.k AND regexp_replace(q.title, '{WS}+', '', 'g') = t.hkey),
u AS (SELECT *, hs IS NOT NULL AND row_number() OVER (PARTITION BY k, hs ORDER BY seq) = 1 AS used FROM j)
SELECT k, seq, number, title, CASE WHEN used THEN hs END AS heading_seq, CASE WHEN used AND starts_with(ht, number) AND NOT regexp_matches(substr(ht, length(number) + 1, 1), '[\d.]') THEN 'already'
 WHEN used AND a_seq IS NOT NULL THEN 'anchor' WHEN used THEN 'title' END AS matched FROM u"""
)
def toc_headings(spark, sf_dir):
    """Entries of tables of contents matched to headings, both made out of customers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.concat_ws(".", (k % 9 + 1).cast("string"), (k % 4).cast("string"))
    name = F.concat_ws(" ", "c_mktsegment", (k % 60).cast("string"))
    e = c.select(F.col("c_nationkey").alias("k"), k.alias("seq"), F.when(k % 3 == 0, F.concat(F.lit("_Toc"), k % 40)).otherwise(F.lit("")).alias("anchor"), toc.entry_parts(F.concat_ws(" ", number, name)).alias("p"))
    h = c.select(F.col("c_nationkey").alias("k"), k.alias("seq"), F.concat(F.lit("_Toc"), k % 50).alias("anchor"), F.when(k % 5 == 0, F.concat_ws(" ", number, name)).otherwise(name).alias("text"))
    return toc.entries_to_headings(e.select("k", "seq", "anchor", "p.*"), h, "k")



@query(
    """SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS seq, (n_nationkey % 3 + 1)::INT AS level, '_Toc' || n_nationkey AS anchor,
 n_nationkey || '.1' AS number, n_name AS title, (n_nationkey * 2)::VARCHAR AS page FROM nation"""
)
def office_tocs(spark, sf_dir):
    """Entries of office tables of contents with the pages after their field comments."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    p = F.concat(F.lit('<p class="MsoToc'), (F.col("n_nationkey") % 3 + 1).cast("string"), F.lit('"><a href="#_Toc'), k, F.lit('">'), k, F.lit(".1 "), F.col("n_name"),
                 F.lit("....</a><!--[if PAGEREF]><![endif]-->"), (F.col("n_nationkey") * 2).cast("string"), F.lit("</p>"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", p.alias("p"))))
    d = n.groupBy("n_regionkey").agg(F.concat_ws("\n", F.transform(rows, lambda r: r["p"])).alias("html"))
    e = toc.office_entries(d, "n_regionkey", "html").withColumn("parts", toc.entry_parts(F.col("label")))
    return e.select("n_regionkey", "seq", "level", "anchor", "parts.number", "parts.title", "page")


@query("""SELECT n_nationkey, 'a ' || n_name || ' b  c' AS text, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json, repeat('#', (n_nationkey % 3 + 1)::INT) || ' ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' <a id="x' || n_nationkey || '"></a>' ELSE '' END AS heading FROM nation""")
def placeholders_and_headings(spark, sf_dir):
    """A table of contents put at the first placeholder, verdicts as JSON, headings with anchors."""
    from ..sources.markdown_sink import as_json

    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    anchor = F.when(k % 2 == 0, F.concat(F.lit("x"), k.cast("string")))
    return n.select(
        "n_nationkey",
        toc.placed(F.lit("a @@TOC@@ b @@TOC@@ c"), "@@TOC@@", F.col("n_name")).alias("text"),
        as_json("n_nationkey", "n_name").alias("json"),
        text.heading((k % 3 + 1).cast("int"), F.col("n_name"), anchor).alias("heading"),
    )
