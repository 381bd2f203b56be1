"""Operators against plain folds over random inputs, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import audit, blocks, boxes, layout, lines, numbering, tables, textlayer


def fold_numbers(paragraphs, spec, depth):
    """Counters after each paragraph, one at a time."""
    state, pinned, out = {}, {}, []
    for level in paragraphs:
        for k in range(depth):
            start, restart, override = spec[k]
            if level < k and (restart is None or (restart != 0 and restart == level)) and k in state:
                state[k] = 0
                pinned.pop(k, None)
        for k in range(level + 1):
            start, _, override = spec[k]
            if override is not None and k not in pinned and k not in state:
                state[k], pinned[k] = override, True
                if k == level:
                    continue
            elif k == level:
                cur = state.get(k, 0)
                state[k] = start if cur == 0 else cur + 1
        out.append([state.get(k, spec[k][0]) for k in range(depth)])
    return out


def test_numbering_without_overrides(spark):
    random.seed(3)
    depth, rows, levels, want = 4, [], [], {}
    for doc in range(40):
        spec = [(random.choice([1, 1, 3, 0]), random.choice([None, None, 0, 1]), None) for _ in range(depth)]
        para = [random.randrange(depth) for _ in range(random.randrange(1, 25))]
        levels += [(doc, k, s, r, o) for k, (s, r, o) in enumerate(spec)]
        rows += [(doc, i, level) for i, level in enumerate(para)]
        for i, v in enumerate(fold_numbers(para, spec, depth)):
            want[doc, i] = v
    p = spark.createDataFrame(rows, "d int, seq int, ilvl int")
    l = spark.createDataFrame(levels, "d int, ilvl int, start int, restart int, override int")  # noqa: E741
    got = {(r["d"], r["seq"]): [r[f"v{k}"] for k in range(depth)] for r in numbering.level_values(p, l, ["d"], depth).collect()}
    assert got == want


def test_numbering_override_pins_the_first_value(spark):
    p = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "d int, seq int, ilvl int")
    l = spark.createDataFrame([(1, 0, 1, None, 4)], "d int, ilvl int, start int, restart int, override int")  # noqa: E741
    assert [r["v0"] for r in numbering.level_values(p, l, ["d"], 1).orderBy("seq").collect()] == [4, 5]


def fold_rows(rows):
    """Continuation rows put back, column by column."""
    width, anchors = len(rows[0]), [i for i, r in enumerate(rows) if r[0]]
    out = {i: list(rows[i]) for i in anchors}
    groups, at = [], 0
    for a in [*anchors, len(rows)]:
        groups.append([i for i in range(at, a) if not rows[i][0]])
        at = a + 1
    for g, pieces in enumerate(groups):
        above, below = (anchors[g - 1] if g else None), (anchors[g] if g < len(anchors) else None)
        for c in range(width):
            text = "<br>".join(rows[i][c] for i in pieces if rows[i][c])
            if not text or (above is None and below is None):
                continue
            down = above is None or (below is not None and out[above][c] and not rows[below][c])
            if down:
                out[below][c] = "<br>".join(x for x in (text, out[below][c]) if x)
            else:
                out[above][c] = "<br>".join(x for x in (out[above][c], text) if x)
    return out


def test_continuations(spark):
    random.seed(5)
    cells, want = [], {}
    for doc in range(60):
        rows = [[random.choice(["", f"{r}a"]), random.choice(["", f"{r}b"]), random.choice(["", "", f"{r}c"])] for r in range(random.randrange(1, 9))]
        cells += [(doc, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
        want |= {(doc, r, c): t for r, row in fold_rows(rows).items() for c, t in enumerate(row)}
    df = spark.createDataFrame(cells, "d int, r int, c int, text string")
    got = {(x["d"], x["r"], x["c"]): x["text"] for x in tables.merged_continuations(df, ["d"]).collect()}
    assert got == want


def test_blocks_leave_out_the_front_matter(spark):
    text = "---\ntitle: a\n---\n# H\n\n1. x\n5) y\n```py\n# no\n```\n```\nz\n```\n> q\n| a |\n"
    d = spark.createDataFrame([(1, text), (2, "---\nno end"), (3, "")], "k int, text string")
    got = [(r["kind"], r["n_lines"]) for r in blocks.blocks(lines.lines_of(d, "k", "text"), "k").where("k = 1").orderBy("block").collect()]
    assert got == [("heading", 1), ("ordered", 2), ("code", 3), ("code", 3), ("quote", 1), ("table", 1)]
    items = blocks.renumbered(lines.lines_of(d, "k", "text"), "k").orderBy("lineno").collect()
    assert [(r["number"], r["text"]) for r in items] == [(1, "x"), (2, "y")]


def test_checklist_says_nothing_found(spark):
    d = spark.createDataFrame([(1, "fine"), (2, "one helloWorld12 two\nmso- x")], "k int, text string")
    got = {r["k"]: r["report"] for r in lines.checklist(lines.lines_of(d, "k", "text"), "k").collect()}
    assert got[1].count("（无）") == 3
    assert "helloWorld12" in got[2] and "residue: mso- x" in got[2]


def test_rows_of_boxes(spark):
    rows = [(1, 1, 50.0, 2.0, 60.0, 12.0, "b"), (1, 2, 0.0, 0.0, 10.0, 10.0, "a"), (1, 3, 0.0, 40.0, 10.0, 50.0, "c"), (2, 1, 0.0, 0.0, 1.0, 1.0, "z")]
    b = boxes.rows_of_boxes(spark.createDataFrame(rows, "img int, seq int, x0 double, y0 double, x1 double, y1 double, text string"), "img")
    assert {(r["img"], r["text"]): r["row"] for r in b.collect()} == {(1, "a"): 1, (1, "b"): 1, (1, "c"): 2, (2, "z"): 1}
    assert {r["img"]: r["text"] for r in boxes.text_of_rows(b, "img").collect()} == {1: "a b\nc", 2: "z"}


def test_equal_tables_remove_each_other(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.0, 0.0, 9.0, 9.0), (1, 3, 20.0, 0.0, 29.0, 9.0)], "p int, tbl int, x0 double, y0 double, x1 double, y1 double")
    assert [r["tbl"] for r in layout.nested_tables(t, ["p"]).collect()] == [3]


def test_alignment(spark):
    a = spark.createDataFrame([(1, 1, "x", "1"), (1, 2, "y", "2"), (1, 3, "x", "3")], "k int, seq long, item string, number string")
    b = spark.createDataFrame([(1, 1, "x", "1"), (1, 2, "x", "9"), (1, 3, "y", "2")], "k int, seq long, item string, number string")
    got = audit.aligned(a, b, "k").orderBy("a_seq").collect()
    assert [(r["b_seq"], r["equal"]) for r in got] == [(1, True), (3, True), (None, False)]


def test_matched_share(spark):
    d = spark.createDataFrame([(1, "abcdef", "abc def"), (2, "abcd", "ab"), (3, None, "x")], "k int, a string, b string")
    got = {r["k"]: (r["percent"], r["low"]) for r in audit.matched_share(d, "k", "a", "b").collect()}
    assert got == {1: (100.0, False), 2: (50.0, True), 3: (100.0, False)}


def test_user_patterns_win(spark):
    d = spark.createDataFrame([("abc, def",), ("第一章",), ("text",)], "t string")
    level = layout.heading_level(F.col("t"), F.lit(10.0), F.lit(False), F.lit(10.0), ["^abc"])
    assert [r[0] for r in d.select(level).collect()] == [2, 3, None]


def test_style_numbering_follows_the_whole_chain(spark):
    """Forty links, cycles, and two documents with the same style ids."""
    rows = [(1, k, k - 1 if k else None, None if k else 7, None) for k in range(41)]
    rows += [(1, 50, 51, None, None), (1, 51, 52, None, None), (1, 52, 51, None, None), (1, 60, 99, None, 3)]
    rows += [(2, 0, None, 8, 2), (2, 1, 0, None, None), (2, None, 0, None, None)]
    styles = spark.createDataFrame(rows, "d int, style_id long, based_on long, num_id long, ilvl int")
    got = {(r["d"], r["style_id"]): (r["num_id"], r["ilvl"]) for r in numbering.style_numbering(styles, ["d"]).collect()}
    assert got == {(1, k): (7, 0) for k in range(41)} | {(2, 0): (8, 2), (2, 1): (8, 2), (2, None): (8, 2)}


def test_signals_of_pages(spark):
    pages = [(1, "a� b(cid:12)é×"), (2, ""), (3, None), (4, "中" * 60 + "x" * 40)]
    got = {r["p"]: r for r in textlayer.signals(spark.createDataFrame(pages, "p int, t string"), ["p"], "t").collect()}
    assert (got[1]["n"], got[1]["n_invalid"], got[1]["n_latin"]) == (13, 9, 1)
    assert (got[2]["n"], got[2]["top"], got[2]["n_top"], got[3]["n"], got[3]["reasons"]) == (0, None, 0, None, None)
    assert (got[4]["top"], got[4]["n_top"], got[4]["reasons"]) == ("中", 60, ["repeated"])


def test_any_engine_may_recognise_images(spark):
    def engine(content):
        if content == b"bad":
            raise ValueError("no image")
        return [(0, 0, 9, 9, content.decode()), (20, 0, 29, 9, "x")]

    images = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, None)], "img int, content binary")
    b = boxes.rows_of_boxes(boxes.recognised(images, "img", engine), "img")
    assert {r["img"]: r["text"] for r in boxes.text_of_rows(b, "img").collect()} == {1: "a x"}


def test_a_style_without_css_is_refused(spark):
    d = spark.createDataFrame([("```css\n p{} \n```",)], "t string")
    assert d.select(text.required_fence(F.col("t"), "css")).first()[0] == "p{}"
    for bad in ("none", "```css\n \n```"):
        with pytest.raises(Exception, match="no ```css block"):
            spark.createDataFrame([(bad,)], "t string").select(text.required_fence(F.col("t"), "css")).collect()


def test_captions_of_a_long_document(spark):
    """The next line that counts is found in one pass: no window frame reaches down to the end."""
    n = 60_000
    line = F.when(F.col("id") == n - 1, F.lit("图1 plan")).when(F.col("id") % 2 == 0, F.lit("![](a.png)")).otherwise(F.lit(" "))
    l = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("lineno"), line.alias("line"))  # noqa: E741
    out = lines.captions_into_images(l, "k")
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["lineno"]: r["line"] for r in out.where(f"lineno >= {n - 4}").collect()}
    assert got == {n - 4: "![](a.png)", n - 3: " ", n - 2: "![图1 plan](a.png)", n - 1: "图1 plan"}


def test_long_tables_are_rendered_once(spark):
    """A cell is cleaned in one place of the plan, and a table of many rows is not gone through anew for each."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.when(i % 2 == 0, F.array(i.cast("string"), F.lit(" a|b "))).otherwise(F.array(i.cast("string"))))
    out = spark.range(1).select(tables.rendered_rows(F.concat(F.array(F.array(F.lit("h"))), cells, F.array(F.array(F.lit(" "))))).alias("md"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") == 1
    got = out.first()["md"].split("\n")
    assert got[:4] == ["| h |  |", "|---|---|", "| 1 |  |", "| 2 | a\\|b |"] and len(got) == 3002
    empty = spark.range(1).select(tables.rendered_rows(F.array(F.array(F.lit(" "), F.lit(None).cast("string")))).alias("md"))
    assert empty.first()["md"] is None


def test_signals_need_no_row_per_character(spark):
    """A page's characters are counted in its own row; ties go to the smaller code point, and bytes that are no UTF-8 end no job."""
    pages = [(1, bytearray("b　a😀😀é é".encode())), (2, bytearray(b"ab\xff")), (3, bytearray(b" \n"))]
    out = textlayer.signals(spark.createDataFrame(pages, "p int, raw binary").select("p", F.col("raw").cast("string").alias("t")), ["p"], "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r["p"]: r for r in out.collect()}
    assert (got[1]["n"], got[1]["n_latin"], got[1]["top"], got[1]["n_top"]) == (6, 2, "é", 2)
    assert (got[2]["n"], got[2]["n_invalid"]) == (3, 1)
    assert (got[3]["chars"], got[3]["n"], got[3]["top"], got[3]["n_top"]) == (0, 0, None, 0)


def test_lists_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """More input means more sorts, not larger ones; a list stays in one part."""
    spark.range(20_000).selectExpr("id % 500 AS d", "id AS seq", "CAST(id % 2 AS int) AS ilvl").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    levels = [(d, k, 1, None, None) for d in range(500) for k in range(2)]
    l = spark.createDataFrame(levels, "d long, ilvl int, start int, restart int, override int")  # noqa: E741
    size = sum(f.stat().st_size for f in (tmp_path / "p").glob("*.parquet"))
    monkeypatch.setattr(numbering, "PART_BYTES", size // 20)
    l.write.parquet(str(tmp_path / "l"))
    l = spark.read.parquet(str(tmp_path / "l")).hint("merge")  # noqa: E741
    found = numbering.level_values(p, l, ["d"], 2).withColumn("part", F.spark_partition_id())
    parts = found.groupBy("d").agg(F.count_distinct("part").alias("n"), F.min("part").alias("part"), F.count("*").alias("rows")).collect()
    assert {r["n"] for r in parts} == {1} and sum(r["rows"] for r in parts) == 20_000
    assert len({r["part"] for r in parts}) >= 15
