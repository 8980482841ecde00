"""Main text by block scores: menus in plain blocks go, prose stays."""

from pyspark.sql import functions as F

from areapulse.operators.blocks import dense_text, page_blocks

PROSE = "The council met on Monday to discuss the new budget for schools and roads in the northern part of the district."
PAGE = f"""<html><head><title>x</title></head><body>
<div class="menu"><div><a href="/">Home</a></div><div><a href="/n">News</a> <a href="/s">Sport</a></div></div>
<div><h1>Budget talks</h1><p>{PROSE} See <a href="/b">the draft</a>.</p><p>It was late.</p><p>{PROSE}</p></div>
<a href="/r"><div>Related story one</div>
<div>Another story</div><div>A third</div></a>
<div>Share this</div><div><a href="/c">Contact</a> us</div></body></html>"""


def blocks_of(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").withColumn("b", page_blocks(F.col("h")))
    return df.select("i", "b", dense_text(F.col("b")).alias("t")).orderBy("i").collect()


def test_menus_in_plain_blocks_go(spark):
    (row,) = blocks_of(spark, [PAGE])
    assert row["t"].split("\n") == ["Budget talks", f"{PROSE} See the draft.", "It was late.", PROSE]
    by = {b["text"]: (b["n_words"], b["n_link_words"]) for b in row["b"]}
    assert by["News Sport"] == (2, 2) and by["Contact us"] == (2, 1)
    assert by["Related story one"] == (3, 3) and by["Another story"] == (2, 2) and by["A third"] == (2, 2)


def test_score_counts_the_neighbours(spark):
    (row,) = blocks_of(spark, ["<p>a b c</p><p>d e</p><p>f <a>g</a></p>"])
    assert [b["score"] for b in row["b"]] == [3 * 2 + 2, 3 + 2 * 2 + 1, 2 + 1 * 2]


def test_odd_pages(spark):
    pages = [None, "", "Hello there", "<a>only</a>", "<p>a<a>b</p><p>c</p>", "x</a> y", "<p>one\x01two\x02 &amp;nbsp;</p>", "<p>é 　ü</p>"]
    got = blocks_of(spark, pages)
    assert [r["t"] for r in got] == ["", "", "Hello there", "", "c", "x y", "one two &nbsp;", "é ü"]
    unclosed = got[4]["b"]
    assert [(b["n_words"], b["n_link_words"]) for b in unclosed] == [(1, 1), (1, 0)]
    assert blocks_of(spark, []) == []


def test_very_long_page(spark):
    (row,) = blocks_of(spark, [f"<div><a>menu entry</a></div><p>{PROSE}</p>" * 20000])
    assert len(row["b"]) == 40000 and row["t"].count("\n") == 19999 and "menu" not in row["t"]
