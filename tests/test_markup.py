from pyspark.sql import functions as F

from strandline.operators import markup as mk

BODY = """<p>매출 현황</p><p>(단위 : 백만원)</p><p>제1기</p>
<table><tr><th>구분</th><th>금액</th></tr><tr><td>A&amp;B</td><td>1,000</td></tr><tr><td></td><td> </td></tr></table>
<table><tr><td>(단위: 천주)</td></tr><tr><td>x</td><td>&lt;2&gt;</td></tr></table>
<table><tr><td>plain</td></tr></table>
after &#x1;the tables<br>one<br>two<table><tr><td></td></tr></table><table><tr><td>last</td></tr></table>tail"""


def sections(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, pos int, category string, body string, extra string")


def test_tables_carry_unit_category_and_rank(spark):
    frame = sections(spark, (1, 0, "business", BODY, "x"), (1, 3, "business", "<p>단위: %</p><table><tr><td>9</td></tr></table>", None),
                     (1, 4, "debt", "<table><tr><td>8</td></tr></table>", None), (2, 0, "debt", None, None), (3, 0, "debt", "", None))
    got = sorted(tuple(r) for r in mk.section_tables(frame).select("page_id", "pos", "category", "item_no", "table_n", "unit", F.to_json("rows")).collect())
    assert got == [
        (1, 0, "business", 3, 1, "백만원", '[["구분","금액"],["A&B","1,000"]]'),
        (1, 0, "business", 4, 2, "천주", '[["(단위: 천주)"],["x","<2>"]]'),
        (1, 0, "business", 5, 3, None, '[["plain"]]'),       # the two items before it are tables, whose text is not looked at
        (1, 0, "business", 10, 4, None, '[["last"]]'),       # an empty table is an item without rows
        (1, 3, "business", 1, 5, "%", '[["9"]]'), (1, 4, "debt", 0, 1, None, '[["8"]]')]
    rows = mk.table_rows(frame).where("page_id = 1 AND item_no = 4").orderBy("row_no").collect()
    assert [(r.row_no, r.cells, r.unit) for r in rows] == [(0, ["(단위: 천주)"], "천주"), (1, ["x", "<2>"], "천주")]


def test_text_outside_tables_is_kept_in_page_order(spark):
    pages = spark.createDataFrame([(1, BODY), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r.text for r in mk.disclosure_text(pages, tables="table").collect()}
    assert got[1].split("\n") == ["매출 현황", "(단위 : 백만원)", "제1기", "구분 | 금액 / A&B | 1,000", "(단위: 천주) / x | <2>", "plain", "after the tables", "one", "two", "last", "tail"]
    assert got[2] == got[3] == ""


def test_marks_in_a_body_change_nothing(spark):
    pages = spark.createDataFrame([(1, "a﷐b&#xFDD1;c<table>﷑<tr><td>d﷓e</td></tr></table>")], "page_id long, html string")
    assert mk.disclosure_text(pages).first().text == "abc\nde"
