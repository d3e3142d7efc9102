"""Rows and cells by tags."""

from cardiolake.sources import html


def rows(page, tags=html.TABLES):
    parser = html.RowParser(tags)
    parser.feed(page)
    parser.close()
    return parser.found


def test_rows_and_cells():
    assert rows("<TABLE><tr align=right><td align=center>100<td> 2239 </td><th>a&amp;b<br>c</tr><tr><td>x</table>") == [(0, 0, ["100", "2239", "a&b c"]), (0, 1, ["x"])]
    assert rows("<p>no table <td>x") == [] and rows("<table></table><table><td>1</table>") == [(1, 0, ["1"])]


def test_spans_cover_columns_and_rows():
    page = "<table><tr><td rowspan=3>a<td colspan=2>b<td rowspan=2>c<tr><td>d<td>e<tr><td>f<td>g<td>h<tr><td>i</table>"
    assert [r[2] for r in rows(page)] == [["a", "b", "b", "c"], ["a", "d", "e", "c"], ["a", "f", "g", "h"], ["i"]]
    assert [r[2] for r in rows("<table><tr><td>a<td rowspan=3>z<tr><td>b<tr><td>c<td>d</table>")] == [["a", "z"], ["b", "z"], ["c", "z", "d"]]
    assert [r[2] for r in rows("<table><tr><td rowspan=0 colspan=x>a<td>b</table>")] == [["a", "b"]]
    assert [r[2] for r in rows("<table><tr><td>a<td>b<td rowspan=3>z<tr><td>c<tr><td>d<td>e</table>")] == [["a", "b", "z"], ["c"], ["d", "e", "z"]]


def test_nesting_and_silence():
    page = "<table><tr><td>out <table><tr><td>in<script>var x='<td>'</script></td></tr></table>side<td>next</table>"
    assert sorted(rows(page)) == [(0, 0, ["out side", "next"]), (1, 0, ["in"])]
    assert rows("<ul><li>a<li>b<ul><li>c</ul></ul>", html.LISTS) == [(1, 0, ["c"]), (0, 0, ["a", "b"])]


def test_files_and_frames(spark, tmp_path):
    (tmp_path / "t.htm").write_text("<table><tr><td>Record<td>N</tr>\n<tr><td>100</td>\n<td>2239</td></tr></table>")
    assert [tuple(r) for r in html.read_summary_rows(spark, str(tmp_path / "*.htm")).orderBy("row").collect()] == [("t.htm", 0, 0, ["Record", "N"]), ("t.htm", 0, 1, ["100", "2239"])]
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<table><td>x")], "page_id int, html string")
    assert [tuple(r) for r in html.html_rows(pages).collect()] == [(3, 0, 0, ["x"])]
