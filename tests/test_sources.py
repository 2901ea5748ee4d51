import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.session import new_path
from lodestone.sources import drifting as J
from lodestone.sources import index_pages as X
from lodestone.sources import spreadsheets as S


def test_drifting_shapes_are_read_or_kept_apart(spark):
    rows = [("a", '[{"k":1},{"k":"x","m":{"size":3}},5,null]'), ("b", '{"entities":[{"k":2}],"x":1}'), ("c", '{"k":3,"m":{"size":"7"}}'), ("d", '{"k":'), ("e", None), ("f", " "), ("g", "5"), ("h", '{"relations":[{"k":null}]}'), ("i", '{"entities":7}'), ("j", "[]")]
    records, unread = J.split_records(spark.createDataFrame(rows, "id string, body string"), ["entities", "relations"])
    found, odd = J.fields(records, {"k": "long", "m.size": "int"})
    assert {tuple(r) for r in found.collect()} == {("a", 0, 1, None), ("b", 0, 2, None), ("c", 0, 3, 7), ("h", 0, None, None), ("i", 0, None, None)}
    assert {(r["id"], r["place"], r["reason"]) for r in unread.collect()} == {("d", None, "not_json"), ("e", None, "empty"), ("f", None, "empty"), ("g", None, "not_an_object"), ("a", 2, "not_an_object"), ("a", 3, "not_an_object")}
    assert [(r["id"], r["place"], r["reason"]) for r in odd.collect()] == [("a", 1, "wrong_kind: k")]
    with pytest.raises(ValueError):
        J.fields(records, {"a.k": "long", "k": "long"})


def test_answers_of_interfaces(spark):
    bodies = ['{"parse":{"title":" T ","text":{"*":"<p>x"}}}', '{"parse":{"title":"U","text":"<b>"}}', "x", '{"parse":{}}']
    wiki = spark.createDataFrame([(b,) for b in bodies], "b string").select(J.wiki_text(F.col("b")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in wiki] == [("T", "<p>x"), ("U", "<b>"), ("", None), ("", None)]
    bodies = ['{"title":" A ","fulltext":[" p1 "," ","p2"]}', '{"fulltext":"one"}', '{"error":{"code":"ERR_REQUIRES_AUTHENTICATION"}}', '{"code":"auth"}', '{"subsections":["x"]}', '{"subsections":["x"],"fulltext":["y"]}', '{"title":"B","fulltext":[]}', "x"]
    texts = spark.createDataFrame([(b,) for b in bodies], "b string").select(J.archive_text(F.col("b")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in texts] == [("A", "p1\n\np2", None), ("", "one", None), ("", None, "login"), ("", None, "login"), ("", None, "login"), ("", "y", None), ("B", None, "no_text"), ("", None, "not_json")]


def test_files_below_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.json").write_text('[{"k": 1}]')
    (tmp_path / "two.json").write_text("no")
    (tmp_path / "three.txt").write_text("[]")
    assert {tuple(r) for r in J.read_texts(spark, str(tmp_path)).collect()} == {("one", '[{"k": 1}]'), ("two", "no")}


PAGE = """<html><ul><li><a href="/wiki/outside">outside</a></li></ul><div id="content"><div><h2> First <i>class</i></h2>
<ol><li><strong>hot</strong><ul><li><a href="/wiki/a">A</a><li><a href="/wiki/b"> B<br></a><li><a href="/other/c">C</a></ul></li>
<li><ul><li><a href="/wiki/d">D</a></ul> <strong>late</strong></li></ol></div>
<h2>Second</h2><ul><li><a href="/wiki/e">E</a></li><li><a href="/wiki/a2">A</a></li><li><a href="/wiki/empty"> </a></li></ul><p><a href="/wiki/f">F</a></p></div>
<h2>After</h2><ul><li><a href="/wiki/g">G</a></li></ul></html>"""


def test_index_pages(spark):
    pages = spark.createDataFrame([(2, PAGE), (1, '<div id="content"><ul><li><a href="/wiki/z">E</a></ul>'), (3, None), (4, "<ol><li>")], "page_id long, html string").repartition(3)
    entries = X.index_entries(pages)
    assert [tuple(r)[2:] for r in entries.filter("page_id = 2").orderBy("place").collect()] == [("Firstclass", "hot", "A", "/wiki/a"), ("Firstclass", "hot", "B", "/wiki/b"), ("Firstclass", "late", "D", "/wiki/d"), ("Second", "", "E", "/wiki/e"), ("Second", "", "A", "/wiki/a2")]
    first = {r["name"]: (r["page_id"], r["href"]) for r in X.first_entries(entries).collect()}
    assert first == {"A": (2, "/wiki/a"), "B": (2, "/wiki/b"), "D": (2, "/wiki/d"), "E": (1, "/wiki/z")}
    numbered = X.index_entries(pages, lists=("ol",)).collect()
    assert {r["name"] for r in numbered} == {"A", "B", "D"}


def test_workbooks_round_trip(spark, monkeypatch):
    spark.dataSource.register(S.Workbooks)
    path = new_path(spark, "books")
    rows = spark.range(100_000).select(F.concat(F.lit("n<&> "), F.col("id").cast("string"), F.lit(" é\n中")).alias("name"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("/u/"), F.col("id").cast("string"))).alias("url"), (F.col("id") / 2).alias("half"), (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none"))
    rows.repartition(3).write.format("workbooks").mode("append").save(path)
    back = spark.read.format("workbooks").load(path)
    assert back.count() == 100_000 and back.select("file").distinct().count() == 3
    named = S.named_rows(back, "name", "url", "half")
    assert named.count() == 75_000
    found = named.filter("url = '/u/7'").first()
    assert found["name"] == "n<&> 7 é\n中" and found["rel"] == "3.5" and found["meta"] == {"even": "false"}
    want = rows.filter("url IS NOT NULL").select("name", "url")
    assert named.select("name", "url").exceptAll(want).isEmpty()


def test_workbooks_of_other_writers(spark, tmp_path):
    """Shared strings, gaps, booleans, a second sheet and parts named from the root."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        book.writestr("xl/worksheets/a.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>url</t></is></c><c r="D1"><v>9</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>1</v></c><c r="C3" t="str"><v>/x</v></c><c r="D3" t="b"><v>1</v></c></row></sheetData></worksheet>')
        book.writestr("xl/worksheets/b.xml", f"<worksheet {main}><sheetData/></worksheet>")
    spark.dataSource.register(S.Workbooks)
    back = spark.read.format("workbooks").load(str(tmp_path)).collect()
    assert [(r["file"], r["sheet"], r["row"], r["cells"]) for r in back] == [("b.xlsx", "One", 3, {"name": "rich", "url": "/x", "9": "true"})]
