import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lectern.functions import marks
from lectern.operators import review, validation
from lectern.sources import export, pages

KEY = ["doc_id"]


def lists(spark, entries, top):
    df = spark.createDataFrame([(1, level, t) for level, t in entries], "doc_id int, level string, text string")
    numbers = spark.range(1, top + 1).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("number"))
    every, errors = review.difficulty(df, numbers, KEY)
    s = review.difficulty_summary(every, KEY).first()
    e = errors.first()
    return s, e.errors if e else []


@pytest.mark.parametrize(
    "entries,top,counts,conflicts,unassigned,error",
    [
        ([("easy", "1-5, 8, 10-12")], 100, (9, 0, 0), [], 91, None), ([("easy", "abc")], 100, (0, 0, 0), [], 100, "invalid entry 'abc'"), ([("easy", "5-")], 100, (0, 0, 0), [], 100, "invalid entry '5-'"),
        ([("easy", "10-2")], 100, (0, 0, 0), [], 100, "malformed range"), ([("easy", "1-50"), ("medium", "51-150"), ("hard", "151-200")], 200, (50, 100, 50), [], 0, None),
        ([("easy", "1-20"), ("medium", "15-30")], 30, (14, 10, 0), list(range(15, 21)), 0, "assigned to both Easy and Medium"), ([("easy", "1-5, 9999")], 200, (5, 0, 0), [], 195, "9999"), ([("easy", "3, 1-4")], 9, (4, 0, 0), [], 5, "duplicate question number 3"), ([("easy", None)], 3, (0, 0, 0), [], 3, None),
    ],
)
def test_difficulty(spark, entries, top, counts, conflicts, unassigned, error):
    s, errors = lists(spark, entries, top)
    assert (s.easy, s.medium, s.hard) == counts and s.conflicts == conflicts and len(s.unassigned) == unassigned
    assert (error is None and not errors) or any(error in e for e in errors)


def test_overlay(spark):
    q = spark.createDataFrame([(1, 1, 1, "a", "HIGH"), (1, 2, 2, "b", "LOW"), (1, 3, 2, "c", "LOW")], "doc_id int, sequence_number int, number int, stem string, confidence string")
    edits = [(1, 1, 1, "set", "x"), (1, 2, 2, "set", "y"), (1, 1, 3, "reset", None), (1, 2, 4, "set", "z")]
    df = spark.createDataFrame(edits, "doc_id int, number int, edit_seq long, op string, s string").select("doc_id", "number", "edit_seq", "op", F.struct(F.col("s").alias("stem")).alias("patch"))
    got = sorted((r.sequence_number, r.stem, r.modified) for r in review.effective(q, df, KEY).collect())
    assert got == [(1, "a", False), (2, "z", True), (3, "z", True)]
    cleared = df.union(spark.createDataFrame([(1, 1, 9, "reset_all", None)], "doc_id int, number int, edit_seq long, op string, s string").select("doc_id", "number", "edit_seq", "op", F.struct(F.col("s").alias("stem"))))
    assert not any(r.modified for r in review.effective(q, cleared, KEY).collect())
    passage = spark.createDataFrame([([1, 2],)], "n array<int>").select(*review.passage_edits(F.col("n"), F.lit("p"), F.lit(5)))
    assert passage.count() == 2


def test_flags(spark):
    row = {"doc_id": 1, "sequence_number": 1, "number": 3, "stem": "s", "options": ("a", "b", "c", "d"), "is_image": False, "q_type": "MCQ", "passage": None, "correct_answer": "A", "explanation": "e", "notes": [], "source_method": "native", "source_confidence": 1.0}
    schema = "doc_id int, sequence_number int, number int, stem string, options struct<A:string,B:string,C:string,D:string>, is_image boolean, q_type string, passage string, correct_answer string, explanation string, notes array<string>, source_method string, source_confidence double"
    cases = [({}, "HIGH", 0), ({"stem": " "}, "LOW", 1), ({"correct_answer": ""}, "MEDIUM", 1), ({"correct_answer": "E"}, "LOW", 1), ({"options": ("", "b", "c", " ")}, "LOW", 2), ({"notes": ["odd"]}, "MEDIUM", 1), ({"notes": ["answer key conflict: x"]}, "LOW", 1), ({"source_method": "ocr", "source_confidence": 0.5}, "LOW", 1), ({"source_method": "ocr", "source_confidence": 0.7}, "MEDIUM", 1), ({"number": None}, "LOW", 1), ({"q_type": "PASSAGE_MCQ"}, "LOW", 1), ({"is_image": True, "options": ("", "", "", "")}, "LOW", 1)]
    df = spark.createDataFrame([tuple((row | c | {"sequence_number": i}).values()) for i, (c, _, _) in enumerate(cases)], schema)
    got = {r.sequence_number: r for r in validation.annotated(df).collect()}
    for i, (_, confidence, n) in enumerate(cases):
        assert (got[i].confidence, len(got[i].validation_flags)) == (confidence, n), (cases[i], got[i].validation_flags)
    schemes = spark.createDataFrame([(1,)], "doc_id int").select("doc_id", marks.build_scheme(F.lit(10), F.lit(-5), F.lit(-1)).alias("scheme"))
    (b,) = validation.blocking_errors(df, schemes, KEY).collect()
    assert b.errors[0].startswith("One or more") and b.errors[1] == "Duplicate question numbers: [3]" and b.errors[-1] == "Negative Marks cannot be negative."


def test_export(spark, tmp_path):
    with pytest.raises(ValueError):
        export.check_header(spark.range(1), KEY)
    got = spark.createDataFrame([('{"image_url":" ","data":{"url":"http://x "}}',), ('{"url":"u"}',), ("x",), (None,)], "p string").select(export.response_url("p").alias("u")).collect()
    assert [r.u for r in got] == ["http://x", "u", None, None]
    q = spark.createDataFrame([(1, 2, 2, "b", False, ("a", "b", "c", "d")), (1, 1, 1, "a", True, ("", "", "", ""))], "doc_id int, sequence_number int, number int, stem string, is_image boolean, options struct<A:string,B:string,C:string,D:string>")
    q = q.withColumns({c: F.lit("") for c in ("section", "passage", "correct_answer", "explanation")})
    images = spark.createDataFrame([(1, 1, "question", 1, "uploaded", "http://q"), (1, 1, "option_a", 2, "failed", None)], "doc_id int, number int, destination string, image_seq int, status string, image_url string")
    schemes = spark.createDataFrame([(1,)], "doc_id int").select("doc_id", marks.build_scheme(F.lit(2), F.lit(3), F.lit(None).cast("double")).alias("scheme"))
    t = export.table(q, review.image_columns(review.latest_images(images, KEY), KEY), schemes, KEY)
    row = t.where("sequence_number = 1").first()
    assert row["Question Image URL"] == "http://q" and row["Marks"] == "1.5" and row["Negative Marks"] == "0" and row["Question Text"].startswith("[IMAGE QUESTION") and row["Option Image URL A"] == ""
    export.write(t, str(tmp_path / "out"), KEY)
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "out")).count() == 2


def test_workbook():
    import io
    import zipfile
    from xml.etree import ElementTree

    row = ["7", "S & T", "objective_single_choice", "", "=1+1 <x>", "1.5", "0", *["a"] * 12]
    z = zipfile.ZipFile(io.BytesIO(export.workbook([tuple(row)])))
    assert z.testzip() is None and "xl/workbook.xml" in z.namelist()
    sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    head, one = sheet.iter(space + "row")
    assert ["".join(c.itertext()) for c in head] == list(export.HEADER)
    assert ["".join(c.itertext()) for c in one] == row and [c.get("t") for c in one][:5] == [None, "inlineStr", "inlineStr", None, "inlineStr"]


def test_confirmed(spark):
    cand = spark.createDataFrame([(1, 2, "option_a", "https://u", "h", 1), (1, 3, "ambiguous", "https://v", "i", 2), (1, 4, "question", None, "j", 3)], "doc_id int, number int, destination string, image_url string, sha256 string, candidate_no int")
    got = {r.number: r for r in review.confirmed(cand, 10).collect()}
    assert set(got) == {2, 4} and (got[2].status, got[4].status) == ("uploaded", "failed") and (got[2].image_seq, got[4].image_seq) == (11, 13)
    q = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "doc_id int, sequence_number int, source_page int")
    assert [r.sequence_number for r in review.on_page(q, 6).collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "s.env").write_text("# c\nA = 1\nB='two=2'\nnone\nC=3\n")
    got = pages.settings(spark.read.text(str(tmp_path / "s.env")), {"C": "env"}, {"D": "dflt"})
    assert got == {"A": "1", "B": "two=2", "C": "env", "D": "dflt"}
    spark.createDataFrame([(1, 1, "t", None, None)], pages.SCHEMAS["pages"]).write.parquet(str(tmp_path / "p"))
    assert pages.read(spark, str(tmp_path / "p"), "pages").count() == 1
    nested = spark.createDataFrame([(1, 1, [([([("x", [0.0, 1.0, 2.0, 3.0], 9.0, "F")],)],)])], "doc_id long, page_number int, blocks array<struct<lines:array<struct<spans:array<struct<text:string,bbox:array<double>,size:double,font:string>>>>>>")
    assert pages.flat_spans(nested).first().y1 == 3.0


def test_every_paper_has_a_workbook(spark, sf_dir):
    from lectern.plans.review import workbook_files

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").count()
    want = {r.l_orderkey: (f"exam{r.l_orderkey}{'_Paper_1' if r.l_orderkey % 20 == 0 else ''}_question_bank.xlsx", r["count"]) for r in items.collect()}
    assert {r.doc_id: (r.file_name, r.n_rows) for r in workbook_files(spark, sf_dir).collect()} == want


def test_every_question_is_exported(spark, sf_dir):
    from lectern.plans.review import ORACLES, export_rows

    from .oracle import check

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sizes = {r.l_orderkey: r["count"] for r in items.groupBy("l_orderkey").count().collect()}
    got = export_rows(spark, sf_dir).cache()
    assert max(sizes.values()) > 4 and {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == sizes
    # the registered SQL without its cap
    assert check(got, ORACLES["export_rows"].replace(" where n <= 4)", ")"), sf_dir) == sum(sizes.values())


def test_workbooks_are_packed_by_batch(spark):
    rows = [(1, 2, "2", "a<b&>"), (1, 1, "1.5", " x\n"), (2, 1, "n/a", ""), (None, 1, "7", "z")]
    df = spark.createDataFrame(rows, "k long, sequence_number int, number string, words string")
    values = {"Question No": "number", "Section": "words", "Question Text": "words"}
    t = df.select("k", "sequence_number", *(F.col(values[h]).alias(h) if h in values else F.lit("").alias(h) for h in export.HEADER))
    out = export.workbooks(t, ["k"], F.concat(F.lit("f"), F.col("k")))
    # no paper is a Python call of its own
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    blank = ("",) * (len(export.HEADER) - 5)
    line = lambda n, w: (n, w, "", "", w, *blank)
    want = {1: [line("1.5", " x\n"), line("2", "a<b&>")], 2: [line("n/a", "")], None: [line("7", "z")]}
    assert {r.k: bytes(r.content) for r in out.collect()} == {k: export.workbook(v) for k, v in want.items()}
    whole = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(export.workbook(want[1]))) as z, zipfile.ZipFile(whole, "w") as again:
        for name in z.namelist():
            again.writestr(zipfile.ZipInfo(name), z.read(name))
    assert whole.getvalue() == export.workbook(want[1])


def test_workbooks_move_no_joined_rows(spark, sf_dir):
    from lectern.plans.review import workbook_files

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = workbook_files(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    assert sum("Join" in x for x in plan) == 2
    for i, line in enumerate(plan):
        if "Exchange" in line:
            below = next((k for k in range(i + 1, len(plan)) if depth[k] <= depth[i]), len(plan))
            # questions are shuffled once, as they are read; neither joined rows nor sheet text are
            assert not any("Join" in x or "stem " in x or "<row>" in x for x in plan[i + 1 : below])


def test_papers_go_on_over_batches(spark):
    rows = [(k, n, str(n), f"p{k}&{n}") for k in range(5) for n in range(1 + 3 * (k % 3))] + [(None, n, "", "z<") for n in (1, 2, 3)]
    values = {"Question No": "number", "Section": "words"}
    df = spark.createDataFrame(rows, "k long, n int, number string, words string").repartition(3)
    t = df.select("k", F.col("n").alias("sequence_number"), *(F.col(values[h]).alias(h) if h in values else F.lit(None).cast("string").alias(h) for h in export.HEADER))
    want = {}
    for k, _, number, words in rows:
        want.setdefault(k, []).append((number, words, *[""] * (len(export.HEADER) - 2)))
    for size in ("1", "2", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = export.workbooks(t, ["k"], F.lit("f")).collect()
            sizes = export.workbooks(t, ["k"], F.lit("f"), ("size", IntegerType(), len)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {r.k: bytes(r.content) for r in got} == {k: export.workbook(v) for k, v in want.items()}
        assert {r.k: r.size for r in sizes} == {r.k: len(r.content) for r in got}


def test_sheet_is_read_as_by_zipfile():
    for n in (0, 1, 70):
        content = export.workbook([("1", "PK\x05\x06 xl/worksheets/sheet1.xml", *["é"] * 17)] * n)
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert export.sheet(content) == z.read("xl/worksheets/sheet1.xml") and export.sheet(content).count(b"<row>") == n + 1
    with pytest.raises(zipfile.BadZipFile):
        export.sheet(content.replace("é".encode(), "è".encode(), 1))
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a", "b")
    with pytest.raises(KeyError):
        export.sheet(other.getvalue())


def test_only_unfit_texts_change(spark):
    q = spark.createDataFrame([(1, 1, 1, "a\x00b\x1f", None), (1, 2, 2, "\x7f\tc", "d\x0b"), (1, 3, None, "é", " e ")], "doc_id int, sequence_number int, number int, stem string, section string")
    q = q.withColumns({c: F.lit("") for c in ("passage", "correct_answer", "explanation")} | {"is_image": F.lit(False), "options": F.struct(*(F.lit(x).alias(x) for x in "ABCD"))})
    images = spark.createDataFrame([(1, n, "option_b", n, "uploaded", f"u{n}\x01") for n in (2, 3)], "doc_id int, number int, destination string, image_seq int, status string, image_url string")
    schemes = spark.createDataFrame([(2,)], "doc_id int").select("doc_id", marks.build_scheme(F.lit(2), F.lit(3), F.lit(None).cast("double")).alias("scheme"))
    t = export.table(q, review.image_columns(images, KEY), schemes, KEY).orderBy("sequence_number").collect()
    assert [(r["Question Text"], r["Section"], r["Option B"], r["Option Image URL B"], r["Question No"]) for r in t] == [("ab", "", "B", "", "1"), ("\tc", "d", "B", "u2", "2"), ("é", " e ", "B", "", "")]
