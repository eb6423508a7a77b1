"""Sinks: the nineteen-column question table, one folder for each paper, and what an upload service answers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from ..functions.text import XML_UNFIT, strip, xml_clean

# The columns of the export, question types (the first is the default) and levels.
HEADER = (
    "Question No", "Section", "Question Type", "Difficulty Level", "Question Text", "Marks", "Negative Marks", "Option A", "Option Image URL A", "Option B", "Option Image URL B",
    "Option C", "Option Image URL C", "Option D", "Option Image URL D", "Correct Answer", "Question Image URL", "Question Explanation", "Question Explanation Image",
)
TYPES = ("objective_single_choice", "objective_multiple_choice", "subjective_short", "subjective_long", "assertion", "reasoning")
LEVELS = ("easy", "medium", "hard")
IMAGE_NOTICE = "[IMAGE QUESTION — IMAGE REQUIRED: this question's content/options are graphical and were not extracted. Review the source PDF manually.]"


def question_text() -> Column:
    """Passage and, for image questions, a notice above the stem, with blank lines between."""
    parts = F.array(F.when(F.coalesce("passage", F.lit("")) != "", F.concat("passage", F.lit("\n"))), F.when(F.col("is_image"), F.lit(IMAGE_NOTICE + "\n")), F.col("stem"))
    return strip(F.array_join(F.array_compact(parts), "\n"))


def number_text(value: Column) -> Column:
    """Whole numbers without a fraction; null is blank."""
    return F.when(value.isNull(), "").when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def table(questions: DataFrame, images: DataFrame, schemes: DataFrame, key: list[str]) -> DataFrame:
    """key, sequence_number and HEADER's columns. images: ``review.image_columns``; schemes: key and ``scheme``.

    An unknown question type is the default, an unknown level blank; negative marks are never blank. A paper's images go with
    its questions in one row, so questions that lie by ``key`` stay where they are.
    """
    placed = images.groupBy(*key).agg(F.collect_list(F.struct("number", *(c for c in images.columns if c not in {*key, "number"}))).alias("_images"))
    q = questions.join(placed, key, "left").join(schemes, key, "left")
    q = q.withColumn("_image", F.get(F.filter("_images", lambda i: i["number"] == F.col("number")), F.lit(0)))
    has = lambda c: F.col(c) if c in questions.columns else F.lit(None).cast("string")
    kind, level = has("excel_question_type"), has("difficulty_level")
    texts = {"Section": F.col("section"), "Question Text": question_text(), "Correct Answer": F.col("correct_answer"), "Question Image URL": F.col("_image.question"), "Question Explanation": F.col("explanation")}
    texts |= {f"Option {t}{x}": F.col(c) for x in "ABCD" for t, c in (("", f"options.{x}"), ("Image URL ", f"_image.option_{x.lower()}"))}
    told = q.withColumns({f"_{h}": F.coalesce(c, F.lit("")) for h, c in texts.items()})
    # a row's texts are searched together, once; few have anything to clean
    told = told.withColumn("_unfit", F.concat(*(f"`_{h}`" for h in texts)).rlike(XML_UNFIT))
    values = {h: F.when(F.col("_unfit"), xml_clean(F.col(f"_{h}"))).otherwise(F.col(f"_{h}")) for h in texts} | {
        "Question No": F.coalesce(F.col("number").cast("string"), F.lit("")), "Question Type": F.when(kind.isin(*TYPES), kind).otherwise(TYPES[0]), "Difficulty Level": F.when(level.isin(*LEVELS), level).otherwise(""),
        "Marks": number_text(F.col("scheme.marks_per_question")), "Negative Marks": number_text(F.coalesce("scheme.negative_marks", F.lit(0.0))), "Question Explanation Image": F.lit(""),
    }
    return told.select(*key, "sequence_number", *(values[h].alias(h) for h in HEADER))


def check_header(df: DataFrame, key: list[str]) -> None:
    """Refuses a table whose columns aren't HEADER's, in order."""
    if tuple(c for c in df.columns if c not in {*key, "sequence_number"}) != HEADER:
        raise ValueError(f"header mismatch: expected {HEADER}, got {df.columns}")


def write(df: DataFrame, path: str, key: list[str], form: str = "csv") -> None:
    """One folder for each paper, rows in sequence. Several papers share a task; a paper is never cut."""
    check_header(df, key)
    ordered = df.repartition(*key).sortWithinPartitions(*key, "sequence_number")
    ordered.drop("sequence_number").write.partitionBy(*key).option("header", True).mode("overwrite").format(form).save(path)


# The parts of a workbook with one sheet.
SHEET = "questions"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE, _OFFICE = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_OFFICE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_OFFICE}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_SHEET = b"xl/worksheets/sheet1.xml"
# Of a directory's entry: its mark, method, checksum, sizes, name's length and place; of a part: its mark, its name's and extra field's length.
_LONG, _ENTRY, _PART = struct.Struct("<L"), struct.Struct("<4s6xH4xLLLH12xL"), struct.Struct("<4s22xHH")
_NUMBERS = {"Question No", "Marks", "Negative Marks"}


def _template() -> tuple[bytes, ...]:
    """An empty workbook's bytes around what a sheet changes: its checksum and sizes, twice, itself, and the directory's place."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in (_PARTS | {_SHEET.decode(): ""}).items():
            z.writestr(zipfile.ZipInfo(name), part and _HEAD + part)
        sheet, directory = z.infolist()[-1].header_offset, z.start_dir
    raw = out.getvalue()
    entry, end = raw.rindex(b"PK\x01\x02"), raw.rindex(b"PK\x05\x06")
    return raw[: sheet + 14], raw[sheet + 26 : directory], raw[directory : entry + 16], raw[entry + 28 : end + 16], raw[end + 20 :]


_TEMPLATE = _template()
_TOP = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData><row>{"".join(f'<c t="inlineStr"><is><t>{h}</t></is></c>' for h in HEADER)}</row>'.encode()
_BOTTOM = b"</sheetData></worksheet>"


def packed(rows: bytes) -> bytes:
    """A workbook of HEADER and ``rows``, the sheet's row elements. Only the sheet differs from file to file, so the rest is made once."""
    sheet = b"".join((_TOP, rows, _BOTTOM))
    stamp = struct.pack("<LLL", zlib.crc32(sheet), len(sheet), len(sheet))
    start, named, between, behind, end = _TEMPLATE
    before = b"".join((start, stamp, named, sheet))
    return b"".join((before, between, stamp, behind, struct.pack("<L", len(before)), end))


def sheet(content: bytes) -> bytes:
    """The sheet of a workbook whose parts aren't compressed, found by the file's directory and held against its checksum.

    What ``zipfile`` reads, without an object for every part: a table has many small files.
    """
    (directory,) = _LONG.unpack_from(content, content.rindex(b"PK\x05\x06") + 16)
    at = content.rfind(_SHEET, directory)
    if at < directory + 46:
        raise KeyError(_SHEET)
    mark, method, crc, size, whole, length, place = _ENTRY.unpack_from(content, at - 46)
    here, named, more = _PART.unpack_from(content, place)
    begin = place + 30 + named + more
    found = content[begin : begin + size]
    if (mark, here) != (b"PK\x01\x02", b"PK\x03\x04") or method or size != whole or length != named or content[place + 30 : place + 30 + named] != _SHEET or zlib.crc32(found) != crc:
        raise zipfile.BadZipFile("the sheet isn't as the directory says")
    return found


def workbook(rows: list[tuple]) -> bytes:
    """A workbook of HEADER and ``rows``. Texts are inline strings, never formulas; numbers are numbers; blanks have no cell."""

    def cell(name: str, value: str) -> str:
        if name in _NUMBERS and value.replace(".", "", 1).isdigit():
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>' if value else "<c/>"

    return packed("".join(f"<row>{''.join(map(cell, HEADER, r))}</row>" for r in rows).encode())


def row_elements(columns: list[pa.Array]) -> pa.Array:
    """HEADER's columns as rows of a sheet, as ``workbook`` writes them: a batch's cells at once, each value of a column once."""

    def cell(name: str, column: pa.Array) -> pa.Array:
        told = pc.fill_null(column, "").dictionary_encode()
        value = safe = told.dictionary
        if pc.any(pc.match_substring_regex(value, "[&<>]")).as_py():
            for sign, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
                safe = pc.replace_substring(safe, sign, entity)
        out = pc.binary_join_element_wise('<c t="inlineStr"><is><t xml:space="preserve">', safe, "</t></is></c>", "")
        if name in _NUMBERS:
            out = pc.if_else(pc.match_substring_regex(value, r"\A(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), pc.binary_join_element_wise("<c><v>", value, "</v></c>", ""), out)
        return pc.if_else(pc.equal(value, ""), "<c/>", out).take(told.indices)

    return pc.binary_join_element_wise("<row>", *map(cell, HEADER, columns), "</row>", "")


#: What becomes of a file: the column's name, its type and what makes it from the bytes. By default, it is the bytes.
CONTENT = ("content", BinaryType(), bytes)


def workbooks(df: DataFrame, key: list[str], name: Column, sink: tuple[str, DataType, Callable[[bytes], object]] = CONTENT) -> DataFrame:
    """key, file_name and ``sink``'s column: one workbook file for each paper, its rows in sequence. A paper's rows are few.

    A sink takes a file where it was made, so bytes that only it needs go nowhere else. Rows are brought together by paper as
    the table's columns, and none is moved that lies by ``key``; they become sheet text in the tasks that pack them, a batch at a
    time, so no text of sheets is shuffled or sorted.
    """
    check_header(df, key)
    made, kind, make = sink
    schema = StructType([*(df.schema[k] for k in key), StructField("file_name", StringType()), StructField(made, kind)])
    values = [f"`{h}`" for h in HEADER]
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("sequence_number", *values)))
    rows = rows.select(*key, name.alias("file_name"), "_at", *values)
    heads, arrow = len(key) + 1, to_arrow_type(kind)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, open_rows = None, []  # the paper whose end hasn't been seen

        def out(head: list[pa.Array], contents: Iterable[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head, pa.array(map(make, contents), arrow)], names=schema.names)

        for b in filter(len, batches):
            text = row_elements(b.columns[heads + 1 :])
            at, data = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).tolist(), memoryview(text.buffers()[2])
            firsts = np.flatnonzero(b.column(heads).to_numpy() == 1).tolist()
            open_rows.append(bytes(data[at[0] : at[firsts[0] if firsts else -1]]))
            if not firsts:
                continue
            if head is not None:
                yield out(head, [packed(b"".join(open_rows))])
            taken = pa.array(firsts[:-1], pa.int64())
            if len(taken):
                yield out([c.take(taken) for c in b.columns[:heads]], (packed(data[at[i] : at[j]]) for i, j in pairwise(firsts)))
            # copied, as a slice keeps its whole batch
            head, open_rows = [c.take(pa.array(firsts[-1:], pa.int64())) for c in b.columns[:heads]], [bytes(data[at[firsts[-1]] : at[-1]])]
        if head is not None:
            yield out(head, [packed(b"".join(open_rows))])

    return rows.mapInArrow(files, schema)


def exportable(df: DataFrame, papers: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the papers that are neither ambiguous nor blocked. papers: key, status; states: key, state."""
    good = papers.where("status <> 'AMBIGUOUS'").join(states.where("state <> 'blocked'"), key, "left_semi")
    return df.join(good.select(*key), key, "left_semi")


def file_name(stem: Column, paper: Column) -> Column:
    return F.concat(stem, F.when(paper.isNull(), "").otherwise(F.concat(F.lit("_"), F.replace(paper, F.lit(" "), F.lit("_")))), F.lit("_question_bank.xlsx"))


def image_file_name(sha256: Column, content_type: Column) -> Column:
    return F.concat(sha256, F.lit("."), F.when(content_type == "image/jpeg", "jpg").otherwise("png"))


def response_url(payload: Column | str) -> Column:
    """The URL in an upload service's JSON answer: the first that isn't blank of image_url, url and public_url, then the same under data."""
    at = [f"$.{prefix}{name}" for prefix in ("", "data.") for name in ("image_url", "url", "public_url")]
    return F.coalesce(*(F.nullif(strip(F.get_json_object(payload, p)), F.lit("")) for p in at))
