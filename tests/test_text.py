import pytest
from pyspark.sql import functions as F

from lectern.functions import latex, marks, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def test_furniture(spark):
    page = "12\n\nMOCK TEST PAPER - 2\nkeep me\nx\n7\ny\nz\nSTAFF SELECTION COMMISSION\n8 |\n|  73\nAnswers\nend\n 13 "
    assert one(spark, page, text.strip_furniture("t")) == "\nkeep me\nx\n7\ny\nz\nend"
    assert one(spark, None, text.strip_furniture("t")) is None
    assert one(spark, "", text.strip_furniture("t")) == ""


def test_score(spark):
    assert one(spark, "", text.quality_score("t")) == 0.0
    assert one(spark, None, text.quality_score("t")) == 0.0
    assert one(spark, " \n ", text.quality_score("t")) == 0.0
    good = "1. What is it?\n1. A\n" + "words of a page " * 40
    assert one(spark, good, text.quality_score("t")) > 0.9
    assert one(spark, "\u0000\u0001" * 50, text.quality_score("t")) < 0.1


def test_clean_up(spark):
    assert one(spark, "a \t b\r\nc\r\n\r\n\n\nd  \n", text.normalise_ocr("t")) == "a b\nc\n\nd"
    assert one(spark, "  a \n b\tc ", text.option_text("t")) == "a b c"
    assert one(spark, " a  b\n\n\n  c \n", text.stem_text("t")) == "a b\nc"
    assert one(spark, "a\x00b\x7fc\td", text.xml_clean("t")) == "abc\td"


@pytest.mark.parametrize("line,header", [("General Awareness", True), ("What is it?", False), ("to take some rest", False), ("Part 2 Maths", False), ("Word", False), ("", False), ("Quantitative Aptitude and Reasoning", True)])
def test_section_header(spark, line, header):
    assert one(spark, line, text.is_section_header(F.col("t"))) is header


@pytest.mark.parametrize("page,number", [("\n\nSample Question Paper - 3\nx", 3), ("Mock Test 12", 12), ("see Mock Test 12", None), ("Mock Test 12.", None), ("a\nb\nc\nd\ne\nTest Paper 4", None), ("Test Paper 4 of a very long line that goes on and on", None)])
def test_paper_number(spark, page, number):
    assert one(spark, page, text.paper_number("t")) == number


def test_style(spark):
    assert one(spark, "(a) x\t(b) y\n(c) z\n(d) w\n" * 2, text.option_style("t")) == "letter"
    assert one(spark, "(a) x\t(b) y\n(c) z\n(d) w\n", text.option_style("t")) == "digit"


def test_marks(spark):
    s = one(spark, "Max marks- 200\nTotal Questions: 100. Each carries of three marks. One mark is deducted for", marks.scheme("t"))
    assert (s.total_questions, s.maximum_marks, s.marks_per_question, s.negative_marks) == (100, 200.0, None, 1.0)
    assert s.source.marks_per_question == "ambiguous"
    s = one(spark, "Max marks- 200 Maximum Marks: 100", marks.scheme("t"))
    assert s.maximum_marks is None and s.source.maximum_marks == "ambiguous"
    s = one(spark, None, marks.scheme("t"))
    assert s.source.negative_marks == "not_specified"
    s = one(spark, "twelve marks are deducted; eleven marks will be deducted", marks.scheme("t"))
    assert s.negative_marks is None


LATEX = [
    ("This is a normal sentence.", None), ("The value of x is 5.", None), ("Choose either option A/B before submitting.", None), ("12/25/2024", None), ("Question 22", None),
    ("x²", "$x^2$"), ("x¹²", "$x^{12}$"), ("a₁", "$a_1$"), ("√16", r"$\sqrt{16}$"), ("√(a² + b²)", r"$\sqrt{a^2 + b^2}$"), ("16/2", r"$\frac{16}{2}$"), ("a/b", r"$\frac{a}{b}$"),
    ("If x² + y² = 25 and x = 3, find y.", "If $x^2 + y^2 = 25$ and $x = 3$, find y."), ("x ≤ 5", r"$x \le 5$"), ("6 × 7", r"$6 \times 7$"), ("πr²h", r"$\pi r^2h$"), ("(3.5)²", "$(3.5)^2$"), ("$x^2$", None), ("", None),
]


def test_latex(spark):
    rows = [*LATEX, (None, None), ("so ≠ 35/2 x", "so ≠ 35/2 x".replace("≠", "$\\neq$")), ("a $q² = 3$ and y³", "a $q² = 3$ and $y^3$"), ("Capacity = 308 × 1000 = 308,000 litres", r"Capacity = $308 \times 1000 = 308,000$ litres"), ("√( x² ) + 1 +", r"$\sqrt{x^2} + 1$ +"), ("n² \n+ 5", "$n^2$ \n+ 5")]
    t = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r for r in t.select("i", latex.latex("t").alias("a"), latex.latex(latex.latex("t")).alias("b")).collect()}
    for i, (raw, want) in enumerate(rows):
        assert got[i].a == (raw if want is None else want) and got[i].b == got[i].a, (raw, got[i])
