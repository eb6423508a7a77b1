"""Column functions over page and question text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that are page furniture, matched on the trimmed line, and the bare page number at a page's edge.
FURNITURE = (
    r"(?i)^MOCK TEST PAPER",
    r"(?i)^Oswaal ",
    r"(?i)^STAFF SELECTION COMMISSION$",
    r"(?i)^STENOGRAPHER GRADE.*EXAMINATION$",
    r"(?i)^Time Allotted[- ]",
    r"(?i)^Max marks[- ]",
    r"(?i)^Answers with Explanations$",
    r"^[0-9]{1,3}\s*\|[\x00-\x1f\s]*$",
    r"^\|\s*[0-9]{1,3}$",
    r"(?i)^Answers[\x00-\x1f\s]*$",
)
PAGE_NUMBER = r"^[0-9]{1,3}$"
EDGE_LINES = 3
# The least score of a usable native text, and the weights and saturation points of the score.
NATIVE_LEAST = 0.55
WEIGHTS = {"printable": 0.20, "alnum": 0.20, "words": 0.25, "length": 0.15, "question": 0.10, "option": 0.10}
FULL_WORDS, FULL_LENGTH = 60.0, 400.0

BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column | str) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def strip_furniture(text: Column | str) -> Column:
    """Drops furniture lines anywhere and bare page numbers among a page's first and last non-blank lines. Null stays null."""
    every = lines(text)
    filled = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: strip(F.get(every, i)) != "")
    edge = F.concat(F.slice(filled, 1, EDGE_LINES), F.slice(filled, F.greatest(F.size(filled) - (EDGE_LINES - 1), F.lit(1)), F.lit(EDGE_LINES)))

    def stays(line: Column, i: Column) -> Column:
        bare = strip(line)
        furniture = F.lit(False)
        for pattern in FURNITURE:
            furniture = furniture | bare.rlike(pattern)
        return (bare == "") | ~(furniture | (bare.rlike(PAGE_NUMBER) & F.array_contains(edge, i)))

    return F.array_join(F.filter(every, stays), "\n")


def quality_score(text: Column | str) -> Column:
    """0 to 1, rounded to three decimals: how much a text looks like a usable page. Blank and null score 0."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    share = {
        "printable": (F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]")) + F.regexp_count(text, F.lit("[ \\n\\t]"))) / n,
        "alnum": F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) / n,
        "words": F.least(F.regexp_count(text, F.lit("[A-Za-z]{2,}")) / FULL_WORDS, F.lit(1.0)),
        "length": F.least(n / FULL_LENGTH, F.lit(1.0)),
        "question": text.rlike(r"(?md)^\s*[0-9]{1,3}\.\s").cast("double"),
        "option": text.rlike(r"(?md)^\s*[1-4]\.\s*\S").cast("double"),
    }
    total = sum((F.lit(w) * share[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(text.isNull() | (strip(text) == ""), F.lit(0.0)).otherwise(F.round(total, 3))


def normalise_ocr(text: Column | str) -> Column:
    """Line ends to LF, runs of blanks to one, three or more LF to two, no blanks at line ends, no LF at the ends."""
    t = F.regexp_replace(text, "\r\n|\r", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \x0b\x0c]+(?=\n|\z)", "")
    return F.btrim(t, F.lit("\n"))


def option_text(text: Column | str) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def stem_text(text: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{2,}", "\n")
    return strip(F.array_join(F.transform(lines(t), strip), "\n"))


def explanation_text(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), "[ \t]+", " "), "\n{3,}", "\n\n")


def is_section_header(line: Column) -> Column:
    """A short line of two to eight words, mostly capitalised, without digits or closing punctuation."""
    s = strip(line)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (s != "") & (F.length(s) <= 60) & ~s.rlike(r"[?.:,;]\z") & ~s.rlike(r"\p{Nd}") & F.size(words).between(2, 8) & (capital >= F.greatest(F.lit(1), F.size(words) - 2))


def is_short_option(content: Column) -> Column:
    s = strip(content)
    return (s != "") & (F.length(s) <= 25) & ~s.contains("?") & ~s.contains("\n\n")


# A paper's header line, its greatest length, and the lines of a page where it may stand.
PAPER_HEADER = r"(?i)^(?:Sample\s+)?(?:Question\s+Paper|Mock\s+Test|Test\s+Paper)\s*[-–—]?\s*([0-9]{1,3})\b"
HEADER_LENGTH, HEADER_LINES = 40, 5


def paper_number(text: Column | str) -> Column:
    """The number in the paper header among a page's first non-blank lines, else null."""
    top = F.slice(F.filter(F.transform(lines(text), strip), lambda s: s != ""), 1, HEADER_LINES)
    hit = F.filter(top, lambda s: (F.length(s) <= HEADER_LENGTH) & ~s.rlike(r"[.?!,:;]\z") & s.rlike(PAPER_HEADER))
    return F.when(F.size(hit) > 0, F.regexp_extract(F.get(hit, F.lit(0)), PAPER_HEADER, 1).cast("int"))


# An option marker in letters, and how many make a paper letter-optioned.
LETTER_MARKER = r"(?md)(?:^|(?<=\t))[ \t]*\(([a-eA-E])\)[ \t]*"
LETTER_LEAST = 8


def option_style(text: Column | str) -> Column:
    return F.when(F.regexp_count(text, F.lit(LETTER_MARKER)) >= LETTER_LEAST, "letter").otherwise("digit")


# Each character by itself: Java looks those up in one table, while it tries ranges one after the other.
XML_UNFIT = f"[{''.join(f'\\x{c:02x}' for c in (*range(9), 11, 12, *range(14, 32), 127))}]"


def xml_clean(text: Column | str) -> Column:
    return F.regexp_replace(text, XML_UNFIT, "")


def optional_number(text: Column | str) -> Column:
    """A typed number; blank and invalid give null."""
    return strip(text).try_cast("double")


def content_type(name: Column | str) -> Column:
    """By the file name's extension; png where it tells nothing."""
    name = F.col(name) if isinstance(name, str) else name
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").otherwise("image/png")
