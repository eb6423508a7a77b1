"""Queries on page text: routing, scores, offsets, clean-up, papers and marking schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pages as ops
from ..sources.pages import flat_spans


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose pages are the turns."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = ops.route(read(spark, sf_dir, "documents").select("lang", "text"))
    return routed.groupBy("lang").agg(F.count("*").alias("pages"), F.count_if(F.col("method") == "native").alias("native_pages"), F.count_if(F.col("method") == "ocr").alias("ocr_pages"), F.round(F.avg("quality_score"), 6).alias("avg_score"), F.sum("native_chars").alias("chars"))


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: pages by method, and method, confidence and score of each page as text; every third turn
    has nothing of its own and was recognised, with words of known confidence."""
    t = talk_pages(spark, sf_dir)
    n, blank = F.col("page_number"), F.col("page_number") % 3 == 0
    words = F.array(F.lit(90.0), F.lit(-1.0), (n * 10 % 100).cast("double"))
    pages = t.select("doc_id", "page_number", F.when(~blank, F.col("text")).alias("text"), F.col("text").alias("ocr_text"), ops.word_confidence(words).alias("ocr_word_conf"))
    s = ops.summary(ops.route(pages))
    ocr = F.filter("per_page", lambda p: (p["method"] == "ocr") & (p["page_number"] % 3 == 0))
    return s.select("doc_id", "total_pages", F.size("per_page").cast("long").alias("listed"), (F.col("native_pages") + F.col("ocr_pages")).alias("routed"), F.array_join(F.transform(ocr, lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), F.round(p["confidence"] * 100).cast("int").cast("string"))), ",").alias("recognised"))


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of nested pages as rows: each conversation a page of a block for each turn, with a line of two spans and one of none."""
    t = talk_pages(spark, sf_dir)
    span = lambda text, x: F.struct(text.alias("text"), F.array(x, F.col("page_number"), x + 5, F.col("page_number") + 9).cast("array<double>").alias("bbox"), F.lit(9.0).alias("size"), F.lit("Body").alias("font"))
    lines = F.array(F.struct(F.array(span(F.col("page_number").cast("string"), F.lit(1)), span(F.length("text").cast("string"), F.lit(8))).alias("spans")), F.struct(F.array().cast("array<struct<text:string,bbox:array<double>,size:double,font:string>>").alias("spans")))
    nested = t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", lines.alias("lines")))), lambda b: F.struct(b["lines"].alias("lines"))).alias("blocks")).withColumn("page_number", F.lit(1))
    return flat_spans(nested).select("doc_id", "block_no", "line_no", "span_no", "text", "x0", "y0", "x1", "y1")


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = ops.route(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return routed.select("doc_id", F.round(F.when(F.col("method") == "native", F.col("quality_score")).otherwise(0.0), 3).alias("score"), "method", F.round("confidence", 4).alias("confidence"), F.md5(F.when(F.col("method") == "native", F.col("text")).otherwise("")).alias("text_md5"))


_SCORED = r"""
with l as (select doc_id, lang, string_split(text, chr(10)) ls, length(text) chars from documents),
f as (select *, list_filter(generate_series(1, len(ls)), lambda i: regexp_replace(ls[i], '^\s+|\s+$', '', 'g') <> '') filled from l),
s as (
  select doc_id, lang, chars, array_to_string(list_filter(ls, lambda x, i: regexp_replace(x, '^\s+|\s+$', '', 'g') = '' or not (
    regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '(?i)^(MOCK TEST PAPER|Oswaal |STAFF SELECTION COMMISSION$|STENOGRAPHER GRADE.*EXAMINATION$|Time Allotted[- ]|Max marks[- ]|Answers with Explanations$|[0-9]{1,3}\s*\|\s*$|\|\s*[0-9]{1,3}$|Answers\s*$)')
    or (list_contains(list_concat(filled[1:3], filled[-3:]), i) and regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[0-9]{1,3}$')))), chr(10)) t from f),
c as (
  select *, length(t) n,
    length(regexp_replace(t, '[\p{C}\p{Z}]', '', 'g')) + length(regexp_replace(t, '[^ \n\t]', '', 'g')) printable,
    length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) alnum, len(regexp_extract_all(t, '[A-Za-z]{2,}')) words,
    regexp_matches(t, '(?m)^\s*[0-9]{1,3}\.\s')::int q, regexp_matches(t, '(?m)^\s*[1-4]\.\s*\S')::int o from s),
r as (
  select *, case when regexp_replace(t, '\s', '', 'g') = '' then 0 else round(0.2 * (printable / n) + 0.2 * (alnum / n) + 0.25 * least(words / 60.0::double, 1) + 0.15 * least(n / 400.0::double, 1) + 0.1::double * q + 0.1::double * o, 3) end score from c)
"""


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by document with their word confidence where recognition had to step in: here the turns of conversations."""
    return ops.page_counts(ops.route(talk_pages(spark, sf_dir)), ["doc_id"])


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_offsets(talk_pages(spark, sf_dir))


def page_of_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup: the page on which the middle character of each document's unified text lies."""
    whole = ops.unified(talk_pages(spark, sf_dir).withColumn("method", F.lit("native")).withColumn("confidence", F.lit(1.0)), ["doc_id"])
    middle = F.floor(F.length("full_text") / 2)
    return whole.select("doc_id", F.length("full_text").alias("n_chars"), ops.page_at("offsets", middle)["page_number"].alias("page_number"), F.md5("full_text").alias("text_md5"))


def page_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_range(talk_pages(spark, sf_dir), 2, 4).select("doc_id", F.md5("text").alias("text_md5"))


def ocr_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.normalise_ocr("html")).alias("text_md5"))


def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as pages; every fourth order begins a paper, out of order for some customers."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    page = o.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")))
    starts = F.sum((F.col("o_orderkey") % 4 == 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("page_number"))
    number = F.when(F.col("doc_id") % 5 == 0, 2 * starts).otherwise(starts)
    body = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of the day.\nMock Test 9 is mentioned here, in a sentence."))
    return page.select("doc_id", "page_number", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Mock Test - "), number, F.lit("\n"), body)).otherwise(body).alias("text"))


def paper_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.papers(header_pages(spark, sf_dir)).select("doc_id", "paper_id", "paper_name", "start_page", "end_page", "status", "reason")


def pages_in_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = header_pages(spark, sf_dir)
    return ops.paper_pages(p, ops.papers(p)).groupBy("doc_id", "paper_id").agg(F.count("*").alias("pages"), F.min("page_number").alias("first_page"))


def stated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one-page papers that state their marks, in words or digits, some twice and differently."""
    k = F.col("o_orderkey")
    most = F.when(k % 3 == 0, F.concat(F.lit("Maximum Marks: "), (k % 7 + 1) * 10, F.lit("\n"))).otherwise(F.concat(F.lit("Max marks- "), (k % 7 + 1) * 10, F.lit("\n")))
    again = F.when(k % 11 == 0, "Maximum Marks: 999\n").otherwise("")
    total = F.when(k % 5 == 0, "").otherwise("Total Questions: 10.\n")
    each = F.when(k % 4 == 0, "Each question carries of three marks.\n").otherwise("")
    negative = F.when(k % 2 == 0, "Negative Marking: -0.25\n").otherwise("One mark is deducted for every wrong answer.\n")
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_number"), F.concat(most, again, total, each, negative).alias("text"))


def marking_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stated_pages(spark, sf_dir)
    s = ops.marking_schemes(p, ops.papers(p))
    return s.select("doc_id", "scheme.total_questions", "scheme.maximum_marks", F.round("scheme.marks_per_question", 6).alias("marks_per_question"), "scheme.negative_marks", F.col("scheme.source.maximum_marks").alias("max_source"), F.col("scheme.source.total_questions").alias("total_source"), F.col("scheme.source.marks_per_question").alias("per_source"), F.col("scheme.source.negative_marks").alias("negative_source"))


QUERIES = {f.__name__: f for f in (page_routing, document_summaries, span_rows, document_scores, page_counts, page_offsets, page_of_middle, page_range_text, ocr_clean_up, paper_spans, pages_in_papers, marking_schemes)}

_TALK = "with p as (select conv_id doc_id, (turn + 1)::int page_number, text from conversations)"
_SPANS = """
with o as (select o_custkey doc_id, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) page from orders),
h as (select *, sum((k % 4 = 0)::int) over (partition by doc_id order by page) s from o),
f as (select doc_id, case when doc_id % 5 = 0 then 2 * s else s end paper_id, min(page) start_page from h where k % 4 = 0 group by all),
t as (select doc_id, count(*) total from o group by 1),
w as (select *, lead(start_page) over (partition by doc_id order by start_page) nxt, paper_id - row_number() over (partition by doc_id order by start_page) off from f),
c as (select *, min(off) over (partition by doc_id) = max(off) over (partition by doc_id) clean, array_to_string(list(paper_id) over (partition by doc_id order by start_page rows between unbounded preceding and unbounded following), ', ') seen from w),
spans as (select t.doc_id, coalesce(paper_id, 1)::int paper_id, case when paper_id is not null then 'Paper ' || paper_id end paper_name, coalesce(start_page, 1)::int start_page,
  greatest(coalesce(nxt - 1, total), coalesce(start_page, 1))::int end_page, case when clean = false then 'AMBIGUOUS' else 'OK' end status, case when clean = false then 'paper header numbers appeared out of order or with gaps (saw [' || seen || '] in page order) — boundaries between them cannot be confidently determined' end reason from t left join c using (doc_id))
"""
ORACLES = {
    "document_summaries": _TALK + " select doc_id, count(*) total_pages, count(*) listed, count(*) routed, coalesce(string_agg(page_number || ':' || (45 + 5 * (page_number % 10)), ',' order by page_number) filter (page_number % 3 = 0), '') recognised from p group by 1",
    "span_rows": _TALK + """, b as (select *, (row_number() over (partition by doc_id order by page_number) - 1)::int block_no from p)
select doc_id, block_no, 0 line_no, s span_no, case s when 0 then page_number::varchar else length(text)::varchar end as text, (1 + 7 * s)::double x0, page_number::double y0, (6 + 7 * s)::double x1, (page_number + 9)::double y1 from b, (select unnest([0, 1]) s)""",
    "page_routing": _SCORED + "select lang, count(*) pages, count(*) filter (score >= 0.55) native_pages, count(*) filter (score < 0.55) ocr_pages, round(avg(case when score >= 0.55 then score else 0 end), 6) avg_score, sum(chars)::bigint chars from r group by lang",
    "document_scores": _SCORED + "select doc_id, case when score >= 0.55 then score else 0 end score, case when score >= 0.55 then 'native' else 'ocr' end as \"method\", case when score >= 0.55 then round(least(1, 0.6::double + 0.4::double * score), 4) else 0 end confidence, md5(case when score >= 0.55 then t else '' end) text_md5 from r",
    "page_counts": _SCORED.replace("from documents", "from (select conv_id doc_id, '' lang, text from conversations)") + "select doc_id, count(*) total_pages, count(*) filter (score >= 0.55) native_pages, count(*) filter (score < 0.55) ocr_pages from r group by doc_id",
    "page_offsets": _TALK + " select doc_id, page_number, coalesce(sum(length(text) + 1) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0)::bigint \"start\" from p",
    "page_of_middle": _TALK + """, o as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0) s from p),
u as (select doc_id, string_agg(text || chr(10), '' order by page_number) t from p group by 1)
select u.doc_id, length(t)::int n_chars, max(page_number) filter (s <= length(t) // 2) page_number, md5(t) text_md5 from u join o using (doc_id) group by u.doc_id, t""",
    "page_range_text": _TALK + " select doc_id, md5(string_agg(text, chr(10) order by page_number)) text_md5 from p where page_number between 2 and 4 group by doc_id",
    "ocr_clean_up": r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \x0b\x0c]+\n', chr(10), 'g'), '[ \x0b\x0c]+$', ''), chr(10))) text_md5 from pages",
    "paper_spans": _SPANS + "select * from spans",
    "pages_in_papers": _SPANS + "select o.doc_id, paper_id, count(*) pages, min(page)::int first_page from o join spans on o.doc_id = spans.doc_id and page between start_page and end_page group by all",
    "marking_schemes": """
with o as (select o_orderkey k, (o_orderkey % 7 + 1) * 10.0 m, case when o_orderkey % 5 <> 0 then 10 end t, case when o_orderkey % 4 = 0 then 3.0 end e from orders),
x as (select *, case when k % 11 = 0 then null else m end mm, case when k % 11 <> 0 and t is not null then m / t end d from o)
select k doc_id, t::int total_questions, mm::double maximum_marks, case when e is not null and d is not null and e <> d then null else round(coalesce(e, d)::double, 6) end marks_per_question,
  (case when k % 2 = 0 then 0.25 else 1 end)::double negative_marks, case when k % 11 = 0 then 'ambiguous' else 'pdf' end max_source, case when t is null then 'not_specified' else 'pdf' end total_source,
  case when e is not null and d is not null and e <> d then 'ambiguous' when e is not null then 'pdf' when d is not null then 'derived' else 'not_specified' end per_source, 'pdf' negative_source from x""",
}
