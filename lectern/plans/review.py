"""Queries on review state, difficulty lists, images and the export table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import marks
from ..functions.text import content_type, optional_number
from ..operators import review as ops
from ..operators import validation
from ..sources import export
from .pages import read
from .papers import questions as item_questions

KEY = ["doc_id"]


def order_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as papers and their orders as questions; a customer's fifth order repeats the number 4."""
    o = read(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    q = o.select(F.col("o_custkey").alias("doc_id"), n.alias("sequence_number"), F.col("o_orderpriority").alias("stem"), F.col("o_orderstatus").alias("section"), F.when(F.col("o_orderkey") % 3 == 0, "HIGH").when(F.col("o_orderkey") % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"), (F.col("o_orderkey") % 4 == 0).alias("is_image"))
    return q.withColumn("number", F.when(F.col("sequence_number") == 5, 4).otherwise(F.col("sequence_number")))


def event_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log: errors reset one question, every fiftieth event resets its paper, the rest set a stem or a section."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    op = F.when(k % 50 == 0, "reset_all").when(F.col("event_type") == "error", "reset").otherwise("set")
    patch = F.struct(F.when(F.col("event_type") != "view", F.concat(F.lit("edit "), k)).alias("stem"), F.when(F.col("event_type") == "view", F.concat(F.lit("S"), k % 9)).alias("section"))
    return e.select(F.col("user_id").alias("doc_id"), (k % 7 + 1).cast("int").alias("number"), k.alias("edit_seq"), op.alias("op"), patch.alias("patch"))


def effective_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ops.effective(order_questions(spark, sf_dir), event_edits(spark, sf_dir), KEY)
    return q.select("doc_id", "sequence_number", "number", "stem", "section", "modified", F.array_join(ops.badges(), " | ").alias("badges"))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(ops.effective(order_questions(spark, sf_dir), event_edits(spark, sf_dir), KEY), KEY)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.map_from_arrays(F.array(*map(F.lit, ops.LEVELS)), F.array(F.concat(F.lit("1-"), k % 4 + 1, F.lit(", 3")), F.when(k % 5 == 0, "9-6").otherwise(F.concat(F.lit("4 , "), k % 6 + 4)), F.when(k % 3 == 0, "x, 7-").otherwise("8-10")))
    return read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode(text).alias("level", "text"))


def _difficulty(spark: SparkSession, sf_dir: str):
    return ops.difficulty(_lists(spark, sf_dir), order_questions(spark, sf_dir).where("doc_id is not null"), KEY)


def difficulty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.difficulty_summary(_difficulty(spark, sf_dir)[0], KEY)
    return s.select("doc_id", *ops.LEVELS, *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("conflicts", "unassigned")))


def difficulty_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists have wrong, in order, of papers that have questions."""
    papers = order_questions(spark, sf_dir).select("doc_id").distinct()
    return _difficulty(spark, sf_dir)[1].join(papers, "doc_id", "left_semi").select("doc_id", F.array_join("errors", "\n").alias("errors"))


def difficulty_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with the level that the lists settle, blank where none or more than one claims them."""
    q = order_questions(spark, sf_dir).where("doc_id is not null")
    return ops.with_difficulty(q, ops.difficulty(_lists(spark, sf_dir), q, KEY)[0], KEY).select("doc_id", "sequence_number", "number", "difficulty_level")


def passage_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' questions after their passages were set by events, each for two numbers of its paper."""
    k = F.col("event_id")
    both = F.array((k % 7 + 1).cast("int"), (k % 7 + 2).cast("int"))
    edits = read(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("doc_id"), *ops.passage_edits(both, F.concat(F.lit("passage "), k), k))
    q = ops.effective(order_questions(spark, sf_dir).withColumn("passage", F.lit("")), edits, KEY)
    return q.select("doc_id", "sequence_number", "number", "passage", "modified")


def confirmed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at each destination once events are accepted as candidates: some with an ambiguous destination or without a URL."""
    k = F.col("event_id")
    places = F.array(*map(F.lit, (*ops.DESTINATIONS, "ambiguous")))
    c = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (k % 6 + 1).cast("int").alias("number"), F.get(places, (k % 7 % 6).cast("int")).alias("destination"), F.when(k % 3 != 0, F.concat(F.lit("http://c/"), k)).alias("image_url"), k.alias("candidate_no"))
    return ops.latest_images(ops.confirmed(c, 1000), KEY).select("doc_id", "number", "destination", "status", "image_url", "image_seq")


def page_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of each paper's third page, four to a page."""
    q = order_questions(spark, sf_dir).withColumn("source_page", F.ceil(F.col("sequence_number") / 4).cast("int"))
    return ops.on_page(q, 3).select("doc_id", "sequence_number", "number")


def event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(k % 17 == 0, "cleared").otherwise("uploaded")
    return e.select(F.col("user_id").alias("doc_id"), (k % 6 + 1).cast("int").alias("number"), F.get(F.array(*map(F.lit, ops.DESTINATIONS)), (k % 5).cast("int")).alias("destination"), k.alias("image_seq"), status.alias("status"), F.when(k % 13 != 0, F.concat(F.lit("http://i/"), k)).alias("image_url"))


def image_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.image_columns(ops.latest_images(event_images(spark, sf_dir), KEY), KEY)


def unconfirmed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unconfirmed(order_questions(spark, sf_dir), ops.latest_images(event_images(spark, sf_dir), KEY), KEY).select("doc_id", "sequence_number", "number")


def upload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return ops.deduplicated_uploads(d).select("artifact_id", "upload_id", "reused", export.image_file_name(F.col("sha256"), content_type(F.concat(F.lit("a."), F.when(F.col("artifact_id") % 2 == 0, "JPG").otherwise("gif")))).alias("file"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nineteen columns of every question of each order's paper, with images by number and a derived scheme."""
    q = item_questions(spark, sf_dir).withColumn("number", F.col("sequence_number"))
    q = q.withColumn("difficulty_level", F.get(F.array(F.lit("easy"), F.lit("hardest"), F.lit("hard")), (F.col("sequence_number") % 3)))
    schemes = q.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", marks.build_scheme(F.col("n"), F.when(F.col("doc_id") % 2 == 0, F.lit(12)), F.when(F.col("doc_id") % 3 == 0, F.lit(0.25))).alias("scheme"))
    t = export.table(q, ops.image_columns(ops.latest_images(event_images(spark, sf_dir), KEY), KEY), schemes, KEY)
    export.check_header(t, KEY)
    return t.select("doc_id", "sequence_number", *(F.col(f"`{h}`").alias(h.lower().replace(" ", "_")) for h in export.HEADER))


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbooks of every order's paper: their names, and the rows that are found in the files again."""
    q = item_questions(spark, sf_dir)
    schemes = q.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", marks.build_scheme(F.col("n"), F.lit(12), F.lit(None).cast("double")).alias("scheme"))
    t = export.table(q, ops.image_columns(ops.latest_images(event_images(spark, sf_dir), KEY), KEY), schemes, KEY)
    name = export.file_name(F.concat(F.lit("exam"), F.col("doc_id")), F.when(F.col("doc_id") % 20 == 0, F.lit("Paper 1")))
    return export.workbooks(t, KEY, name, ("n_rows", IntegerType(), lambda content: export.sheet(content).count(b"<row>") - 1))


def exported_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export gate of every order's paper: blocked, warned of or clean, and whether it goes out."""
    q = validation.annotated(item_questions(spark, sf_dir))
    schemes = q.select("doc_id").distinct().select("doc_id", marks.build_scheme(F.lit(10), F.lit(20), F.lit(None).cast("double")).alias("scheme"))
    g = validation.gate(validation.report(q, KEY), validation.blocking_errors(q, schemes, KEY), KEY)
    papers = g.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "AMBIGUOUS").otherwise("OK").alias("status"))
    out = export.exportable(g, papers, g, KEY).select("doc_id", F.lit(True).alias("out"))
    return g.join(out, "doc_id", "left").select("doc_id", "state", F.coalesce("out", F.lit(False)).alias("exported"), F.size("warnings").alias("warnings"))


def upload_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    payload = F.when(k % 4 == 0, F.concat(F.lit('{"image_url":" ","url":"u'), k, F.lit('"}'))).when(k % 4 == 1, F.concat(F.lit('{"data":{"public_url":" d'), k, F.lit(' "}}'))).when(k % 4 == 2, F.lit("oops")).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", export.response_url(payload).alias("url"))


def typed_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected marks under typed ones: customers' balances as what a reviewer typed."""
    k = F.col("c_custkey")
    detected = F.struct(F.lit(100.0).alias("maximum_marks"), F.lit(2.0).alias("marks_per_question"), F.lit(None).cast("double").alias("negative_marks"))
    typed = {"maximum_marks": F.when(k % 3 == 0, F.lit(" 120 ")), "marks_per_question": F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("2")), "negative_marks": F.when(k % 5 == 0, F.lit("0.5")).when(k % 5 == 1, F.lit("abc"))}
    s = read(spark, sf_dir, "customer").select(k, detected.alias("d"), marks.current_scheme(detected, typed).alias("s"), optional_number(F.substring("c_name", -3, 3)).alias("tail"))
    return s.select("c_custkey", "s.maximum_marks", "s.marks_per_question", "s.negative_marks", F.col("s.source.maximum_marks").alias("max_source"), F.col("s.source.marks_per_question").alias("per_source"), F.col("s.source.negative_marks").alias("negative_source"), marks.caption(F.col("s.maximum_marks"), F.col("d.maximum_marks"), F.lit("pdf")).alias("caption"), "tail")


QUERIES = {f.__name__: f for f in (effective_questions, review_counts, difficulty_summary, difficulty_errors, difficulty_applied, passage_edited, confirmed_images, page_questions, image_columns, unconfirmed_images, upload_dedup, export_rows, workbook_files, exported_papers, upload_answers, typed_schemes)}

_O = """
with o as (select o_custkey doc_id, (row_number() over (partition by o_custkey order by o_orderkey))::int sequence_number, o_orderpriority stem, o_orderstatus section, o_orderkey % 3 <> 0 flagged, o_orderkey % 4 = 0 is_image from orders),
q as (select *, case when sequence_number = 5 then 4 else sequence_number end number from o)
"""
_E = """,
e as (select user_id doc_id, (event_id % 7 + 1)::int number, event_id s, case when event_id % 50 = 0 then 'reset_all' when event_type = 'error' then 'reset' else 'set' end op,
  case when event_type <> 'view' then 'edit ' || event_id end stem, case when event_type = 'view' then 'S' || (event_id % 9) end section from events),
a as (select doc_id, max(s) s from e where op = 'reset_all' group by 1), r as (select doc_id, number, max(s) s from e where op = 'reset' group by all),
l as (select e.* from e left join a on e.doc_id = a.doc_id left join r on e.doc_id = r.doc_id and e.number = r.number where op = 'set' and e.s > coalesce(a.s, -1) and e.s > coalesce(r.s, -1)),
p as (select doc_id, number, arg_max(stem, s) filter (stem is not null) stem, arg_max(section, s) filter (section is not null) section from l group by all),
z as (select q.doc_id, q.sequence_number, q.number, coalesce(p.stem, b.stem) stem, coalesce(p.section, b.section) section, p.doc_id is not null modified, b.flagged from q
  join (select * from q qualify row_number() over (partition by doc_id, number order by sequence_number desc) = 1) b on q.doc_id = b.doc_id and q.number = b.number left join p on q.doc_id = p.doc_id and q.number = p.number)
"""
_D = _O + """,
n as (select distinct doc_id, number from q),
t as (select c_custkey k, 1 rk, 'easy' level, 1 lo, c_custkey % 4 + 1 hi, 0 tok from customer union all select c_custkey, 1, 'easy', 3, 3, 1 from customer
  union all select c_custkey, 2, 'medium', 4, 4, 0 from customer where c_custkey % 5 <> 0 union all select c_custkey, 2, 'medium', c_custkey % 6 + 4, c_custkey % 6 + 4, 1 from customer where c_custkey % 5 <> 0
  union all select c_custkey, 3, 'hard', 8, 10, 0 from customer where c_custkey % 3 <> 0),
x as (select k doc_id, rk, level, tok, unnest(generate_series(lo, hi))::int num from t),
y as (select *, row_number() over (partition by doc_id, level, num order by tok) again from x),
c as (select distinct y.doc_id, rk, level, num from y join n on y.doc_id = n.doc_id and y.num = n.number),
m as (select doc_id, num, count(*) times, min(level) level, string_agg(upper(level[1]) || level[2:], ' and ' order by rk) names from c group by all)
"""
_I = """
with e as (select user_id doc_id, (event_id % 6 + 1)::int number, ['question','option_a','option_b','option_c','option_d'][event_id % 5 + 1] destination, event_id s,
  case when event_type = 'error' then 'failed' when event_id % 17 = 0 then 'cleared' else 'uploaded' end status, case when event_id % 13 <> 0 then 'http://i/' || event_id end url from events),
l as (select * from e qualify row_number() over (partition by doc_id, number, destination order by s desc) = 1),
ic as (select doc_id, number, max(url) filter (destination = 'question') question, max(url) filter (destination = 'option_a') option_a, max(url) filter (destination = 'option_b') option_b, max(url) filter (destination = 'option_c') option_c, max(url) filter (destination = 'option_d') option_d
  from l where status = 'uploaded' and url is not null group by all)
"""
ORACLES = {
    "effective_questions": _O + _E + "select doc_id, sequence_number, number, stem, section, modified, case when modified and flagged then '✓ Manually Confirmed | ✎ Modified' when modified then '✎ Modified' when flagged then '⚠ Needs Review' else '✓ Extracted' end badges from z",
    "review_counts": _O + _E + "select doc_id, count(*) filter (flagged) needs_review, count(*) filter (flagged and modified) resolved, count(*) filter (flagged and not modified) remaining from z group by 1",
    "difficulty_summary": _D + """select n.doc_id, count(*) filter (times = 1 and level = 'easy') easy, count(*) filter (times = 1 and level = 'medium') medium, count(*) filter (times = 1 and level = 'hard') hard,
  coalesce(string_agg(number::varchar, ',' order by number) filter (times > 1), '') conflicts, coalesce(string_agg(number::varchar, ',' order by number) filter (times is null), '') unassigned from n left join m on n.doc_id = m.doc_id and n.number = m.num group by 1""",
    "difficulty_errors": _D + """, er as (
  select y.doc_id, rk a, tok b, num c, 'Difficulty (' || upper(level[1]) || level[2:] || '): ' || case when again > 1 then 'duplicate question number ' || num || ' within this field' else 'question number ' || num || ' does not exist in this paper' end msg
    from y left join n on y.doc_id = n.doc_id and y.num = n.number where again > 1 or n.number is null
  union all select c_custkey, 2, 0, 0, 'Difficulty (Medium): malformed range ''9-6'' (start is greater than end)' from customer where c_custkey % 5 = 0
  union all select c_custkey, 3, 0, 0, 'Difficulty (Hard): invalid entry ''x''' from customer where c_custkey % 3 = 0 union all select c_custkey, 3, 1, 0, 'Difficulty (Hard): invalid entry ''7-''' from customer where c_custkey % 3 = 0
  union all select doc_id, 9, num, 0, 'Question ' || num || ' is assigned to both ' || names || ' — remove it from one.' from m where times > 1)
select doc_id, string_agg(msg, chr(10) order by a, b, c) errors from er where doc_id in (select doc_id from q) group by 1""",
    "difficulty_applied": _D + "select q.doc_id, q.sequence_number, q.number, coalesce(case when m.times = 1 then m.level end, '') difficulty_level from q left join m on q.doc_id = m.doc_id and q.number = m.num where q.doc_id is not null",
    "passage_edited": _O + """, e as (select user_id doc_id, unnest([event_id % 7 + 1, event_id % 7 + 2])::int number, event_id s from events where event_type <> 'error'), p as (select doc_id, number, max(s) s from e group by all)
select q.doc_id, q.sequence_number, q.number, case when p.s is null then '' else 'passage ' || p.s end passage, p.s is not null modified from q left join p on q.doc_id = p.doc_id and q.number = p.number""",
    "confirmed_images": """with c as (select user_id doc_id, (event_id % 6 + 1)::int number, ['question','option_a','option_b','option_c','option_d','ambiguous'][event_id % 7 % 6 + 1] destination, event_id from events)
select doc_id, number, destination, case when event_id % 3 <> 0 then 'uploaded' else 'failed' end status, case when event_id % 3 <> 0 then 'http://c/' || event_id end image_url, event_id + 1000 image_seq from c where destination <> 'ambiguous'
qualify row_number() over (partition by doc_id, number, destination order by event_id desc) = 1""",
    "page_questions": _O + "select doc_id, sequence_number, number from q where sequence_number between 9 and 12",
    "image_columns": _I + "select * from ic",
    "unconfirmed_images": _I + ", " + _O.strip()[5:] + "select doc_id, sequence_number, number from q where is_image and not exists (select 1 from l where l.doc_id = q.doc_id and l.number = q.number and status = 'uploaded')",
    "upload_dedup": "with d as (select doc_id artifact_id, sha256(text) h from documents) select artifact_id, min(artifact_id) over (partition by h) upload_id, artifact_id <> min(artifact_id) over (partition by h) reused, h || case when artifact_id % 2 = 0 then '.jpg' else '.png' end file from d",
    "export_rows": _I + r""",
q as (select l_orderkey doc_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::int n, l_partkey p from lineitem),
f as (select *, count(*) over (partition by doc_id) cnt from q)
select f.doc_id, n sequence_number, n::varchar question_no, case when p % 5 < 4 then 'Section ' || (p % 5) else '' end section, 'objective_single_choice' question_type, ['easy', '', 'hard'][n % 3 + 1] difficulty_level,
  trim(concat_ws(chr(10), case when p % 19 = 0 and p % 2 = 0 then 'passage ' || (p % 4) || chr(10) end, case when p % 13 = 0 then '[IMAGE QUESTION — IMAGE REQUIRED: this question''s content/options are graphical and were not extracted. Review the source PDF manually.]' || chr(10) end, case when p % 17 = 0 then '' else 'stem ' || p end), ' ' || chr(10)) question_text,
  case when f.doc_id % 2 <> 0 then '' when 12 % cnt = 0 then (12 // cnt)::varchar else (12 / cnt)::varchar end marks, case when f.doc_id % 3 = 0 then '0.25' else '0' end negative_marks,
  case when p % 13 = 0 then '' when p % 11 = 0 then ' ' else 'o0 ' || p end option_a, coalesce(ic.option_a, '') option_image_url_a, case when p % 13 = 0 then '' when p % 11 = 1 then ' ' else 'o1 ' || p end option_b, coalesce(ic.option_b, '') option_image_url_b,
  case when p % 13 = 0 then '' when p % 11 = 2 then ' ' else 'o2 ' || p end option_c, coalesce(ic.option_c, '') option_image_url_c, case when p % 13 = 0 then '' when p % 11 = 3 then ' ' else 'o3 ' || p end option_d, coalesce(ic.option_d, '') option_image_url_d,
  case when p % 7 = 0 then '' when p % 23 = 0 then 'E' else substr('ABCD', (p % 4 + 1)::int, 1) end correct_answer, coalesce(ic.question, '') question_image_url, case when p % 29 = 0 then ' ' else 'because' end question_explanation, '' question_explanation_image
from f left join ic on f.doc_id = ic.doc_id and f.n = ic.number""",
    "exported_papers": r"""
with q as (select l_orderkey doc_id, l_linenumber number, l_partkey p, case when l_partkey % 7 = 0 then '' when l_partkey % 23 = 0 then 'E' else substr('ABCD', (l_partkey % 4 + 1)::int, 1) end ans from lineitem),
f as (select *, ans = '' noans, (p % 17 = 0) or (p % 13 = 0) or (p % 11 < 4) or ans = 'E' or (p % 19 = 0 and p % 2 = 1) or (p % 31 = 0) or (p % 3 = 0 and p % 100 < 60) low from q),
g as (select doc_id, count(*) filter (low) + count(*) filter (noans) review, count(*) filter (ans = 'E') bad, count(*) - count(distinct number) dup, max(number) - min(number) + 1 - count(distinct number) gap from f group by 1)
select doc_id, case when bad > 0 or dup > 0 then 'blocked' when review > 0 or gap > 0 then 'warn' else 'clean' end state, bad = 0 and dup = 0 and doc_id % 10 <> 0 exported, (review > 0)::int warnings from g""",
    "workbook_files": "select l_orderkey doc_id, 'exam' || l_orderkey || case when l_orderkey % 20 = 0 then '_Paper_1' else '' end || '_question_bank.xlsx' file_name, count(*)::int n_rows from lineitem group by 1",
    "upload_answers": "select event_id, case event_id % 4 when 0 then 'u' || event_id when 1 then 'd' || event_id end url from events",
    "typed_schemes": """select c_custkey, (case when c_custkey % 3 = 0 then 120 else 100 end)::double maximum_marks, case when c_custkey % 4 = 0 then null else 2::double end marks_per_question, case when c_custkey % 5 = 0 then 0.5::double end negative_marks,
  case when c_custkey % 3 = 0 then 'manual' else 'pdf' end max_source, case when c_custkey % 4 = 0 then 'not_specified' else 'derived' end per_source, case when c_custkey % 5 = 0 then 'manual' else 'not_specified' end negative_source,
  case when c_custkey % 3 = 0 then '✎ Manually entered' else '✓ Extracted from PDF' end caption, (c_custkey % 1000)::double tail from customer""",
}
