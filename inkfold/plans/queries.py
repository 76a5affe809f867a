"""Queries over the driver's tables; ``SQL`` states the same in DuckDB's dialect, written from the semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decode, files, geometry, grade, lifecycle, measure, report, specs
from ..sources import roster
from .adapters import SCHEMES, bubbles, judged, key, line_shares, pixels, positions, responses, sheets, strips, table  # noqa: F401
from .spec import FIELD_TYPES, Template

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


BUB = """WITH px AS (SELECT o.o_custkey AS sheet, l.l_orderkey AS strip, l.l_linenumber AS opt, CAST(255 - 5 * l.l_quantity AS INT) AS px
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
bub AS (SELECT sheet, strip, opt, sum(px) * 1.0 / count(*) AS m FROM px GROUP BY ALL),
sstd AS (SELECT sheet, strip, round(stddev_pop(m), 2) AS sd, count(*) AS n, min(m) AS mn, max(m) AS mx, avg(m) AS av FROM bub GROUP BY ALL)"""
GLO = (
    BUB
    + """,
gj AS (SELECT sheet, m, rn, j, row_number() OVER (PARTITION BY sheet ORDER BY j DESC, rn) AS r FROM (
  SELECT sheet, m, row_number() OVER w AS rn, lead(m, 4) OVER w - m AS j FROM bub WINDOW w AS (PARTITION BY sheet ORDER BY m, strip, opt)) WHERE j IS NOT NULL),
g AS (SELECT s.sheet, CASE WHEN j > 25 THEN m + j / 2 ELSE 200.0 END AS thr FROM (SELECT DISTINCT sheet FROM bub) s LEFT JOIN gj ON s.sheet = gj.sheet AND r = 1),
dj AS (SELECT sheet, sd, rn, j, row_number() OVER (PARTITION BY sheet ORDER BY j DESC, rn) AS r FROM (
  SELECT sheet, sd, row_number() OVER w AS rn, lead(sd, 2) OVER w - sd AS j FROM sstd WINDOW w AS (PARTITION BY sheet ORDER BY sd, strip)) WHERE j IS NOT NULL),
d AS (SELECT s.sheet, CASE WHEN j > 25 THEN sd + j / 2 ELSE 200.0 END AS thr FROM (SELECT DISTINCT sheet FROM bub) s LEFT JOIN dj ON s.sheet = dj.sheet AND r = 1)"""
)
LOC = (
    GLO
    + """,
lj AS (SELECT sheet, strip, m, rn, j, row_number() OVER (PARTITION BY sheet, strip ORDER BY j DESC, rn) AS r FROM (
  SELECT sheet, strip, m, row_number() OVER w AS rn, lead(m, 2) OVER w - m AS j FROM bub WINDOW w AS (PARTITION BY sheet, strip ORDER BY m, opt)) WHERE j IS NOT NULL),
loc AS (SELECT s.sheet, s.strip, CASE WHEN s.n < 3 THEN CASE WHEN s.mx - s.mn < 30 THEN g.thr ELSE s.av END
    WHEN greatest(lj.j, 25) < 30 AND s.sd < d.thr THEN g.thr WHEN lj.j > 25 THEN lj.m + lj.j / 2 ELSE 255.0 END AS thr
  FROM sstd s JOIN g ON s.sheet = g.sheet JOIN d ON s.sheet = d.sheet LEFT JOIN lj ON s.sheet = lj.sheet AND s.strip = lj.strip AND lj.r = 1),
mk AS (SELECT b.sheet, b.strip, b.opt, b.m, loc.thr FROM bub b JOIN loc ON b.sheet = loc.sheet AND b.strip = loc.strip WHERE loc.thr > b.m)"""
)
RESP = (
    LOC
    + """,
eq AS (SELECT * FROM (SELECT *, min(m) OVER (PARTITION BY sheet, strip) AS best FROM mk) WHERE m - best <= 0.06 * 255.0),
ans AS (SELECT sheet, strip, count(*) AS k, string_agg(DISTINCT substr('ABCDEFG', opt, 1), '' ORDER BY substr('ABCDEFG', opt, 1)) AS v FROM eq GROUP BY ALL),
resp AS (SELECT s.sheet, s.strip, CASE WHEN k IS NULL THEN 'NR' WHEN k > 1 THEN 'MR(' || v || ')' ELSE v END AS response, coalesce(k, 0) > 1 AS multi
  FROM sstd s LEFT JOIN ans ON s.sheet = ans.sheet AND s.strip = ans.strip),
pos AS (SELECT sheet, strip, row_number() OVER (PARTITION BY sheet ORDER BY strip) AS pos FROM sstd),
r AS (SELECT resp.*, pos.pos, 'q' || pos.pos AS label, o.o_orderpriority AS section,
    substr('ABCDEFG', CAST(1 + pos.pos % 7 AS INT), 1) AS a1, substr('ABCDEFG', CAST(1 + (pos.pos + 3) % 7 AS INT), 1) AS a2
  FROM resp JOIN pos ON resp.sheet = pos.sheet AND resp.strip = pos.strip JOIN orders o ON o.o_orderkey = resp.strip),
scheme(section, correct, incorrect, unmarked) AS (VALUES """
    + ", ".join(f"('{s}', {c}::DOUBLE, {i}::DOUBLE, {u}::DOUBLE)" for s, c, i, u in SCHEMES)
    + """),
v AS (SELECT r.*, CASE WHEN response = 'NR' THEN 'unmarked' WHEN response = a1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM r),
w AS (SELECT v.*, CASE verdict WHEN 'unmarked' THEN coalesce(s.unmarked, d0.unmarked) WHEN 'correct' THEN coalesce(s.correct, d0.correct) ELSE coalesce(s.incorrect, d0.incorrect) END AS delta
  FROM v LEFT JOIN scheme s ON v.section = s.section CROSS JOIN (SELECT * FROM scheme WHERE section = 'DEFAULT') d0)"""
)


# --- measurement and thresholds -------------------------------------------------------------------------------------
@query(BUB + " SELECT sheet, strip, opt, round(m, 4) AS m FROM bub")
def bubble_means(spark, d):
    return bubbles(spark, d).select("sheet", "strip", "opt", F.round("m", 4).alias("m"))


@query(BUB + " SELECT sheet, strip, sd FROM sstd")
def strip_std(spark, d):
    return sheets(spark, d).select("sheet", F.expr("inline(transform(strips, s -> struct(s.strip, s.sd)))"))


@query(GLO + " SELECT sheet, round(thr, 4) AS thr, thr = 255 AS looks_copied FROM g")
def global_threshold(spark, d):
    return sheets(spark, d).select("sheet", F.round("global_thr", 4).alias("thr"), (F.col("global_thr") == 255).alias("looks_copied"))


@query(GLO + " SELECT sheet, round(thr, 4) AS thr FROM d")
def std_threshold(spark, d):
    return sheets(spark, d).select("sheet", F.round("std_thr", 4).alias("thr"))


@query(LOC + " SELECT sheet, strip, round(thr, 4) AS thr FROM loc")
def local_threshold(spark, d):
    return strips(spark, d).select("sheet", "strip", F.round("thr", 4).alias("thr"))


@query(LOC + " SELECT sheet, strip, opt, round(m, 4) AS m FROM mk")
def marked_bubbles(spark, d):
    return measure.marked(strips(spark, d)).select("sheet", "strip", "opt", F.round("m", 4).alias("m"))


@query(LOC + " SELECT sheet, ((2 * sum(CAST(round(thr * 1000000) AS HUGEINT)) + 10000 * count(*)) // (20000 * count(*)))::BIGINT / 100.0::DOUBLE AS avg_thr FROM loc GROUP BY sheet")
def sheet_threshold_avg(spark, d):
    return measure.sheet_average(strips(spark, d))


FLAT = (
    LOC.replace("255 - 5 * l.l_quantity", "255 - l.l_quantity")
    + " SELECT l.sheet, l.strip, round(l.thr, 4) AS thr, count(mk.opt) AS n_marked FROM loc l LEFT JOIN mk ON l.sheet = mk.sheet AND l.strip = mk.strip GROUP BY ALL"
)


@query(FLAT)
def flat_contrast_threshold(spark, d):
    px = pixels(spark, d).withColumn("px", F.expr("cast(255 - (255 - px) / 5 as int)"))
    s = measure.local_thresholds(measure.measured(measure.bubble_means(px), parts=line_shares(spark, d)))
    return s.select("sheet", "strip", F.round("thr", 4).alias("thr"), F.expr("cast(size(filter(b, x -> thr > x.m)) as bigint)").alias("n_marked"))


# --- decoding -------------------------------------------------------------------------------------------------------
@query(RESP + " SELECT sheet, strip, response, multi FROM resp")
def question_response(spark, d):
    return decode.question_responses(strips(spark, d)).select("sheet", "strip", "response", "multi")


@query(RESP + " SELECT sheet, bool_or(multi) AS multi, sum(multi::INT)::BIGINT AS n_multi FROM resp GROUP BY sheet")
def multi_marked_sheets(spark, d):
    r = decode.question_responses(strips(spark, d))
    return r.groupBy("sheet").agg(F.bool_or("multi").alias("multi"), F.sum(F.col("multi").cast("long")).alias("n_multi"))


# Rolls are digits, questions have own values from right to left; both come from a template.
TEMPLATE = {
    "pageDimensions": [3000, 3000], "bubbleDimensions": [20, 20],
    "fieldBlocks": {
        "Roll": {"fieldType": "QTYPE_INT", "origin": [10, 10], "fieldLabels": ["roll1..3"], "labelsGap": 30, "bubblesGap": 30},
        "Own": {"bubbleValues": list("7654321"), "direction": "horizontal", "emptyValue": "-", "origin": [500, 10], "fieldLabels": ["q1..57"], "labelsGap": 30, "bubblesGap": 30},
    },
}


@query(
    RESP
    + """ SELECT r.sheet, CASE WHEN r.pos <= 3 THEN 'roll' || r.pos ELSE 'q' || (r.pos - 3) END AS label,
CASE WHEN r.pos <= 3 THEN coalesce(d.digits, '') WHEN r.response = 'NR' THEN '-' WHEN r.multi THEN 'MR(' || reverse(translate(substr(r.response, 4, length(r.response) - 4), 'ABCDEFG', '7654321')) || ')' ELSE translate(r.response, 'ABCDEFG', '7654321') END AS response,
r.pos > 3 AND r.multi AS multi
FROM r LEFT JOIN (SELECT sheet, strip, string_agg((opt - 1)::VARCHAR, '' ORDER BY opt) AS digits FROM mk GROUP BY ALL) d ON r.sheet = d.sheet AND r.strip = d.strip"""
)
def template_responses(spark, d):
    label = F.when(F.col("pos") <= 3, F.concat(F.lit("roll"), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("q"), (F.col("pos") - 3).cast("string")))
    s = strips(spark, d).join(positions(spark, d).select("sheet", "strip", label.alias("own")), ["sheet", "strip"])
    s = s.select("sheet", F.col("own").alias("strip"), "thr", F.expr("transform(b, x -> struct(x.m as m, x.opt - 1 as opt))").alias("b"))
    return decode.template_responses(s, Template(TEMPLATE).value_table(spark))


@query(LOC + " SELECT s.sheet, s.strip, coalesce(string_agg(substr('ABCDEFG', opt, 1), '' ORDER BY opt), '') AS response FROM sstd s LEFT JOIN mk ON s.sheet = mk.sheet AND s.strip = mk.strip GROUP BY ALL")
def strip_concat(spark, d):
    return decode.strip_concat(strips(spark, d))


@query(RESP + " SELECT sheet, CASE WHEN pos <= 3 THEN 'Roll' ELSE label END AS label, string_agg(response, '' ORDER BY pos) AS response FROM r GROUP BY ALL")
def digit_concat(spark, d):
    custom = spark.createDataFrame([("q1", "Roll", 1), ("q2", "Roll", 2), ("q3", "Roll", 3)], "label string, out_label string, pos int")
    return decode.concatenated(responses(spark, d).select("sheet", "label", "response"), custom)


@query(RESP + " SELECT sheet, " + ", ".join(f"max(CASE WHEN pos = {i} THEN response END) AS q{i}" for i in range(1, 61)) + " FROM r GROUP BY sheet")
def wide_responses(spark, d):
    return decode.wide(responses(spark, d), [f"q{i}" for i in range(1, 61)])


# --- grading --------------------------------------------------------------------------------------------------------
KEYED = [f"q{i}" for i in range(1, 13)]


@query("SELECT c_custkey AS sheet, 'q' || i AS label FROM customer, range(1, 13) t(i) WHERE i > (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)")
def missing_questions(spark, d):
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("sheet"))
    return grade.missing_questions(positions(spark, d).select("sheet", "label"), KEYED, every)


@query(RESP + " SELECT sheet, label FROM r WHERE pos > 12")
def extra_questions(spark, d):
    return grade.extra_questions(positions(spark, d).select("sheet", "label"), KEYED)


@query(RESP + " SELECT sheet, label, response, verdict FROM v")
def verdicts(spark, d):
    return grade.verdict_columns(key(responses(spark, d))).select("sheet", "label", "response", "verdict")


@query(RESP + " SELECT sheet, label, CASE WHEN response = 'NR' THEN 'unmarked' WHEN response IN (a1, a2) THEN 'correct-' || response ELSE 'incorrect' END AS verdict FROM r")
def multiple_verdicts(spark, d):
    return grade.verdict_columns(key(responses(spark, d), "multiple")).select("sheet", "label", "verdict")


@query(
    RESP
    + """ SELECT r.sheet, label, CASE WHEN response = 'NR' THEN coalesce(s.unmarked, 0.0) WHEN response = a2 THEN 1.5 WHEN response = a1 THEN 2.0 ELSE coalesce(s.incorrect, -0.25) END AS delta
FROM r LEFT JOIN scheme s ON r.section = s.section"""
)
def weighted_verdicts(spark, d):
    return judged(spark, d, "weighted").select("sheet", "label", "delta")


@query(RESP + " SELECT sheet, section, sum(delta) AS section_score, count(*) AS n FROM w GROUP BY ALL")
def section_scores(spark, d):
    return judged(spark, d).groupBy("sheet", "section").agg(F.sum("delta").alias("section_score"), F.count(F.lit(1)).alias("n"))


@query(RESP + " SELECT sheet, sum(delta) AS score FROM w GROUP BY sheet")
def sheet_scores(spark, d):
    return grade.sheet_scores(judged(spark, d))


@query(
    RESP
    + """ SELECT sheet, CAST(pos AS INT) AS pos, label, response, upper(verdict[1]) || verdict[2:] AS verdict, delta,
sum(delta) OVER (PARTITION BY sheet ORDER BY pos) AS score FROM w"""
)
def explanation_running_score(spark, d):
    return grade.explanation(judged(spark, d)).select("sheet", "pos", "label", "response", "verdict", "delta", "score")


@query("SELECT l_orderkey AS id, l_linenumber AS n, l_tax * 100 AS t, round(CAST(l_linenumber AS DOUBLE) / 3, 6) AS value FROM lineitem")
def fraction_parse(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_tax") * 100).alias("t"), F.concat(F.col("l_linenumber").cast("string"), F.lit("/3")).alias("text"))
    return line.select("id", "n", "t", F.round(grade.number("text"), 6).alias("value"))


@query("SELECT o_orderkey, len(string_split(o_orderpriority || ',' || o_orderstatus, ',')) AS n_answers, o_orderpriority AS first_answer FROM orders")
def answer_parse(spark, d):
    o = table(spark, d, "orders").withColumn("cell", F.concat_ws(",", "o_orderpriority", "o_orderstatus"))
    a = grade.parse_answers("cell")
    return o.select("o_orderkey", F.size(a).cast("long").alias("n_answers"), F.get(a, F.lit(0)).alias("first_answer"))


# --- routing and reports --------------------------------------------------------------------------------------------
@query(
    RESP
    + """ SELECT c.c_custkey AS sheet, CASE WHEN w0.sheet IS NULL THEN 'errors' WHEN m THEN 'multimarked' ELSE 'results' END AS route,
CASE WHEN w0.sheet IS NULL OR m THEN 'NA' ELSE CAST(score AS VARCHAR) END AS score
FROM customer c LEFT JOIN (SELECT sheet, sum(delta) AS score, sum(multi::INT) > 5 AS m FROM w GROUP BY sheet) w0 ON c.c_custkey = w0.sheet"""
)
def route_sheets(spark, d):
    s = judged(spark, d).groupBy("sheet").agg(F.expr("aggregate(transform(array_sort(collect_list(struct(pos, delta))), x -> x.delta), 0d, (a, x) -> a + x)").alias("score"), (F.sum(F.col("multi").cast("int")) > 5).alias("multi"))
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("sheet")).join(s, "sheet", "left")
    every = every.withColumn("readable", F.col("score").isNotNull()).withColumn("multi", F.coalesce("multi", F.lit(False)))
    return report.routed(every).select("sheet", "route", "score")


@query("SELECT count(*) AS processed, sum((event_type = 'error')::INT)::BIGINT AS failed, sum((event_type <> 'error')::INT)::BIGINT AS done, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS elapsed, round(count(*) * 60.0 / greatest(1, date_diff('second', min(ts), max(ts))), 6) AS per_minute FROM events")
def run_stats(spark, d):
    return report.run_stats(table(spark, d, "events"), "ts", F.col("event_type") == "error")


@query("SELECT event_id, user_id % 4 AS worker, event_type, row_number() OVER (ORDER BY event_id) AS idx FROM events")
def merge_ordered(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("worker"), "event_type")
    return report.merged([e.where(F.col("worker") == w) for w in range(4)], "event_id").select("event_id", "worker", "event_type", "idx")


@query(
    RESP
    + """ , q AS (SELECT sheet, sum((response = 'NR')::INT) AS nr, count(*) AS n FROM r GROUP BY sheet)
SELECT sheet, CAST(nr AS INT) AS nr_count, round(nr / n, 6) AS nr_percent,
concat_ws(',', CASE WHEN nr / n >= 0.7 THEN 'HIGH_NR' END, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]') THEN 'BAD_CANDIDATE' END) AS flags
FROM q JOIN customer ON c_custkey = sheet"""
)
def qc_flags(spark, d):
    r = responses(spark, d).groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("label", "response"))).alias("responses"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sheet"), F.col("c_name").alias("candidate"))
    return report.qc_flags(r.join(c, "sheet"), "Customer#[0-9]*[02468]").select("sheet", "nr_count", F.round("nr_percent", 6).alias("nr_percent"), F.array_join("qc_flags", ",").alias("flags"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error')
SELECT user_id AS file_id, 'error' AS kind, 'NA' AS score FROM e WHERE k = 1
UNION ALL SELECT event_id, 'result', CAST(event_id % 7 AS VARCHAR) FROM events WHERE event_type = 'purchase'"""
)
def results_union(spark, d):
    e = table(spark, d, "events")
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("file_id"), F.col("ts").alias("mtime"), F.col("event_id").alias("row"), F.lit("NA").alias("score"))
    results = e.where("event_type = 'purchase'").select(F.col("event_id").alias("file_id"), (F.col("event_id") % 7).cast("string").alias("score"))
    return report.results_view(results, errors)


@query("SELECT user_id, CASE WHEN sum((event_type <> 'error')::INT) = 0 THEN 'failed' WHEN sum((event_type = 'error')::INT) > 0 THEN 'done with errors' ELSE 'done' END AS outcome FROM events GROUP BY user_id")
def batch_outcome(spark, d):
    return report.batch_outcome(table(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query(
    """WITH b AS (SELECT user_id, count(*) AS p, 40 AS t, date_diff('second', min(ts), max(ts)) AS e FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN e > 0 THEN round_even(p / e * 60, 1) END AS rate, CASE WHEN e > 0 AND p < t THEN CAST(round_even((t - p) / (p / e), 0) AS BIGINT) END AS eta FROM b"""
)
def progress_eta(spark, d):
    second = lambda f: F.unix_timestamp(F.date_trunc("second", f("ts")))
    b = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("processed"), (second(F.max) - second(F.min)).alias("elapsed"))
    b = b.withColumn("total", F.lit(40)).withColumn("status", F.when(F.col("processed") < 40, "running").otherwise("done"))
    return report.progress(b).select("user_id", "rate", "eta")


@query(
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST((10 * rn) // n AS BIGINT) * 10 AS percent, min(event_id) AS event_id FROM r WHERE (10 * rn) // n > (10 * (rn - 1)) // n GROUP BY ALL"""
)
def milestones(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return report.milestones(e, "user_id", "ts", "event_id").select("user_id", "percent", "event_id")


@query("SELECT user_id, max(event_id) AS latest_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_processed(spark, d):
    return report.latest_processed(table(spark, d, "events"), "user_id", "event_id", "event_type")


RISK = """CASE WHEN length(response) > 1 AND len(list_distinct(regexp_extract_all(t, '[A-Z]'))) > 1
  THEN CAST(least(95, 65 + 10 * len(list_distinct(regexp_extract_all(t, '[A-Z]')))) AS INT) ELSE 0 END"""


@query(RESP + f" SELECT sheet, label, {RISK} AS risk FROM (SELECT *, upper(response) AS t FROM r)")
def erasure_risk(spark, d):
    return report.erasure_risk(responses(spark, d).withColumnRenamed("response", "answer")).select("sheet", "label", "risk")


@query(RESP + f" SELECT sheet, label, {RISK} AS risk FROM (SELECT *, CASE WHEN response = 'NR' THEN '' ELSE replace(replace(response, 'MR(', ''), ')', '') END AS t FROM r)")
def erasure_risk_fixed(spark, d):
    return report.erasure_risk(responses(spark, d).withColumnRenamed("response", "answer"), fixed=True).select("sheet", "label", "risk")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_rows(spark, d):
    return report.preview(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), lower('E'))")
def name_search(spark, d):
    return report.name_search(table(spark, d, "pages").select("page_id", "url"), "url", "E")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created, CAST(row_number() OVER (ORDER BY max(ts) DESC, user_id) AS INT) AS place FROM events GROUP BY user_id QUALIFY place <= 50")
def newest_batches(spark, d):
    return report.newest_batches(table(spark, d, "events"), "user_id", "ts").withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'cancelled' ELSE 'failed' END AS step,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'e' || event_id END AS err FROM events),
s AS (SELECT user_id, 0::BIGINT AS rn, 'created' AS status, NULL::VARCHAR AS last_error, 0::BIGINT AS rejected FROM e GROUP BY user_id
  UNION ALL SELECT user_id, rn, CASE WHEN ok THEN step ELSE status END, CASE WHEN ok AND (err IS NOT NULL OR step = 'failed') THEN err WHEN ok AND step IN ('queued', 'running', 'done') THEN NULL ELSE last_error END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (SELECT e.user_id, e.rn, s.status, s.last_error, s.rejected, e.step, e.err, (s.status || '>' || e.step) IN ('created>queued', 'queued>running', 'queued>cancelled', 'running>done', 'running>failed', 'running>cancelled', 'done>queued', 'failed>queued', 'cancelled>queued') AS ok FROM s JOIN e ON s.user_id = e.user_id AND e.rn = s.rn + 1))
SELECT user_id, arg_max(status, rn) AS status, CASE WHEN max(rn) = arg_max(rn, rn) THEN max(struct_pack(rn := rn, x := last_error)).x END AS last_error, max(rejected) AS rejected FROM s GROUP BY user_id"""
)
def status_fold(spark, d):
    status = F.expr("case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'done' when 'purchase' then 'cancelled' else 'failed' end")
    e = table(spark, d, "events").select("user_id", "event_id", status.alias("status"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("e"), "event_id")).alias("error"))
    return lifecycle.folded(e, "user_id", ["event_id"])


# --- specifications -------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, 'q' || CAST(i AS VARCHAR) AS label FROM (SELECT p_partkey, unnest(range(p_size, p_size + 2 + p_partkey % 5)) AS i FROM part WHERE p_partkey % 7 <> 0) UNION ALL SELECT p_partkey, 'Roll' || p_size FROM part WHERE p_partkey % 7 = 0")
def range_expand(spark, d):
    text = F.concat(F.lit("q"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "..").otherwise("..."), (F.col("p_size") + 1 + F.col("p_partkey") % 5).cast("string"))
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("Roll"), "p_size")).otherwise(text).alias("t"))
    return p.select("p_partkey", F.explode(specs.expanded("t")).alias("label"))


TYPES = ", ".join(f"('{t}', '{''.join(v['bubbleValues'])}', '{v['direction']}')" for t, v in FIELD_TYPES.items())


@query(f"WITH ft(field_type, vals, direction) AS (VALUES {TYPES}) SELECT p_partkey, field_type, direction, length(vals)::INT AS n_values FROM part JOIN ft ON field_type = ['QTYPE_MCQ4','QTYPE_MCQ5','QTYPE_MCQ4_RTL','QTYPE_MCQ5_RTL','QTYPE_INT','QTYPE_INT_FROM_1'][1 + p_partkey % 6]")
def field_types(spark, d):
    ft = spark.createDataFrame([(t, v["direction"], len(v["bubbleValues"])) for t, v in FIELD_TYPES.items()], "field_type string, direction string, n_values int")
    p = table(spark, d, "part").select("p_partkey", F.expr("element_at(array('QTYPE_MCQ4','QTYPE_MCQ5','QTYPE_MCQ4_RTL','QTYPE_MCQ5_RTL','QTYPE_INT','QTYPE_INT_FROM_1'), cast(1 + p_partkey % 6 as int))").alias("field_type"))
    return p.join(F.broadcast(ft), "field_type").select("p_partkey", "field_type", "direction", "n_values")


@query(
    """SELECT p_partkey, 'q' || i AS label, v AS value,
  CAST(round_even(list_reduce(list_prepend(p_size + 0.5::DOUBLE, repeat([CASE WHEN p_partkey % 2 = 0 THEN 41.1::DOUBLE ELSE 52.25::DOUBLE END], CASE WHEN p_partkey % 2 = 0 THEN k - 1 ELSE i - 1 END)), lambda a, b: a + b), 0) AS INT) AS x,
  CAST(round_even(list_reduce(list_prepend(10::DOUBLE, repeat([CASE WHEN p_partkey % 2 = 0 THEN 52.25::DOUBLE ELSE 41.1::DOUBLE END], CASE WHEN p_partkey % 2 = 0 THEN i - 1 ELSE k - 1 END)), lambda a, b: a + b), 0) AS INT) AS y
FROM part, range(1, 6) t(i), (SELECT unnest(['A','B','C','D']) AS v, unnest([1, 2, 3, 4]) AS k)"""
)
def bubble_grid(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.expr("transform(sequence(1, 5), i -> concat('q', i))").alias("labels"), F.expr("array('A', 'B', 'C', 'D')").alias("values"),
        F.when(F.col("p_partkey") % 2 == 0, "horizontal").otherwise("vertical").alias("direction"), (F.col("p_size") + 0.5).alias("x0"), F.lit(10).alias("y0"), F.expr("cast(41.1 as double)").alias("bubbles_gap"), F.expr("52.25d").alias("labels_gap"),
    )
    return specs.grid(p).select("p_partkey", "label", "value", "x", "y")


@query(
    """SELECT p_partkey, width, height, width + 100 >= 1500 OR height + 50 >= 1800 AS overflows FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trunc(41.5 * (p_size - 1) + 30) ELSE trunc(52.25 * (p_partkey % 9) + 30) END::INT AS width,
    CASE WHEN p_partkey % 2 = 0 THEN trunc(52.25 * (p_partkey % 9) + 20) ELSE trunc(41.5 * (p_size - 1) + 20) END::INT AS height FROM part)"""
)
def block_dimensions(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", (1 + F.col("p_partkey") % 9).alias("n_labels"), F.when(F.col("p_partkey") % 2 == 0, "horizontal").otherwise("vertical").alias("direction"))
    w, h = specs.block_size("n_labels", "p_size", "41.5d", "52.25d", "30", "20", "direction")
    p = p.select("p_partkey", w.alias("width"), h.alias("height"))
    return p.withColumn("overflows", specs.overflows(F.lit(100), F.lit(50), F.col("width"), F.col("height"), F.lit(1500), F.lit(1800)))


@query("SELECT label, CAST(row_number() OVER (ORDER BY p, n, label) AS INT) AS place FROM (SELECT DISTINCT p_brand AS label, regexp_extract(p_brand, '^([^0-9]*)', 1) AS p, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS n FROM part)")
def natural_sort_labels(spark, d):
    labels = table(spark, d, "part").select(F.col("p_brand").alias("label")).distinct()
    return labels.withColumn("place", F.row_number().over(Window.orderBy(*files.natural_key("label"))))


@query("SELECT p_name AS label, count(DISTINCT p_brand) AS blocks FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def overlap_check(spark, d):
    return specs.overlapping(table(spark, d, "part"), "p_name", "p_brand")


@query("SELECT p_brand AS label FROM part WHERE p_size < 10 GROUP BY p_brand EXCEPT SELECT p_brand FROM part WHERE p_size > 49")
def missing_labels(spark, d):
    p = table(spark, d, "part").select("p_size", F.col("p_brand").alias("label"))
    return specs.missing(p.where("p_size < 10"), p.where("p_size > 49"))


@query("SELECT l.l_orderkey, l.l_linenumber, coalesce(s.section, 'DEFAULT') AS section, count(*) AS n FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey LEFT JOIN (VALUES ('1-URGENT'), ('2-HIGH')) s(section) ON s.section = o_orderpriority GROUP BY ALL")
def question_sections(spark, d):
    known = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "section string")
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return specs.sections(j, "o_orderpriority", known).groupBy("l_orderkey", "l_linenumber", "section").agg(F.count(F.lit(1)).alias("n"))


# --- pixel arithmetic -----------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, q, CAST(CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 255 ELSE floor(pow(x, 1.0 / 0.8) * 255) END AS INT) AS level FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, ((255 - 5 * l_quantity) / 255.0 - 0.1) / (0.9 - 0.1) AS x FROM lineitem)")
def levels_lut(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), geometry.level(255 - 5 * F.col("l_quantity"), 0.1, 0.9, 0.8).alias("level"))


@query(
    """SELECT sheet, scale, worst FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY worst DESC, scale DESC) AS r
FROM (SELECT l_orderkey AS sheet, l_linenumber AS scale, min(l_quantity) AS worst FROM lineitem GROUP BY ALL)) WHERE r = 1"""
)
def best_scale(spark, d):
    return geometry.best_scale(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("scale"), F.col("l_quantity").alias("score")))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 50 AS t, m AS anchor, l_quantity / 50 >= 0.3 AND abs(m - l_quantity / 50) < 0.41 AS accepted FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) / 50 AS m FROM lineitem)")
def corner_accept(spark, d):
    c = geometry.accepted_corners(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), "l_linenumber", (F.col("l_quantity") / 50).alias("score")))
    return c.select(F.col("sheet").alias("l_orderkey"), "l_linenumber", F.col("score").alias("t"), "anchor", "accepted")


@query("SELECT p_partkey, greatest(0, p_size * 10 - 20)::INT AS x0, least(515, p_size * 10 + 120)::INT AS x1, greatest(0, p_size - 20)::INT AS y0, least(666, p_size + 320)::INT AS y1 FROM part")
def window_clip(spark, d):
    x, y = F.col("p_size") * 10, F.col("p_size")
    x0, x1, y0, y1 = geometry.clipped(x, x + 100, y, y + 300, F.lit(515), F.lit(666), padding=F.lit(20))
    return table(spark, d, "part").select("p_partkey", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 4 * 90 AS turn, p_size * 50 AS w0, 400 + p_size * 20 AS h0, CASE WHEN p_partkey % 3 = 0 THEN 300 + p_size END AS pw, CASE WHEN p_partkey % 3 = 0 THEN 500 END AS ph FROM part),
t AS (SELECT *, CASE WHEN turn IN (90, 270) THEN h0 ELSE w0 END AS w, CASE WHEN turn IN (90, 270) THEN w0 ELSE h0 END AS h FROM p),
s AS (SELECT *, least(1.0::DOUBLE, 1640.0::DOUBLE / w, 2480.0::DOUBLE / h) AS d, least(1.0::DOUBLE, 666.0::DOUBLE / w, 820.0::DOUBLE / h) AS r FROM t)
SELECT p_partkey, CAST(greatest(1, round_even(w * d, 0)) AS INT) AS display_width, CAST(greatest(1, round_even(h * d, 0)) AS INT) AS display_height,
  CAST(coalesce(pw, greatest(1, round_even(w * r, 0))) AS INT) AS processing_width, CAST(coalesce(ph, greatest(1, round_even(h * r, 0))) AS INT) AS processing_height FROM s"""
)
def fit_dimensions(spark, d):
    marked = F.col("p_partkey") % 3 == 0
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 50).alias("width"), (400 + F.col("p_size") * 20).alias("height"), (F.col("p_partkey") % 4 * 90).alias("rotation"), F.when(marked, 300 + F.col("p_size")).alias("page_width"), F.when(marked, 500).alias("page_height")
    )
    return geometry.page_dimensions(p, (1640, 2480), (666, 820)).select("p_partkey", "display_width", "display_height", "processing_width", "processing_height")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= floor(n * 0.15)")
def top_matches(spark, d):
    return geometry.best_share(table(spark, d, "orders"), "o_custkey", 15, "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


# --- files ----------------------------------------------------------------------------------------------------------
PAGES = "SELECT page_id, 'in/r' || (page_id % 5) || '/n' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN '/deep/er' ELSE '' END AS dir FROM pages"
CONFIGS = [("in", "base"), ("in/r1", "one"), ("in/r2", "two"), ("in/r1/n3", "one-three"), ("in/r4/n2/deep", "deep")]


@query(
    f"WITH f AS ({PAGES}), c(config_dir, template) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in CONFIGS)
    + ") SELECT page_id AS file, template FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(config_dir) DESC) AS r FROM f JOIN c ON dir = config_dir OR starts_with(dir, config_dir || '/')) WHERE r = 1"
)
def nearest_config(spark, d):
    f = table(spark, d, "pages").selectExpr("page_id AS file", "concat('in/r', page_id % 5, '/n', page_id % 7, case when page_id % 3 = 0 then '/deep/er' else '' end) AS dir")
    return files.nearest_config(f, F.broadcast(spark.createDataFrame(CONFIGS, "config_dir string, template string"))).select("file", "template")


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0)")
def exclude_files(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return files.without(p, "url", p.where("page_id % 10 = 0")).select("page_id", "url")


SAFE = "nullif(trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), '')"


@query(f"SELECT page_id, {SAFE} AS name FROM pages")
def sanitise_names(spark, d):
    return table(spark, d, "pages").select("page_id", files.sanitised("url").alias("name"))


@query(
    """WITH d AS (SELECT doc_id, source || CASE WHEN doc_id % 7 = 0 THEN '_' || (1 + doc_id % 5) ELSE '' END AS stem FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) - 1 AS k FROM d),
t AS (SELECT regexp_replace(stem, '_[0-9]+$', '') AS stem, list(regexp_extract(stem, '_([0-9]+)$', 1)::BIGINT) AS taken FROM (SELECT DISTINCT stem FROM d) WHERE regexp_matches(stem, '_[0-9]+$') GROUP BY ALL)
SELECT doc_id, n.stem || CASE WHEN k > 0 THEN '_' || list_filter(range(1, k + 100), lambda x: NOT list_contains(coalesce(taken, []), x))[k] ELSE '' END || '.png' AS unique_name FROM n LEFT JOIN t ON n.stem = t.stem"""
)
def dedupe_names(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.expr("concat(source, case when doc_id % 7 = 0 then concat('_', 1 + doc_id % 5) else '' end, '.png')").alias("name"))
    return files.deduplicated(n, "name", "doc_id").select("doc_id", "unique_name")


@query("SELECT event_id AS path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mtime FROM events ORDER BY ts DESC, event_id LIMIT 1")
def latest_file(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"))
    return files.latest(e).select("path", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'error' AND user_id % 10 <> 3")
def errors_oldest_first(spark, d):
    e = table(spark, d, "events").where("event_type = 'error' and user_id % 10 <> 3").select("event_id", "ts")
    return report.oldest_first(e, "ts", "event_id").select("event_id", "place")


@query("SELECT path FROM (SELECT 'in/scan' || page_id || ['.png', '.JPG', '.txt', '.Jpeg', ''][1 + page_id % 5] AS path FROM pages) WHERE regexp_matches(lower(path), '[.](png|jpg|jpeg)$')")
def list_files(spark, d):
    p = table(spark, d, "pages").select(F.concat_ws("/", F.lit("in"), F.concat(F.lit("scan"), "page_id", F.expr("get(array('.png', '.JPG', '.txt', '.Jpeg', ''), cast(page_id % 5 as int))"))).alias("path"))
    return files.listed(p, [".png", ".jpg", ".jpeg"])


# --- rosters --------------------------------------------------------------------------------------------------------
@query(
    """SELECT c_custkey, CASE WHEN length(n) > 12 THEN n[1:12] || '…' ELSE n END AS student_name, lpad(CAST(c_custkey AS VARCHAR), 8 + CAST(c_custkey % 3 AS INT), '0') AS candidate_number,
8 + c_custkey % 3 = 10 AS valid FROM (SELECT c_custkey, trim(c_name) AS n FROM customer)"""
)
def roster_clean(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.expr("lpad(cast(c_custkey as string), cast(8 + c_custkey % 3 as int), '0')").alias("number"))
    return c.select("c_custkey", roster.clean("c_name", 12).alias("student_name"), roster.clean("number", 10).alias("candidate_number"), roster.valid_candidate("number").alias("valid"))


@query(
    """SELECT c_custkey, CAST(i - 1 AS INT) AS col, CAST(substr(c, CAST(i AS INT), 1) AS INT) AS digit, round(100 + (i - 0.5) * 30.0, 4) AS x, round((0.1 + CAST(substr(c, CAST(i AS INT), 1) AS INT) * 0.085) * 500, 4) AS y
FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS c FROM customer), range(1, 11) t(i)"""
)
def candidate_bubbles(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("lpad(cast(c_custkey as string), 10, '0')").alias("candidate"))
    b = roster.candidate_bubbles(c, x0=100.0, width=300.0, top=0.1, step=0.085, height=500.0)
    return b.select("c_custkey", "col", "digit", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'sheet_' || lpad(CAST(c_custkey AS VARCHAR), greatest(3, length(CAST(c_custkey AS VARCHAR)))::INT, '0') || '.png' WHEN c_custkey % 3 = 1 THEN c_name || '.png' ELSE c_name || '.png' END AS entry FROM customer")
def zip_names(spark, d):
    out = F.expr("case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then concat('out/', c_name) else concat(c_name, '.png') end")
    return table(spark, d, "customer").select("c_custkey", roster.entry_name(out, F.col("c_custkey")).alias("entry"))


@query("SELECT c_mktsegment AS batch, count(*) AS n, sum((c_acctbal >= 0)::INT)::BIGINT AS successes, sum(length(c_name))::BIGINT AS bytes, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT c_custkey AS k FROM customer i WHERE i.c_mktsegment = o.c_mktsegment AND c_acctbal < 0 ORDER BY k LIMIT 50)) AS errors FROM customer o GROUP BY c_mktsegment")
def prefill_batches(spark, d):
    bad = report.first_n(table(spark, d, "customer").where("c_acctbal < 0"), "c_mktsegment", 50, "c_custkey").groupBy("c_mktsegment").agg(F.expr("array_join(transform(array_sort(collect_list(c_custkey)), x -> cast(x as string)), ',')").alias("errors"))
    a = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c_acctbal") >= 0).cast("long")).alias("successes"), F.sum(F.length("c_name").cast("long")).alias("bytes"))
    return a.join(bad, "c_mktsegment", "left").withColumnRenamed("c_mktsegment", "batch").select("batch", "n", "successes", "bytes", "errors")
