"""Queries on acquisition, ledgers, judged rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.lineage import fresh_path
from folioflow.operators import acquisition, evaluate, incremental, judging, models, qa, retrieval
from folioflow.sources import readers, writers

from .common import table
from .registry import query


@query("""SELECT source, doc_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS pick FROM documents) ORDER BY pick, source LIMIT 50""")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 50)


@query("""SELECT o_custkey, o_orderkey, epoch_ms(o_orderdate) AS millis FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1
  ORDER BY epoch_ms(o_orderdate) DESC, o_orderkey LIMIT 50""")
def topn_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"))
    return acquisition.newest(acquisition.first_per_key(o, "o_custkey", "o_orderkey"), "millis", 50, "o_orderkey")


@query(r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, regexp_replace(regexp_replace(o_orderpriority || ':' || o_orderstatus || '?', '[\\/:*?"<>|\r\n\t]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe,
  printf('%02d_%s_%s_%s.pdf', (o_orderkey % 100)::INT, lpad(o_custkey::VARCHAR, 6, '0'), regexp_replace(regexp_replace(o_orderpriority || ':' || o_orderstatus || '?', '[\\/:*?"<>|\r\n\t]+', '_', 'g'), '^_+|_+$', '', 'g'), strftime(o_orderdate, '%Y-%m-%d')) AS file FROM orders""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date = X.millis_to_date(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    name = F.concat("o_orderpriority", F.lit(":"), "o_orderstatus", F.lit("?"))
    file = X.report_file((F.col("o_orderkey") % 100).cast("int"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), name, date)
    return o.select("o_orderkey", date.alias("date"), X.safe_name(name).alias("safe"), file.alias("file"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '年度报告' WHEN 1 THEN source || '年度报告摘要' WHEN 2 THEN '年度报告（英文版）' WHEN 3 THEN source || '季度报告' END AS title FROM documents)
  SELECT doc_id, coalesce(contains(title, '年度报告') AND NOT contains(title, '摘要') AND NOT contains(title, '英文'), false) AS annual FROM t""")
def report_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, source = F.col("doc_id") % 5, F.col("source")
    title = F.when(k == 0, F.concat(source, F.lit("年度报告"))).when(k == 1, F.concat(source, F.lit("年度报告摘要"))).when(k == 2, "年度报告（英文版）").when(k == 3, F.concat(source, F.lit("季度报告")))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_annual_report(title).alias("annual"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, epoch_ms(o_orderdate) AS t, row_number() OVER (ORDER BY epoch_ms(o_orderdate) DESC, o_orderkey)::INT AS idx FROM orders WHERE o_orderkey % 50 = 0)
  SELECT idx, o_custkey::VARCHAR AS code, 'http://files.example/' || o_orderkey AS url, printf('%02d_%s_%s_%s.pdf', idx, o_custkey::VARCHAR, o_orderstatus, strftime(make_timestamp_ms(t), '%Y-%m-%d')) AS file FROM r WHERE o_orderkey % 3 <> 0""")
def report_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0")
    r = o.select(
        F.col("o_custkey").cast("string").alias("secCode"), F.col("o_orderstatus").alias("secName"), F.lit("").alias("announcementTitle"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("announcementTime"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("/"), F.col("o_orderkey").cast("string"))).alias("adjunctUrl"), F.col("o_orderkey").alias("seen"),
    )
    return acquisition.manifest(r, "http://files.example/").select("idx", "code", "url", "file")


@query("""SELECT count(*) AS n, count(*) FILTER (k NOT IN (0, 1)) AS ok, count(*) FILTER (k = 0) AS skipped, count(*) FILTER (k = 1) AS failed FROM (SELECT c_custkey % 7 AS k FROM customer)""")
def fetch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hosts, the first always down; some rows have no path and some files are nowhere."""

    def fetch(url: str) -> bytes:
        if url.startswith("http://down/") or url.endswith("/gone"):
            raise OSError("no such file")
        return url.encode()

    k = F.col("c_custkey") % 7
    m = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 1, "/gone").when(k > 1, F.col("c_name")).alias("adjunctUrl"))
    return acquisition.fetch_report(readers.fetched(m, fetch, ["http://down/", "http://up/"], wait=0))


@query("""SELECT c_custkey, a.o_totalprice AS answer FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey) a ON a.o_custkey = c_custkey""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers, those that failed left out."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("answer"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("error"))
    return incremental.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), stored, "c_custkey", "answer", "o_orderkey", "error")


@query("""SELECT doc_id AS qid, source AS gold_stem, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN [n_chars % 9] ELSE CASE WHEN n_chars % 9 = 4 THEN [4] ELSE list_sort([n_chars % 9, 4]) END END::INT[] AS gold_chunks FROM documents""")
def gold_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold document and chunks of each question, from its source's name and the marks in its reference answer."""
    mark = lambda c: F.concat(F.lit("见【块"), c.cast("string"), F.lit("】"))
    a = mark(F.col("n_chars") % 9 + 1)
    output = F.when(F.col("doc_id") % 3 == 0, "无").when(F.col("doc_id") % 3 == 1, a).otherwise(F.concat(a, mark(F.lit(5)), a))
    ending = F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise("_chunks.json")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.concat("source", ending).alias("source"), output.alias("output"))
    return evaluate.gold_of(items)


@query("""SELECT doc_id AS qid, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS company, 'Question: What of ' || source || '?' AS rewritten, contains('Question: What of ' || source || '?', CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END) AS company_kept FROM documents""")
def casual_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions put in other words by the offline generator; every fourth names another company."""
    d = table(spark, sf_dir, "documents")
    company = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("source"))
    asked = d.select(F.col("doc_id").alias("qid"), company.alias("company"), F.concat(F.lit("What of "), "source", F.lit("?")).alias("question"))
    return judging.rewritten(asked, models.echo_generator).select("qid", "company", "rewritten", "company_kept")


@query("""SELECT label::VARCHAR AS company, list(vec_id ORDER BY vec_id) AS rec_ids FROM embeddings GROUP BY label""")
def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("company"), F.col("vec_id").alias("rec_id"))
    return retrieval.groups(e)


@query(r"""WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ord, CASE WHEN item_id % 6 = 0 THEN ' ' ELSE text END AS text,
    CASE item_id % 3 WHEN 0 THEN printf('%02d_600001_Firm %d_x_chunks.json', (item_id % 100)::INT, (item_id % 7)::INT) WHEN 1 THEN printf('Firm_%d.pdf', (item_id % 7)::INT) END AS source FROM benchmark)
  SELECT row_number() OVER (ORDER BY ord) - 1 AS rec_id, ord::INT AS chunk_idx, md5(text) AS digest, CASE item_id % 3 WHEN 0 THEN printf('Firm %d', (item_id % 7)::INT) WHEN 1 THEN printf('Firm_%d', (item_id % 7)::INT) ELSE 'merged' END AS company
  FROM b WHERE trim(text) <> ''""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged chunk file, written as one JSON array and read back as index records; items without a source are the file's own."""
    k, firm = F.col("item_id") % 3, (F.col("item_id") % 7).cast("int")
    source = F.when(k == 0, F.format_string("%02d_600001_Firm %d_x_chunks.json", (F.col("item_id") % 100).cast("int"), firm)).when(k == 1, F.format_string("Firm_%d.pdf", firm))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 6 == 0, " ").otherwise(F.col("text")).alias("text"), source.alias("source"))
    path = fresh_path(spark, "merged")
    writers.json_array(b, path, ["item_id"])
    r = readers.chunk_records(spark, path, "*.txt")
    own = F.when(F.startswith("file", F.lit("part-")), "merged").otherwise(F.col("company"))
    return r.select("rec_id", "chunk_idx", F.md5("text").alias("digest"), own.alias("company"))


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 7 THEN printf('Firm %d_chunks.json', c_custkey % 100) WHEN c_custkey % 10 = 8 THEN printf('Firm %d_x.pdf', c_custkey % 100) ELSE
    printf('%02d_%s_%s_x.pdf', (c_custkey % 100)::INT, CASE WHEN c_custkey % 3 = 0 THEN '688' ELSE '300' END || lpad((c_custkey % 1000)::VARCHAR, 3, '0'), replace(c_name, '#', ' ')) END AS file FROM customer)
  SELECT c_custkey, file, CASE WHEN c_custkey % 10 IN (7, 8) THEN NULL ELSE string_split(file, '_')[2] END AS code, CASE WHEN c_custkey % 10 IN (7, 8) THEN string_split(file, '_')[1] ELSE replace(string_split(file, '_')[3], ' ', '') END AS company,
  CASE c_custkey % 10 WHEN 7 THEN string_split(file, '_')[1] WHEN 8 THEN replace(file, '.pdf', '') ELSE string_split(file, '_')[3] END AS label, regexp_replace(file, '_chunks\\.json|\\.pdf', '') AS stem,
  CASE WHEN contains(file, '688') THEN '科创板' WHEN regexp_matches(file, '30[0-9]{4}') THEN '创业板' WHEN contains(file, 'ST') THEN 'ST风险' ELSE '主板' END AS board FROM f""")
def file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, few = F.col("c_custkey") % 10, F.col("c_custkey") % 100
    code = F.concat(F.when(F.col("c_custkey") % 3 == 0, "688").otherwise("300"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    file = F.when(k == 7, F.format_string("Firm %d_chunks.json", few)).when(k == 8, F.format_string("Firm %d_x.pdf", few)).otherwise(F.format_string("%02d_%s_%s_x.pdf", few.cast("int"), code, F.replace("c_name", F.lit("#"), F.lit(" "))))
    f = c.select("c_custkey", file.alias("file"))
    n = F.col("file")
    return f.select("c_custkey", "file", X.stock_code(n).alias("code"), X.company_key(n).alias("company"), X.company_label(n).alias("label"), X.stem(n).alias("stem"), X.board(n).alias("board"))


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new' FROM labels""")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("version"))
    return incremental.replaced(old, table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("version")), "doc_id")


@query("""SELECT DISTINCT source AS cfg FROM documents EXCEPT SELECT source FROM (SELECT source FROM documents d JOIN labels l USING (doc_id) GROUP BY source HAVING avg(quality) >= 0.8)""")
def unfinished_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    r = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("cfg")).agg((F.avg("quality") < 0.8).alias("partial"))
    return incremental.unfinished(r, d.select(F.col("source").alias("cfg")).distinct())


@query("""SELECT user_id AS cfg FROM events GROUP BY user_id HAVING count(*) >= 8 AND min((coalesce(event_type, '') <> '')::INT) = 1""")
def complete_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.complete(table(spark, sf_dir, "events").select(F.col("user_id").alias("cfg"), "event_type"), "cfg", "event_type", 8)


@query("""SELECT c_custkey, a.o_totalprice AS answer FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey) a ON a.o_custkey = c_custkey""")
def answer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("answer"), "o_orderkey")
    return incremental.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), stored, "c_custkey", "answer", "o_orderkey")


@query("""SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


_KIND = "CASE WHEN toxic = 1 THEN 'R' WHEN quality = 1 THEN 'H' ELSE 'V' END"


@query(f"""SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS scope, count(*) AS n,
  count(*) FILTER (v = 'R') AS "n_R", round(count(*) FILTER (v = 'R') / count(*), 6) AS "rate_R", count(*) FILTER (v = 'H') AS "n_H", round(count(*) FILTER (v = 'H') / count(*), 6) AS "rate_H",
  count(*) FILTER (v = 'V') AS "n_V", round(count(*) FILTER (v = 'V') / count(*), 6) AS "rate_V" FROM (SELECT source, {_KIND} AS v FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((), (source))""")
def refusal_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "R").when(F.col("quality") == 1, "H").otherwise("V")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", label.alias("v"))
    return evaluate.scopes(rows, "v", "source")


@query("""SELECT count(*) AS n, round(avg(toxic), 6) AS acc, round(avg(quality), 6) AS orig_acc, round((avg(toxic) - avg(quality)) * 100, 4) AS delta_pp,
  coalesce(list(doc_id ORDER BY doc_id) FILTER (quality = 1 AND toxic = 0), []) AS regressed, coalesce(list(doc_id ORDER BY doc_id) FILTER (quality = 0 AND toxic = 1), []) AS improved FROM labels""")
def paired_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


@query("""SELECT doc_id, round(avg(quality) OVER (PARTITION BY toxic ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM labels""")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.running_mean(table(spark, sf_dir, "labels"), "quality", "doc_id", "toxic").select("doc_id", "running")


@query("""SELECT source AS cfg, count(*) AS n, round(avg(quality), 6) AS acc, round(avg(CASE WHEN doc_id % 3 > 0 THEN (toxic = 0)::INT END), 6) AS evidence_hit,
  count(*) FILTER (doc_id % 3 > 0) AS evidence_n, count(lang) AS routed, count(*) FILTER (toxic = 1) AS errors FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def ablation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    items = j.select(F.col("source").alias("cfg"), F.col("quality").alias("judge"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic") == 0).alias("evidence"), F.col("lang").alias("routed"), (F.col("toxic") == 1).alias("error"))
    return evaluate.ablation(items)


@query("""SELECT event_type AS cfg, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events").withColumnRenamed("event_type", "cfg"), F.col("value"), "cfg")


@query("""SELECT source AS side, round(coalesce(avg(quality) FILTER (toxic = 0), 0), 6) AS ft, round(coalesce(avg(quality) FILTER (toxic = 1), 0), 6) AS rag FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.two_by_two(j.select(F.col("source").alias("side"), F.when(F.col("toxic") == 0, "ft").otherwise("rag").alias("method"), F.col("quality").alias("judge")))


@query("""SELECT c_nationkey AS qid, list_sort(list_distinct(list(c_mktsegment))) AS hit_companies FROM customer GROUP BY c_nationkey""")
def hit_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.companies_hit(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_mktsegment").alias("company")))


@query(r"""SELECT conv_id, turn, 0 AS pos, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS question, role AS answer FROM conversations WHERE text <> ''""")
def qa_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a generator's fenced JSON reply, parsed back."""
    body = F.to_json(F.array(F.struct(F.col("text").alias("instruction"), F.col("role").alias("output"))))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))
    return qa.alpaca(c, order=("conv_id", "turn")).select("conv_id", "turn", "pos", F.md5("instruction").alias("question"), F.col("output").alias("answer"))


@query("""SELECT event_id, CASE WHEN event_type LIKE 'e%' THEN 'R' ELSE 'V' END AS triage, (substr(props, 1, 1) = '1')::INT AS verdict FROM
  (SELECT event_id, replace(replace(event_type, 'error', 'e'), 'purchase', 'p') AS event_type, regexp_extract(props, '[0-9]+') AS props FROM events)""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type").startswith("e"), " r, refused").otherwise(F.concat(F.lit("?"), F.col("event_type")))
    return e.select("event_id", X.triage(said).alias("triage"), X.verdict(F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0))).alias("verdict"))
