"""Which company does a question mean?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def codes_of(question: Column, pattern: str = r"(?<!\d)\d{6}(?!\d)") -> Column:
    return F.regexp_extract_all(question, F.lit(pattern), F.lit(0))


def companies(records: DataFrame) -> DataFrame:
    """``company, ord``: each company with its first record's number."""
    return records.groupBy("company").agg(F.min("rec_id").alias("ord"))


def codes(records: DataFrame) -> DataFrame:
    """``code, company``: the first company of each stock code in the records' file names."""
    from folioflow.functions.text import stock_code

    return records.withColumn("code", stock_code(F.col("file"))).where("code is not null").groupBy("code").agg(F.min_by("company", "rec_id").alias("company"))


def route(questions: DataFrame, names: DataFrame, code_table: DataFrame) -> DataFrame:
    """``qid, routed``: by the first known stock code, else by the first company named.

    Codes meet in an equi join. Names (``company, ord``) are a dimension; each question is cut
    into all substrings of the lengths that names have, and these meet the names in an
    equi join as well, so no question is held against every company.
    """
    hits = questions.select("qid", F.posexplode(codes_of(F.col("question"))).alias("pos", "code")).join(code_table, "code")
    by_code = hits.groupBy("qid").agg(F.min_by("company", "pos").alias("by_code"))
    n = names.select("company", "ord", F.replace("company", F.lit(" "), F.lit("")).alias("name")).where("name <> ''")
    sizes = n.agg(F.coalesce(F.array_sort(F.collect_set(F.length("name"))), F.array().cast("array<int>")).alias("sizes"))
    q = questions.select("qid", F.replace("question", F.lit(" "), F.lit("")).alias("q")).join(F.broadcast(sizes))
    cut = F.flatten(F.transform("sizes", lambda k: F.when(F.length("q") >= k, F.transform(F.sequence(F.lit(1), F.length("q") - k + 1), lambda i: F.substr("q", i, k))).otherwise(F.array().cast("array<string>"))))
    named = q.select("qid", F.explode(F.array_distinct(cut)).alias("name")).join(n, "name")
    by_name = named.groupBy("qid").agg(F.min_by("company", F.struct("ord", "company")).alias("by_name"))
    out = questions.select("qid").join(by_code, "qid", "left").join(by_name, "qid", "left")
    return out.select("qid", F.coalesce("by_code", "by_name").alias("routed"))
