"""Reports on retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.lineage import written


def gold_of(items: DataFrame) -> DataFrame:
    """``qid, gold_stem, gold_chunks`` from a question's source file and reference answer."""
    return items.select("qid", X.stem(F.col("source")).alias("gold_stem"), X.gold_chunks(F.col("output")).alias("gold_chunks"))


def recall(ranked: DataFrame, gold: DataFrame, records: DataFrame, ks: tuple[int, ...] = (6, 20)) -> DataFrame:
    """``cfg, k, n, doc_recall, chunk_n, chunk_recall``.

    A document counts as found if a hit has the gold stem, a chunk if its number is also one of
    the gold ones; questions without gold chunks leave the chunk recall's denominator.
    """
    r = records.select("rec_id", X.stem(F.col("file")).alias("hit_stem"), "chunk_idx")
    cfgs = ranked.select("cfg").distinct()
    base = gold.join(cfgs)
    h = ranked.join(r, "rec_id").select("cfg", "qid", "rank", "hit_stem", "chunk_idx")
    same = F.col("hit_stem") == F.col("gold_stem")
    j = base.join(h, ["cfg", "qid"], "left")
    per = j.groupBy("cfg", "qid").agg(
        *[x for k in ks for x in (
            F.coalesce(F.bool_or(same & (F.col("rank") <= k)), F.lit(False)).alias(f"doc_{k}"),
            F.when(F.first(F.size("gold_chunks")) > 0, F.coalesce(F.bool_or(same & (F.col("rank") <= k) & F.array_contains("gold_chunks", F.col("chunk_idx"))), F.lit(False))).alias(f"chunk_{k}"),
        )]
    )
    long = per.select("cfg", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"doc_{k}").alias("d"), F.col(f"chunk_{k}").alias("c")) for k in ks])).alias("x")).select("cfg", "x.*")
    return long.groupBy("cfg", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("d").cast("int")), 6).alias("doc_recall"), F.count("c").alias("chunk_n"), F.round(F.avg(F.col("c").cast("int")), 6).alias("chunk_recall")
    )


def ablation(items: DataFrame, by: str = "cfg") -> DataFrame:
    """``cfg, n, acc, evidence_hit, evidence_n, routed, errors`` of judged answers.

    An answer without any number leaves evidence null and its rate's denominator.
    """
    return items.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("judge"), 6).alias("acc"), F.round(F.avg(F.col("evidence").cast("int")), 6).alias("evidence_hit"),
        F.count("evidence").alias("evidence_n"), F.count("routed").alias("routed"), F.count_if("error").alias("errors"),
    )


def scopes(rows: DataFrame, label: str, kind: str, labels: tuple[str, ...] = ("R", "H", "V")) -> DataFrame:
    """Counts and rates of the labels over everything ("all") and for each kind, in one pass."""
    cols = [x for v in labels for x in (F.count_if(F.col(label) == v).alias(f"n_{v}"), F.round(F.count_if(F.col(label) == v) / F.count(F.lit(1)), 6).alias(f"rate_{v}"))]
    everything = rows.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.grouping(kind).alias("whole"), F.count(F.lit(1)).alias("n"), *cols)
    return everything.select(F.when(F.col("whole") == 1, "all").otherwise(F.col(kind)).alias("scope"), "n", *[c for v in labels for c in (f"n_{v}", f"rate_{v}")])


def flips(rows: DataFrame, idx: str, before: str, after: str) -> DataFrame:
    """``idx, flip``: the items that were judged otherwise before, one row each, however many."""
    flip = F.when((F.col(before) == 1) & (F.col(after) == 0), "regressed").when((F.col(before) == 0) & (F.col(after) == 1), "improved")
    return rows.select(F.col(idx).alias("idx"), flip.alias("flip")).where("flip is not null")


def paired(rows: DataFrame, idx: str, before: str, after: str, most: int = 1_000_000) -> DataFrame:
    """``n, acc, orig_acc, delta_pp, regressed, improved`` of the same items judged twice.

    The two lists are a report's: more than ``most`` flips are an error (see :func:`flips`).
    """
    flip = F.when((F.col(before) == 1) & (F.col(after) == 0), "regressed").when((F.col(before) == 0) & (F.col(after) == 1), "improved")
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(after), 6).alias("acc"), F.round(F.avg(before), 6).alias("orig_acc"), F.round((F.avg(after) - F.avg(before)) * 100, 4).alias("delta_pp"),
        F.count(flip).alias("flips"),
    )
    f = flips(rows, idx, before, after).orderBy("idx").limit(most).groupBy("flip").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    named = lambda k: F.coalesce(F.first(F.when(F.col("flip") == k, F.col("ids")), True), F.array().cast(f.schema["ids"].dataType)).alias(k)
    out = counts.join(F.broadcast(f.agg(named("regressed"), named("improved"))))
    few = F.when(F.col("flips") > most, F.raise_error(F.lit("too many flips for one row"))).otherwise(F.col("regressed"))
    return out.select("n", "acc", "orig_acc", "delta_pp", few.alias("regressed"), "improved")


def running_mean(rows: DataFrame, value: str, order: str, by: str | None = None) -> DataFrame:
    """Each row with the mean so far, within ``by``; rows with one ``order`` lie as they come.

    A group may be as large as the table: rows are sorted by ranges of (by, order), the
    sums of whole ranges give each range its start and a window inside the range does the rest.
    """
    key = [by] if by else []
    cut = written(rows.repartitionByRange(*key, order).withColumn("__range", F.spark_partition_id()), "ranges")
    parts = cut.groupBy(*key, "__range").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*key, "__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__s", "__n")])
    own = Window.partitionBy(*key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    each = cut.select("*", F.coalesce(F.sum(value).over(own), F.lit(0)).alias("__s1"), F.count(value).over(own).alias("__n1"))
    meets = (F.col("a.__range") == F.col("b.__range")) & (F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")) if by else F.lit(True))
    both = each.alias("a").join(starts.alias("b"), meets)
    mean = (F.col("__s1") + F.col("__s0")) / F.nullif(F.col("__n1") + F.col("__n0"), F.lit(0))
    return both.select("a.*", F.round(mean, 6).alias("running")).drop("__range", "__s1", "__n1")


def two_by_two(judged: DataFrame) -> DataFrame:
    """Accuracy per side and method (fine-tuned alone, with retrieval); 0 for an empty cell."""
    return judged.groupBy("side").pivot("method", ["ft", "rag"]).agg(F.round(F.coalesce(F.avg("judge"), F.lit(0.0)), 6)).na.fill(0.0, ["ft", "rag"])


def latency(rows: DataFrame, value: Column, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def companies_hit(found: DataFrame) -> DataFrame:
    """``qid, hit_companies``: distinct and sorted."""
    return found.groupBy("qid").agg(F.array_sort(F.collect_set("company")).alias("hit_companies"))
