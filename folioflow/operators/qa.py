"""Question/answer sets: packing chunks for a generator, parsing what it returns, two row formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X

SEPARATOR = "\n\n---\n\n"


def packed(chunks: DataFrame, budget: int = 8000, dense: float = 0.5, doc: str = "doc_id") -> DataFrame:
    """``doc, group_id, n_chunks, chars, first_chunk, text``: neighbouring chunks of one kind up to a budget.

    A group ends when the kind (text or table) changes or the next chunk would exceed ``budget``
    characters of chunk text; a budget of 0 gives every chunk a group of its own. Digit-dense
    chunks other than tables are left out. The state resets at each group, which no
    window can express, so it is folded over each document's chunks as one expression.
    """
    usable = chunks.where(F.col("is_table") | (X.digit_ratio(F.col("text")) < dense))
    item = F.struct("chunk_id", "is_table", F.length("text").alias("size"), "text")
    lists = usable.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("gid"), F.lit(None).cast("boolean").alias("kind"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("gids"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["kind"].isNull() | (acc["kind"] != x["is_table"]) | F.lit(budget <= 0) | (acc["chars"] + x["size"] > budget)
        gid = acc["gid"] + new.cast("int")
        return F.struct(gid.alias("gid"), x["is_table"].alias("kind"), F.when(new, x["size"]).otherwise(acc["chars"] + x["size"]).alias("chars"), F.concat(acc["gids"], F.array(gid)).alias("gids"))

    gids = F.aggregate("items", start, step)["gids"]
    rows = lists.select(doc, F.explode(F.arrays_zip(F.col("items").alias("i"), gids.alias("g"))).alias("x")).select(doc, F.col("x.g").alias("group_id"), F.col("x.i").alias("i"))
    groups = rows.groupBy(doc, "group_id").agg(F.array_sort(F.collect_list("i")).alias("i"))
    shown = F.transform("i", lambda x: F.concat(F.lit("【块"), x["chunk_id"], F.lit("】\n"), x["text"]))
    return groups.select(
        doc, "group_id", F.size("i").alias("n_chunks"), F.aggregate("i", F.lit(0), lambda a, x: a + x["size"]).alias("chars"),
        F.element_at("i", 1)["chunk_id"].alias("first_chunk"), F.array_join(shown, SEPARATOR).alias("text"),
    )


def parse_pairs(reply: Column) -> Column:
    """``array<struct<instruction, output>>`` from a generator's reply.

    Code fences go, the first ``[`` to the last ``]`` is read as JSON; items without question
    or answer are left out, and what cannot be read gives an empty array.
    """
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), "```(?:json)?", "")
    start = F.locate("[", bare)
    end = F.length(bare) - F.locate("]", F.reverse(bare)) + 1
    body = F.when((start > 0) & F.contains(bare, F.lit("]")), F.substr(bare, start, end - start + 1))
    pairs = F.from_json(body, "array<struct<instruction:string,output:string>>")
    full = F.filter(pairs, lambda p: (F.coalesce(p["instruction"], F.lit("")) != "") & (F.coalesce(p["output"], F.lit("")) != ""))
    tidy = F.transform(full, lambda p: F.struct(X.strip(p["instruction"]).alias("instruction"), X.strip(p["output"]).alias("output")))
    return F.coalesce(tidy, F.array().cast("array<struct<instruction:string,output:string>>"))


def alpaca(replies: DataFrame, reply: str = "reply", order: tuple[str, ...] = ("doc_id", "group_id")) -> DataFrame:
    """One row per pair of every reply, with ``pos`` inside it; ``order`` columns are kept."""
    return replies.select(*order, F.posexplode(parse_pairs(F.col(reply))).alias("pos", "p")).select(*order, "pos", "p.*")


def sharegpt(pairs: DataFrame) -> DataFrame:
    """The same pairs as two-message conversations."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    others = [c for c in pairs.columns if c not in ("instruction", "output")]
    return pairs.select(*others, F.array(turn("user", "instruction"), turn("assistant", "output")).alias("conversations"))


def prompt(company: Column, context: Column, n: int = 6) -> Column:
    """What a generator is asked for; questions must name the company so that they stand alone."""
    return F.format_string(
        "Write up to %d question and answer pairs about %s from the excerpts below, as a JSON array of objects with the keys instruction and output. "
        "Every question names the company.\n\n%s", F.lit(n), F.coalesce(company, F.lit("the company")), context,
    )
