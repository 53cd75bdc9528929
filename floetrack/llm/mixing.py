"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions of documents.

The mix is ``share`` times the words of all sources. Sources share it by weight; a source whose part passes ``epochs`` times
its own words is clamped there and the excess is reshared by weight among the others, round after round until none is above
(each round is one aggregate over the table of sources, and only the common level comes back to the driver).

A target is so many whole repetitions of the source and a rest of words. The rest is a sample: documents stand in the order of
a seeded digest of key and text, and the first ones are taken once more until the rest is reached; the last of them is taken
in part, so that the words of a source meet its target to the word. Where that order is cut is found by two hexadecimal
digits of the digest at a time: an aggregate of at most 256 sums per source, until few documents are left to be ordered.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from floetrack.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
FEW = 1000  # documents of a source that are ordered in one task
SLOTS = 32


def word_count(text):
    """Number of words, without a list of them: each becomes one letter, blanks go."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "a"), BLANKS, "")).cast("bigint")


def salted(rows, small, keys, spread):
    """Inner join of ``rows`` with ``small`` (unique, NULL-safe ``keys``); a hot key's rows are dealt over slots by ``spread``."""
    slot = F.pmod(F.xxhash64(spread), F.lit(SLOTS)).cast("int")
    s = small.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.col("__here") == F.col("__slot")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.withColumn("__here", slot).join(s, on).drop("__here", "__slot", *[f"__{k}" for k in keys])


def ranked(sources):
    """``rank`` of each source from 0 by code point, NULL last: ranks within ranges plus the sizes of the ranges before."""
    order = F.col("source").asc_nulls_last()
    parts = written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offset = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("within", within).join(offset, "part").withColumn("rank", F.col("within") + F.col("offset")).drop("part", "within", "offset")


def targets(rows, weights=WEIGHTS, share=1.5, epochs=2):
    """Rows (source, source_size, target) of ``rows(source, size)``; a source without words has the target 0."""
    w = F.array(*[F.lit(int(x)) for x in weights])[(F.col("rank") % len(weights)).cast("int")]
    by = written(ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("weight", w).drop("rank"), "sources")
    cap = F.lit(epochs) * F.col("source_size")
    pool, level = share * (by.agg(F.sum("source_size")).first()[0] or 0), None
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        clamped, weight = by.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not weight:
            break
        found = (pool - (clamped or 0)) / weight
        if found == level:
            break
        level = found
    part = F.lit(level or 0.0) * F.col("weight")
    return by.select("source", "source_size", F.when(part > cap, cap.cast("double")).otherwise(part).alias("target"))


def cut_points(rows, plan):
    """``plan`` with ``last`` and ``cut``: the rest takes the documents before the mark ``last``, and ``cut`` words of that one."""
    todo = written(plan.where("rest > 0").select("source", F.lit("").alias("prefix"), F.col("rest").alias("open")), "open")
    found = None
    while not todo.isEmpty():
        here = salted(rows.where("size > 0"), todo, ["source"], F.col("mark")).where(F.col("mark").startswith(F.col("prefix")))
        digits = F.substring(F.col("mark"), F.length("prefix") + 1, F.lit(2))
        sums = here.groupBy("source", "prefix", "open", digits.alias("d")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("d"))
        at = sums.withColumn("upto", upto).where("upto >= open and upto - s < open")
        todo = written(at.select("source", F.concat("prefix", "d").alias("prefix"), (F.col("open") - F.col("upto") + F.col("s")).alias("open"), "n"), "open")
        few = todo.where(F.col("n") <= FEW).drop("n")
        found = few if found is None else found.unionByName(few)
        todo = todo.where(F.col("n") > FEW).drop("n")
    if found is None:
        return plan.withColumns({"last": F.lit(None).cast("string"), "cut": F.lit(None).cast("bigint")})
    here = salted(rows.where("size > 0"), found, ["source"], F.col("mark")).where(F.col("mark").startswith(F.col("prefix")))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("mark"))
    at = here.withColumn("upto", upto).where("upto >= open and upto - size < open")
    at = at.select(F.col("source").alias("__s"), F.col("mark").alias("last"), (F.col("open") - F.col("upto") + F.col("size")).alias("cut"))
    return plan.join(at, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def mix(docs, weights=WEIGHTS, share=1.5, epochs=2, seed="mix", key="doc_id", text="text", source="source", carry=False):
    """Rows (key, size, source_size, target, taken, repeats, cut): ``repeats`` whole copies and ``cut`` words of one more.

    One row per row of ``docs``. NULL texts have no words; NULL is a source of its own, the last; NULL and repeated keys keep
    their rows; equal rows are interchangeable, so that reruns agree whatever their order; empty texts are taken 0 words;
    an empty table gives no rows. Other columns are not read; ``carry``: whole input rows come along as ``row``.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    mark = F.concat(F.md5(name), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    own = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mark.alias("mark"), *own), "sized")
    plan = targets(rows, weights, share, epochs).withColumn("need", F.floor(F.col("target") + 0.5).cast("bigint"))
    whole = F.when(F.col("source_size") > 0, F.expr("need div source_size")).otherwise(F.lit(0))
    plan = written(plan.withColumn("whole", whole).withColumn("rest", F.col("need") - F.col("whole") * F.col("source_size")), "plan")
    plan = written(cut_points(rows, plan).drop("need", "rest"), "cuts")
    got = salted(rows, plan, ["source"], F.col("mark"))
    more = F.when(F.col("mark") < F.col("last"), F.col("size")).when(F.col("mark") == F.col("last"), F.col("cut")).otherwise(F.lit(0))
    out = got.withColumn("more", more).withColumn("taken", F.col("whole") * F.col("size") + F.col("more"))
    all_of_it = F.col("more") == F.col("size")
    out = out.withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + all_of_it.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    out = out.withColumn("cut", F.when(all_of_it, F.lit(0).cast("bigint")).otherwise(F.col("more")))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "repeats", "cut", *(["row"] if carry else []))


def repetitions(docs, text="text", **options):
    """The mix itself: every input row once per repetition with ``copy`` from 1; the text of a partial one is its first words."""
    m = mix(docs, text=text, carry=True, **options).where("taken > 0")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("repeats") + F.when(F.col("cut") > 0, 1).otherwise(0)).cast("int"))))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(WORD), F.lit(0)), 1, F.col("cut").cast("int")), " ")
    body = F.when(F.col("copy") > F.col("repeats"), first).otherwise(F.col(f"row.`{text}`"))
    return m.select(*[(body if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], "copy")
