"""What each of several text filters removes, in every order of applying them.

Each document's failures are a mask of five bits, built by native expressions. What an order of
filters keeps, removes and loses depends on how many documents have which mask, so documents are
counted into cells ``(part, mask)`` first, 32 a part, and all 120 orders are worked out from cells.

Scale: texts are read once and stay where they are; a SHA-256 stands for them. The copies of one text are
counted by id, then by (digest, part, labels), both with map-side sums, so a text that a third of all documents
share leaves a few rows a task. The least id of a text is the least of those rows. Joined are ids with
labels only. The table of orders has 19,200 rows whatever the input; it alone is broadcast.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cognatus.llm.text import WORD

FILTERS = "ABCDE"
#: Fixed by the contract: the least number of words, percents of distinct words and of capitals, and marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


def failures(text: Column | str) -> dict[str, Column]:
    """Whether a text fails each filter that looks at it alone; null is empty.

    A: few words. B: few distinct words. C: many capitals. D: holds a mark.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by failures, and how many of them are of quality, or toxic.

    Bit k of the mask is filter k. A row fails E if a smaller id has the same text; rows of one id are no
    copies of each other, and a null id has no copies and no labels. Repeated rows count as often as they occur. Of
    several labels of an id one of 1 suffices.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(text_col).values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    # null ids are spread by their texts and meet nothing
    apart = F.when(F.col("id").isNull(), F.xxhash64("digest").bitwiseOR(1)).otherwise(0)
    told = told.withColumn("__apart", F.lit(0).cast("long"))
    rows = rows.withColumns({"apart": apart, "key": F.coalesce("id", F.lit(0).cast(docs.schema[id_col].dataType))})
    rows = rows.join(told, (F.col("key") == F.col("__id")) & (F.col("apart") == F.col("__apart")), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    # of a text: rows by part and labels, each with its least id and how often that occurs
    at = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low")
    nulls = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    same_id = rows.groupBy("digest", "mask", "part", "quality", "toxic", "id").agg(F.sum("n").alias("n"))
    kinds = same_id.groupBy("digest", "mask", "part", "quality", "toxic").agg(F.sum("n").alias("n"), at, nulls)
    least = F.min("low.id").over(Window.partitionBy("digest"))
    alone = F.col("nulls") + F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(0)
    kinds = kinds.withColumn("least", least).withColumn("alone", alone)
    copy = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("alone").alias("k")), F.struct((F.col("mask") + copy).alias("m"), (F.col("n") - F.col("alone")).alias("k"))))
    counted = kinds.select("part", "quality", "toxic", split.alias("c")).where("c.k > 0")
    return counted.groupBy("part", F.col("c.m").alias("mask")).agg(
        F.sum("c.k").alias("n"), F.sum(F.col("c.k") * F.col("quality")).alias("good"), F.sum(F.col("c.k") * F.col("toxic")).alias("toxic")
    )


def orders(spark: SparkSession) -> DataFrame:
    """``(filter_order, step, letter, mask, kept, removed, redundant, only)``: what becomes of a document with a mask at each step of each order."""
    steps = [
        ("".join(order), k + 1, order[k], sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k]))
        for order in permutations(FILTERS)
        for k in range(len(FILTERS))
    ]
    dim = spark.createDataFrame(steps, "filter_order string, step int, letter string, earlier int, own int")
    dim = dim.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    one = lambda c: c.cast("long")
    return dim.select("filter_order", "step", "letter", "mask", one(~fails & ~gone).alias("kept"), one(fails & ~gone).alias("removed"), one(fails & gone).alias("redundant"), one(F.col("mask") == F.col("own")).alias("only"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Per part, order of the filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    600 rows a part, zeros included. ``shapley`` is what the step's filter removes, summed over all orders. Null
    texts are empty ones, which fail A alone unless they are copies; a null part is the empty string's. Texts of any length
    are looked at whole. Other columns are ignored; without documents there are no parts and no rows, and without
    labels nothing is lost.
    """
    dim = F.broadcast(orders(docs.sparkSession))  # 19,200 rows
    counted = cells(docs, labels, **columns).join(dim, "mask")
    total = lambda what, of="n": F.sum(F.col(what) * F.col(of))
    steps = counted.groupBy("part", "filter_order", "step", "letter").agg(
        total("kept").alias("kept"),
        total("removed").alias("removed"),
        total("redundant").alias("redundant"),
        total("only").alias("unique_fails"),
        total("removed", "good").alias("good_lost"),
        total("removed", "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
