"""Mixing sources to target weights by entropy balancing.

Sources get a token target each. Within a source the document rates are those nearest to
one copy each, in relative entropy, that meet the target under a cap; they are tilted
exponentially in the document's size, ``min(cap, exp(lambda * size / mean))``, and the dual
variable is found by Newton steps. Rates are then rounded into whole copies such that the
rounding errors of a source cancel.

Scale: documents are first reduced to an exact histogram over (source, size, hash bucket). A Newton
iteration is an aggregate of that histogram, with map-side sums: gradient and slope of every source at once,
for the dual separates by source. Rounding sees a source's histogram of sizes in one task; it has a row
per distinct size, whatever the number of documents, at most as many as the longest document has
words. Many documents of
one source and size are spread over the hash buckets when copies are dealt out; their number
follows the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cognatus.llm.text import WORD
from cognatus.session import discard, materialize

#: Documents are dealt to buckets by a hash of the row: so many at least, and a bucket's documents on average.
BUCKETS, BUCKET_ROWS = 64, 1 << 14
#: Up to so many sources, a row of four columns each, are broadcast.
FEW_SOURCES = 10_000


def word_count(text: Column | str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(
    histogram: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Per source: ``rank``, ``source_size`` and ``target``.

    ``histogram`` has source, size and n. Sources in code-point order, null last, take the
    weights in turn and split ``share`` of all tokens by them. A target stops at ``cap``
    times its source's size and the excess goes to the others by weight, until none is above:
    that is the level at which the capped shares add up to the total.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (
        histogram.groupBy("source")
        .agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("top", F.col("source_size") * F.lit(float(cap)))
    )
    filled = Window.orderBy(F.col("top") / F.col("w"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("top") / F.col("w"), F.struct((F.col("top") / F.col("w")).alias("at"), "rank", "level"))
    return sources.withColumn("level", F.min(fits).over(every)["level"]).select(
        "source",
        F.col("rank"),
        "source_size",
        F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"),
    )


def newton_duals(strata: DataFrame, cap: float, rounds: int = 200) -> DataFrame:
    """``(rank, lam, mean)``: dual variables with which the rates of :func:`tilted` meet the targets.

    ``strata`` has rank, target, size and n. Newton on the dual's derivative, kept inside a bracket that
    bisects where a step leaves it; all sources step together until each has settled. A target that no rate
    reaches has an infinite variable; sizes of zero carry no tokens and play no part.
    """
    strata = strata.where("size > 0").withColumn("mass", F.col("n") * F.col("size"))
    inf = float("inf")
    state = strata.groupBy("rank", "target").agg(F.sum("mass").alias("tokens"), F.sum("n").alias("live"))
    full = F.col("target") >= F.lit(cap) * F.col("tokens") * F.lit(1 - 1e-12)
    lam = F.when(F.col("target") <= 0, -inf).when(full, inf).otherwise(0.0)
    state = state.select("rank", "target", (F.col("tokens") / F.col("live")).alias("mean"), lam.alias("lam"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"))
    state = materialize(state.withColumn("open", F.col("lam") == 0), "duals")
    x = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
    for _ in range(rounds):
        if state.where("open").isEmpty():
            break
        at = strata.drop("target").join(state.where("open").select("rank", "mean", "lam"), "rank")
        sums = at.groupBy("rank").agg(F.sum(F.col("mass") * F.least(tilt, F.lit(cap))).alias("got"), F.sum(F.when(tilt < cap, F.col("mass") * x * tilt).otherwise(0.0)).alias("slope"))
        told = state.join(sums, "rank", "left").withColumn("gradient", F.col("got") - F.col("target"))
        told = told.withColumns({"low": F.when(F.col("gradient") < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("gradient") >= 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("gradient") / F.col("slope"))
        step = (
            F.when((newton > F.col("low")) & (newton < F.col("high")), newton)
            .when(F.col("high") == inf, 2 * F.col("lam") + 1)
            .when(F.col("low") == -inf, 2 * F.col("lam") - 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        told = told.withColumn("step", step)
        goes = F.col("open") & (F.abs("gradient") > F.lit(1e-9) * F.col("target")) & (F.col("step") != F.col("lam"))
        told = told.select("rank", "target", "mean", F.when(goes, F.col("step")).otherwise(F.col("lam")).alias("lam"), "low", "high", F.coalesce(goes, F.lit(False)).alias("open"))
        last, state = state, materialize(told, "duals")
        discard(last)
    return state.select("rank", "lam", "mean")


def tilted(size: np.ndarray, lam: float, mean: float, cap: float) -> np.ndarray:
    """Rates ``min(cap, exp(lam * size / mean))``; sizes of zero get rate one."""
    rate = np.ones(len(size))
    live = size > 0
    rate[live] = np.minimum(cap, np.exp(np.minimum(lam * (size[live] / mean), 700.0)))
    return rate


def round_strata(size: np.ndarray, n: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(base, ups)``: every document of a stratum gets ``base`` copies, ``ups`` of them one more.

    Strata go from long to short and carry the token error on, so what long documents leave
    over, short ones make good.
    """
    base = np.floor(rate + 1e-12).astype(np.int64)
    part = np.clip(rate - base, 0.0, 1.0)
    ups = np.zeros(len(size), np.int64)
    error = 0.0
    for i in np.argsort(-size, kind="stable"):
        s, k = int(size[i]), int(n[i])
        if s == 0:
            continue
        error += k * part[i] * s
        if part[i] > 1e-12:
            ups[i] = min(k, max(0, round(error / s)))
        error -= float(ups[i]) * s
    return base, ups


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    buckets: int | None = None,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    ``size_col`` is a count of tokens; null counts as zero. Documents without tokens keep one
    copy and take nothing. A null source is a source; null or repeated ids are rows like any
    other; very long documents are sizes like any other. Input columns named like the results are
    replaced. An empty table stays empty. The result depends on the rows alone: extra copies go by a
    hash of the whole row, and rows it cannot tell apart are equal, so reruns agree.
    """
    made = ("source_size", "target", "copies", "taken")
    docs = docs.drop(*[c for c in made if c in docs.columns])
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long"))
    if buckets is None:
        buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    whole = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    turn = F.xxhash64(*[F.col(c) for c in [id_col, *sorted(set(whole) - {id_col})]])
    bucket = F.pmod(turn, F.lit(buckets)).cast("int")
    fine = docs.groupBy(F.col(source_col).alias("source"), size.alias("size"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    fine = materialize(fine, "histogram")
    histogram = fine.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = materialize(source_targets(histogram, weights, share, cap), "targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    strata = materialize(histogram.join(targets.withColumnRenamed("source", "of"), same).select("rank", "target", "size", "n"), "strata")

    def solve(table: pa.Table) -> pa.Table:
        size, n = (table.column(c).to_numpy() for c in ("size", "n"))
        rate = tilted(size, table.column("lam")[0].as_py(), table.column("mean")[0].as_py(), cap)
        base, ups = round_strata(size, n, rate)
        return pa.table([table.column("rank"), table.column("size"), pa.array(base), pa.array(ups)], names=["__r", "__s", "__base", "ups"])

    solved = strata.join(newton_duals(strata, cap), "rank", "left").fillna({"lam": 0.0, "mean": 1.0}).groupBy("rank").applyInArrow(solve, "__r int, __s long, __base long, ups long")
    # the extra copies of a stratum go to its buckets in turn, and within a bucket to its first documents
    before = Window.partitionBy("__r", "__s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = fine.join(targets.select(F.col("source").alias("of"), "rank"), same)
    plan = plan.join(solved, (F.col("rank") == F.col("__r")) & (F.col("size") == F.col("__s")))
    ahead = F.col("ups") - F.coalesce(F.sum("n").over(before), F.lit(0))
    plan = plan.select("__r", "__s", F.col("bucket").alias("__b"), "__base", F.greatest(ahead, F.lit(0)).alias("__ups"))
    named = targets.select(
        F.col("source").alias("__of"), F.col("rank").alias("__rank"), "source_size", "target"
    )
    if targets.count() <= FEW_SOURCES:  # else each document would be shuffled by its source
        named = F.broadcast(named)
    rows = docs.withColumns({"__size": size, "__turn": turn}).withColumn("__bucket", F.pmod("__turn", F.lit(buckets)).cast("int")).join(named, F.col(source_col).eqNullSafe(F.col("__of")))
    rows = rows.join(plan, (F.col("__rank") == F.col("__r")) & (F.col("__size") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    place = F.row_number().over(Window.partitionBy("__rank", "__size", "__bucket").orderBy("__turn", id_col))
    copies = F.col("__base") + (place <= F.col("__ups")).cast("long")
    return (
        rows.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("__size"))
        .select(*docs.columns, *made)
    )
