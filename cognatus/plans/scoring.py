"""How similar each member of a group is to the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cognatus.functions import similarity
from cognatus.session import materialize


def peer_pairs(members: DataFrame) -> DataFrame:
    """Unordered pairs ``(component, sha_a, sha_b)`` within the components of ``(sha, component)``."""
    a = members.select(F.col("sha").alias("sha_a"), "component")
    b = members.select(F.col("sha").alias("sha_b"), F.col("component").alias("__c"))
    return a.join(b, (F.col("component") == F.col("__c")) & (F.col("sha_a") < F.col("sha_b"))).drop("__c")


@F.arrow_udf(DoubleType())
def _rounded_mean(total: pa.Array, count: pa.Array) -> pa.Array:
    """Rounded half to even on the binary value, to four places."""
    return pa.array([round(t / n, 4) for t, n in zip(total.to_pylist(), count.to_pylist(), strict=True)], pa.float64())


#: Distinct diffs of a component that a tile holds, and their characters, about: tiles are alike in cost, so the largest component is no longest task.
TILE, TILE_CHARS = 256, 400_000
#: So many short diffs count as one of a tile's: pairs of them cost a few hundredths of a microsecond.
SHORT_DIFFS = 16


def _ratios(text: str, packed: list[tuple[int, similarity.Packed]], texts: list[str]) -> list[float]:
    """The ratios of a diff to those of a tile, packed; pairs that differ little are compared by themselves, past their common ends."""
    out = [0.0] * len(texts)
    for first, pack in packed:
        rest = []
        for k, other in enumerate(pack.texts, first):
            if not text or not other:
                out[k] = float(text == other)
            elif 2 * sum(ends := similarity.common_ends(text, other)) >= min(len(text), len(other)):
                out[k] = similarity.ratio_of(text, other, similarity.lcs_length(text, other, ends))
            else:
                rest.append(k)
        if 3 * len(rest) > len(pack.texts):
            lengths = pack.lcs_lengths(text)
            for k in rest:
                out[k] = similarity.ratio_of(text, texts[k], lengths[k - first])
        else:
            for k in rest:
                out[k] = similarity.indel_ratio(text, texts[k])
    return out


def _tile_sums(left: list[tuple], right: list[tuple] | None) -> dict[str, float]:
    """Per key, the ratios to the other diffs of two tiles (or within one), weighted by how many members have each.

    A row is ``(key, diff, n)``; sums go from the least key to the greatest. Short diffs are compared with one another a numpy
    row at a time, the rest with each other and with the short ones, packed.
    """
    sums: dict[str, float] = {}
    short = lambda rows: [row for row in rows if len(row[1]) <= similarity.WORD]
    long = lambda rows: [row for row in rows if len(row[1]) > similarity.WORD]
    parts = [_long_sums(long(left), long(right) if right is not None else None), _short_sums(short(left), short(right) if right is not None else None)]
    parts += [_long_sums(long(left), short(left if right is None else right))]
    parts += [_long_sums(long(right), short(left))] if right is not None else []
    for part in parts:
        for key, s in part.items():
            sums[key] = sums.get(key, 0.0) + s
    return sums


def _short_sums(left: list[tuple], right: list[tuple] | None) -> dict[str, float]:
    left, right = (rows and sorted(rows, key=lambda row: row[1]) for rows in (left, right))
    others = left if right is None else right
    if not left or not others:
        return {}
    weight = lambda rows: np.array([n for _, _, n in rows], np.float64)
    own, met = np.zeros(len(left)), np.zeros(len(others))
    n, m = weight(left), weight(others)
    for j in range(0, len(left), similarity.WORDS):
        # within a tile, what is before these columns has met them as its own columns' others
        first = j if right is None else 0
        columns = [row[1] for row in left[j : j + similarity.WORDS]]
        for i, _, ratios in similarity.word_ratios(columns, [row[1] for row in others[first:]]):
            rows, at = slice(first + i, first + i + len(ratios)), slice(j, j + ratios.shape[1])
            if right is None and first + i < j + ratios.shape[1]:
                ratios *= np.arange(first + i, first + i + len(ratios))[:, None] > np.arange(j, j + ratios.shape[1])
            own[at] += np.einsum("ij,i->j", ratios, m[rows])
            met[rows] += np.einsum("ij,j->i", ratios, n[at])
    if right is None:
        own += met
        return {row[0]: s for row, s in zip(left, own.tolist(), strict=True)}
    return {row[0]: s for rows, total in ((left, own), (right, met)) for row, s in zip(rows, total.tolist(), strict=True)}


def _long_sums(left: list[tuple], right: list[tuple] | None) -> dict[str, float]:
    terms: dict[str, list[tuple[str, float]]] = {}
    if not left or right == []:
        return {}
    if right is None:
        left = sorted(left, key=lambda row: len(row[1]))
    texts = [diff for _, diff, _ in left]
    packed = similarity.packs(texts)
    for at, (other, text, m) in enumerate(left if right is None else right):
        some = texts[:at] if right is None else texts
        ratios = _ratios(text, [p for p in packed if p[0] < len(some)], texts)
        for (key, _, n), ratio in zip(left, ratios[: len(some)], strict=False):
            terms.setdefault(key, []).append((other, ratio * m))
            terms.setdefault(other, []).append((key, ratio * n))
    return {key: sum(x for _, x in sorted(own)) for key, own in terms.items()}


def group_similarity(members: DataFrame, diffs: DataFrame, tile: int = TILE, chars: int = TILE_CHARS, prefix: int | None = None) -> DataFrame:
    """``(sha, similarity)`` for the members of components of two or more.

    The mean ratio of the member's diff to its peers', to four places. Diffs are compared whole, or their first ``prefix`` characters. Members with equal
    diffs are compared once: a component's distinct diffs are compared, weighted by how many
    members have each, so a component of copies costs one row and no pair. A component of more
    than ``tile`` distinct diffs (``SHORT_DIFFS`` times as many, if short), or more than ``chars`` characters, is dealt to tiles; a diff travels once to each pair of tiles
    it is in, never once a pair of diffs.
    """
    diff = F.coalesce("diff" if prefix is None else F.substring("diff", 1, prefix), F.lit(""))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = members.join(sizes, "component")  # no diff of a commit that is alone is moved
    rows = members.join(diffs.select("sha", "diff"), "sha", "left").select("sha", "component", "size", diff.alias("diff"))
    rows = materialize(rows.withColumn("key", F.sha2("diff", 256)), "diffs", compression="zstd")
    lengths = rows.groupBy("component", "key", "size").agg(F.count(F.lit(1)).alias("n"), F.first(F.length("diff")).alias("length"))
    lengths = materialize(lengths, "kinds")
    wide = lengths.groupBy("component").agg(F.count(F.lit(1)).alias("kinds"), F.sum("length").alias("chars"), F.sum((F.col("length") <= similarity.WORD).cast("long")).alias("short")).where("kinds > 1")
    texts = rows.groupBy("component", "key").agg(F.count(F.lit(1)).alias("n"), F.first("diff").alias("diff"))
    kinds = texts.join(wide, "component")
    weight = F.col("kinds") - F.col("short") + F.col("short") / F.lit(SHORT_DIFFS)
    tiles = F.greatest(F.ceil(weight / F.lit(tile)), F.least(F.ceil(F.col("chars") / F.lit(chars)), F.col("kinds")))
    dealt = kinds.withColumn("t", tiles.cast("int"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("t")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    dealt = dealt.select("component", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "key", "diff", "n")

    def compare(table: pa.Table) -> pa.Table:
        i, j, component = (table.column(c)[0].as_py() for c in ("i", "j", "component"))
        some = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "diff", "n", "salt")), strict=True))
        left = [row[:3] for row in some if row[3] == i]
        right = [row[:3] for row in some if row[3] == j] if i != j else None
        sums = _tile_sums(left, right)
        return pa.table({"component": pa.array([component] * len(sums), pa.string()), "key": pa.array(list(sums), pa.string()), "s": pa.array(list(sums.values()), pa.float64())})

    # by number, so that partitions small in bytes are not merged: their work is not
    dealt = dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "i", "j")
    sums = dealt.groupBy("component", "i", "j").applyInArrow(compare, "component string, key string, s double")
    sums = sums.groupBy("component", "key").agg(F.sum("s").alias("s"))
    scored = lengths.join(sums, ["component", "key"], "left")
    mean = _rounded_mean(F.coalesce("s", F.lit(0.0)) + (F.col("n") - 1).cast("double"), F.col("size") - 1)
    scored = scored.select("component", "key", mean.alias("similarity"))
    return rows.select("sha", "component", "key").join(scored, ["component", "key"]).select("sha", "similarity")
