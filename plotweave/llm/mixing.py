"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words by weight, at most `most` times its size, the excess reshared
(water-filling). A document is then wanted target/size times: a whole number of copies and a
fraction. Fractions are rounded together: two documents with fractions p and q and sizes s and t
move words from one to the other, by chance, until one fraction is 0 or 1, while s*p + t*q stays;
chances are such that no document's expectation changes, but for a source's very last fraction, which
goes to the nearer side, copies of smaller documents making up for what that misses. Tasks pair the documents of a hashed
bucket; each bucket leaves one residual fraction, and buckets combine by a reduction tree of fixed
fan-in, so that at last a source misses its target by less than one document, a small one
wherever the smaller documents have room for what a large one's rounding moves.

All chances come from hashes of the seed and the document, so reruns agree however Spark cuts the
input. Defined cases: a null or blank text has size 0 and is taken with 0 words; a null source is
a source, the last; rows that repeat a document id count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import fresh, settle

BUCKET_ROWS = 4_000
FAN_IN = 64


def word_count(text: Column) -> Column:
    """Runs of other characters than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, total_share: float = 1.0) -> DataFrame:
    """source, source_size, source_rows, target: sources by code point, null last, take the weights in turn.

    One row per source from here on. Sources at their cap are those whose cap per weight is least;
    with them in that order, the common level of the others follows from running sums.
    """
    sizes = sized.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    everything = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    upto = by_cap.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    lined = weighed.withColumn("cap", most * F.col("source_size")).withColumn("all", total_share * F.sum("source_size").over(everything)).withColumn("level", level)
    # The first source that stays below its cap at the level of its turn sets the level of all after it.
    settled = lined.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    return settled.select(source, "source_size", "source_rows", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _chance(key: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit key."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pivot(size: np.ndarray, fraction: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Rounds fractions in order; returns them with at most one left between 0 and 1, and where that one is."""
    out, open_at = fraction.copy(), None
    for j in np.flatnonzero((fraction > 0) & (fraction < 1)).tolist():
        if open_at is None:
            open_at = j
            continue
        i = open_at
        p, q, s, t = out[i], out[j], size[i], size[j]
        to_i, to_j = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)  # words that i, or j, may gain
        moved = to_i if chance[j] * (to_i + to_j) < to_j else -to_j
        out[i], out[j] = p + moved / s, q - moved / t
        open_at = None
        for k in (i, j):
            if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                out[k] = round(out[k])
            else:
                open_at = k
    return out, open_at


def settle_against(size: np.ndarray, out: np.ndarray, i: int, rest: np.ndarray, chance: float) -> bool:
    """Makes i integral at once, its words coming from or going to all of `rest` in shares; False where they can't take them.

    With chance p the fraction p becomes 1 and the others give (1-p)*size, else it becomes 0 and they
    get p*size, in the same shares: nobody's expectation changes.
    """
    p, s, q, t = out[i], size[i], out[rest], size[rest]
    room = np.minimum(q * t / ((1 - p) * s), (1 - q) * t / (p * s))
    if room.sum() < 1:
        return False
    share = room / room.sum() * s / t
    up = chance < p
    moved = q - (1 - p) * share if up else q + p * share
    out[rest] = np.where((moved < 1e-9) | (moved > 1 - 1e-9), np.round(moved), moved)
    out[i] = float(up)
    return True


def pivot_by_halves(size: np.ndarray, fraction: np.ndarray, chance: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, int | None]:
    """`pivot` for rows by descending size: the larger half first, then half of what follows, and so on.

    The fraction that a half leaves is settled against all smaller rows, so the last one is a small row's.
    """
    out, open_at, at = fraction.copy(), None, 0
    live = np.flatnonzero((fraction > 0) & (fraction < 1))
    while at < len(live):
        stop = at + max(1, (len(live) - at) // 2)
        part = np.array([*([] if open_at is None else [open_at]), *live[at:stop].tolist()])
        out[part], left = pivot(size[part], out[part], chance[part])
        open_at, rest = None if left is None else int(part[left]), live[stop:]
        rest = rest[(out[rest] > 0) & (out[rest] < 1)]
        if open_at is not None and len(rest) and settle_against(size, out, open_at, rest, other[open_at]):
            open_at = None
        at = stop
    return out, open_at


def close_up(size: np.ndarray, fraction: np.ndarray, out: np.ndarray, left: int) -> None:
    """Rounds the last fraction to the nearer side; other rows that fit into what it misses flip, the larger first."""
    out[left] = float(out[left] >= 0.5)
    missing = float(((fraction - out) * size).sum())
    for k in np.flatnonzero((fraction > 0) & (fraction < 1)).tolist():
        gain = size[k] * (1 - 2 * out[k])  # what flipping row k brings
        if k != left and abs(missing - gain) < abs(missing):
            out[k], missing = 1 - out[k], missing - gain


def _round_group(level: int, seed: int, last: bool):
    def run(key, table):
        # Large documents first: the fraction that is left in the end then belongs to a small one.
        order = np.lexsort([table.column("tie").to_numpy(), table.column("key").to_numpy(), -table.column("size").to_numpy()])
        table = table.take(pa.array(order))
        size, fraction = table.column("size").to_numpy().astype(float), table.column("fraction").to_numpy()
        keys = table.column("key").to_numpy()
        out, left = pivot_by_halves(size, fraction, _chance(keys, seed + 1000 * level), _chance(keys, seed + 1000 * level + 500))
        if last and left is not None:
            close_up(size, fraction, out, left)
        return table.set_column(table.schema.get_field_index("fraction"), "fraction", pa.array(out))

    return run


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, total_share: float = 1.0, seed: int = 7, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, row_key, size, source_size, target, copies: how often the mix takes each row.

    row_key, doc_id and source tell which row is meant; rows that are equal in these are interchangeable.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"))
    return _copies(settle(sized, "sizes"), weights=weights, most=most, total_share=total_share, seed=seed, bucket_rows=bucket_rows, fan_in=fan_in)


def _copies(sized: DataFrame, *, weights, most, total_share, seed, bucket_rows, fan_in) -> DataFrame:
    targets = settle(source_targets(sized, weights=weights, most=most, total_share=total_share), "targets")
    # Equal rows of one key are told apart by a number, so that each gets its own rounding.
    wanted = (
        sized.withColumn("tie", F.row_number().over(W.partitionBy("row_key", "doc_id", "source").orderBy("size")))
        .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
    )
    # Buckets of a source: a power of two, so that each has about bucket_rows rows.
    parts = F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("source_rows") / bucket_rows)))
    buckets = F.pow(F.lit(2.0), parts).cast("long")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times + F.lit(1e-12))
    wanted = wanted.select("doc_id", "source", "row_key", buckets.alias("buckets"), "tie", "size", "source_size", "target", whole.alias("whole"), F.when(F.col("size") > 0, F.greatest(times - whole, F.lit(0.0))).otherwise(F.lit(0.0)).alias("fraction"))
    schema = "doc_id {d}, source {s}, key long, tie int, size long, source_size long, target double, whole long, buckets long, bucket long, fraction double".format(d=sized.schema["doc_id"].dataType.simpleString(), s=sized.schema["source"].dataType.simpleString())
    state = wanted.withColumn("bucket", F.pmod(F.xxhash64("row_key", "tie", F.lit(seed)), F.col("buckets"))).select("doc_id", "source", F.col("row_key").alias("key"), "tie", "size", "source_size", "target", "whole", "buckets", "bucket", "fraction")
    level, done, most_buckets = 0, [], targets.select(F.max(buckets)).first()[0] or 1
    while True:
        last = most_buckets == 1
        state = settle(state.groupBy("source", "bucket").applyInArrow(_round_group(level, seed, last), schema), f"rounded{level}")
        integral = "fraction = 0 or fraction = 1"
        done.append(state.where(integral))
        if last:
            break
        most_buckets, level = max(1, most_buckets // fan_in), level + 1
        state = state.where(f"not ({integral})").withColumn("buckets", F.greatest(F.lit(1), F.floor(F.col("buckets") / fan_in)).cast("long")).withColumn("bucket", F.pmod("bucket", "buckets"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", F.col("key").alias("row_key"), "tie", "size", "source_size", "target", (F.col("whole") + F.col("fraction").cast("long")).alias("copies"))


def repeat_rows(docs: DataFrame, copies: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents with the columns they came with, each as often as `copies` says.

    Every document has its own number of copies, so documents and numbers meet by id: the one time
    that texts move here, alike for small and large inputs.
    """
    key, mark, origin, number, times, repeat = (fresh(docs.columns, x) for x in ("mix_id", "mix_key", "mix_source", "mix_tie", "mix_copies", "mix_repeat"))
    told = copies.select(F.col("doc_id").alias(key), F.col("row_key").alias(mark), F.col("source").alias(origin), F.col("tie").alias(number), F.col("copies").alias(times)).where(F.col(times) > 0)
    own = F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (own == F.col(mark)) & F.col(f"`{source}`").eqNullSafe(F.col(origin))
    if not copies.where("tie > 1").isEmpty():  # only rows that repeat an id and its text have to be numbered
        place = fresh([*docs.columns, number], "mix_place")
        docs = docs.withColumn(place, F.row_number().over(W.partitionBy(F.col(f"`{doc_id}`"), own, F.col(f"`{source}`")).orderBy(own)))
        same = same & (F.col(place) == F.col(number))
        kept = docs.columns[:-1]
    else:
        kept = docs.columns
    repeated = docs.join(told.hint("merge"), same).withColumn(repeat, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.select(*(F.col(f"`{c}`") for c in kept))
