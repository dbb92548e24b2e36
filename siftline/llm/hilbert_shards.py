"""Shards along a Hilbert curve over several metadata dimensions (operator 2).

Each dimension is quantised into levels of near equal row counts, the levels give a point, the
point's place on the Hilbert curve orders the rows, and the order is cut into runs. Neighbours on
the curve are close in every dimension at once, so each shard's minima and maxima prune well for
filters on any of them. Built of DataFrame functions alone.

The law that holds is ``rows``: shard sizes differ by one row at most. Order within one curve cell
goes by id, checksum and size, so a value shared by any part of the rows is cut like all others:
ranges of rows, not of values, are dealt to tasks.

Defined cases: a null text has size 16 and checksum 0; dimensions are of any type that has an order, nulls come
before all values;
repeated rows are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import discard, materialise

SHARDS = 40
BITS = 5


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hilbert_index(point: Column, dimensions: int, bits: int) -> Column:
    """Place on the curve of an array of ``dimensions`` ints of ``bits`` bits, as a long.

    The axes are turned to the curve's transposed form by exchanging and inverting low bits for
    every bit from the top, then Gray-decoded and interleaved."""
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dimensions)])

    def turn(axes: Column, step: Column) -> Column:
        low = step["q"] - 1
        chosen = F.get(axes, step["i"])
        is_set = chosen.bitwiseAND(step["q"]) != 0
        swap = F.get(axes, F.lit(0)).bitwiseXOR(chosen).bitwiseAND(low)
        moved = lambda v, k: (
            F.when(is_set, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(F.when((k == 0) | (k == step["i"]), v.bitwiseXOR(swap)).otherwise(v))
        )
        return F.transform(axes, moved)

    def interleave(axes: Column) -> Column:
        gray = F.transform(axes, lambda v, k: F.aggregate(F.slice(axes, 1, k + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

        def flip(g: Column) -> Column:
            last = F.element_at(g, -1)
            tail = F.aggregate(
                F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
                F.lit(0),
                lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
            )
            return _let(tail, lambda t: F.transform(g, lambda v: v.bitwiseXOR(t)))

        return _let(
            flip(gray),
            lambda h: F.aggregate(
                F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)]),
                F.lit(0).cast("long"),
                lambda n, q: F.aggregate(h, n, lambda m, v: F.shiftleft(m, 1) + F.when(v.bitwiseAND(q) != 0, F.lit(1)).otherwise(F.lit(0))),
            ),
        )

    return _let(F.aggregate(steps, point, lambda axes, step: turn(axes, step)), interleave)


def cuts(rows: DataFrame, column: str, levels: int) -> tuple[list, bool]:
    """(the least value of each level of ``column``, ascending; whether nulls take a level before those).

    Values of any orderable type are compared whole. A value's level is its share of the rows before it, counted
    over all rows: distinct values are dealt in ranges, counts summed within each and offset by those ahead."""
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the written table fixes which range a value is in: sampled bounds may differ between runs
    dealt = materialise(counts.where("v is not null").repartitionByRange(parts, "v").select("v", "n", F.spark_partition_id().alias("part")))
    total, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col(column).isNull())).first()
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("ahead") + F.coalesce(F.sum("n").over(within), F.lit(0))
    # at most ``parts`` rows of offsets; at most ``levels`` rows reach the driver
    whole = max(1, total - nulls)
    level = F.floor(place * (levels - 1 if nulls else levels) / F.lit(whole)).alias("level")
    least = dealt.join(F.broadcast(offsets), "part").select("v", level).groupBy("level").agg(F.min("v").alias("v")).orderBy("level").collect()
    discard(dealt)
    return [r["v"] for r in least], nulls > 0


def with_curve(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``hilbert``. Levels are cut at quantiles of all rows."""
    kinds = dict(rows.dtypes)

    def level(name: str) -> Column:
        least, nulls = cuts(rows, name, 1 << bits)
        below = F.size(F.filter(F.array(*[F.lit(v).cast(kinds[name]) for v in least]), lambda cut: cut <= F.col(name))) if least else F.lit(0)
        return F.when(F.col(name).isNull(), 0).otherwise(below - (0 if nulls else 1)).cast("int")

    return rows.withColumn("hilbert", hilbert_index(F.array(*[level(d) for d in dimensions]), len(dimensions), bits))


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, 0 to n-1 in ``order``, and ``total``. Ranges are dealt out and sorted, then
    numbered by each range's offset; the offsets are one row per partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the written table fixes which range a row is in: sampled bounds may differ between runs
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    numbered = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # at most ``parts`` rows
    return numbered.withColumn("place", F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_ahead")


def shards(docs: DataFrame, dimensions: list[str] | None = None, n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *[F.col(c).alias(f"_d_{c}") for c in dimensions or []]
    )
    placed = with_curve(rows, [*[f"_d_{c}" for c in dimensions or []], "size"], bits)
    placed = number_rows(placed.select("doc_id", "size", "text_crc32", "hilbert"), ["hilbert", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"place * {n_shards} div total")
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
