"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, stage, table

#: Rows of a shard that are put in their last order together, about.
BLOCK_ROWS = 4096
#: Writer options of the permuted copy, which holds whole rows.
COMPACT = {"compression": "zstd"}
#: Shifts of monotonically_increasing_id: the partition stands above, the row within it below.
ROW_BITS = 33


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from a hash of parts: the same on every retry."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def drawn(take: Column, mark: Column, of: Column, *key: Column) -> Column:
    """One hypergeometric draw: how many of `take` rows, drawn from `of`, are among the `mark` marked ones.

    The probabilities' ratios are followed upwards over the support, or over ten standard deviations and 20 about the mode,
    beyond which less than 2**-53 lies; each value replaces the pick with its share of the sum so far, so that one pass
    draws in proportion without a normalising constant. key names the draw; each value's random number is a hash of it.
    """
    d = lambda c: c.cast("double")
    low, high = F.greatest(F.lit(0).cast("long"), take + mark - of), F.least(take, mark)
    mode = F.floor((d(take) + 1) * (d(mark) + 1) / (d(of) + 2)).cast("long")
    variance = d(take) * d(mark) / d(of) * (1 - d(mark) / d(of)) * (d(of) - d(take)) / F.greatest(d(of) - 1, F.lit(1.0))
    reach = (F.lit(10) * F.sqrt(F.greatest(variance, F.lit(0.0)))).cast("long") + 20
    values = F.sequence(F.greatest(low, mode - reach), F.least(high, mode + reach))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("pick"))

    def step(now: Column, k: Column) -> Column:
        total = now["sum"] + now["w"]
        ratio = d(mark - k) * d(take - k) / (d(k + 1) * d(of - mark - take + k + 1))
        # Above the support's end the ratio is 0 / x or is not asked for; low keeps the divisor positive.
        return F.struct((now["w"] * ratio).alias("w"), total.alias("sum"), F.when(uniform(*key, k) * total < now["w"], k).otherwise(now["pick"]).alias("pick"))

    return F.when((of <= 0) | (take <= 0) | (mark <= 0), F.lit(0).cast("long")).otherwise(F.aggregate(values, start, step, lambda x: x["pick"]))


def dealt(rows: Column, seats: Column, *key: Column) -> Column:
    """Counts, one for each of seats, of `rows` rows that take seats at random out of all: a multivariate hypergeometric draw."""
    zero = F.lit(0).cast("long")
    total = F.aggregate(seats, zero, lambda a, x: a + x)
    start = F.struct(rows.alias("rows"), total.alias("of"), F.array().cast("array<bigint>").alias("out"))

    def step(now: Column, at: Column) -> Column:
        # A struct held in an array of one binds the draw, which is used three times.
        mark = F.element_at(seats, at)
        one = F.transform(F.array(drawn(now["rows"], mark, now["of"], *key, at)), lambda x: F.struct((now["rows"] - x).alias("rows"), (now["of"] - mark).alias("of"), F.concat(now["out"], F.array(x)).alias("out")))
        return one[0]

    return F.aggregate(F.sequence(F.lit(1), F.size(seats)), start, step, lambda x: x["out"])


def dealt_in_turn(counts: Column, seats: Column, *key: Column) -> Column:
    """For each struct (id, n) of counts, in order, struct (id, n, seats): n rows of it take seats out of those the former ones left."""
    start = F.struct(seats.alias("left"), F.array().cast("array<struct<id:bigint,n:bigint,seats:array<bigint>>>").alias("out"))

    def step(now: Column, part: Column) -> Column:
        taken = F.transform(F.array(dealt(part["n"], now["left"], *key, part["id"])), lambda x: F.struct(F.zip_with(now["left"], x, lambda a, b: a - b).alias("left"), F.concat(now["out"], F.array(F.struct(part["id"].alias("id"), part["n"].alias("n"), x.alias("seats")))).alias("out")))
        return taken[0]

    return F.aggregate(counts, start, step, lambda x: x["out"])


def even_sizes(rows: Column, shards: int) -> Column:
    """Sizes of shards 0 to shards - 1, at most one apart, larger ones first."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(rows / shards).cast("long") + F.when(s < rows % shards, 1).otherwise(0))


def communication_matrix(counts: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """(part, seats): of partition part's rows, how many go to each shard. counts: (part, n), one row a partition.

    Two levels: groups of about the square root of the number of partitions draw their sums in one row, then each group
    deals its sums to its partitions in a row of its own, in parallel. A row holds as many numbers as there are groups, or
    partitions in a group, times shards; none depends on how many rows there are.
    """
    sized = counts.select(F.col("part").cast("long").alias("part"), F.col("n").cast("long").alias("n"))
    parts = max(1, sized.count())
    width = max(1, round(parts**0.5))
    groups = sized.groupBy((F.col("part") % width).alias("group")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("part").alias("id"), "n"))).alias("parts"))
    total = groups.agg(F.array_sort(F.collect_list(F.struct(F.col("group").alias("id"), "n"))).alias("groups"), F.sum("n").alias("n"))
    sums = total.select(F.inline(dealt_in_turn(F.col("groups"), even_sizes(F.col("n"), shards), F.lit(seed), F.lit(0)))).select(F.col("id").alias("group"), "seats")
    each = groups.join(sums, "group").repartition("group")
    return each.select(F.inline(dealt_in_turn(F.col("parts"), F.col("seats"), F.lit(seed), F.lit(1)))).select(F.col("id").alias("part"), "seats")


def shuffle_to_shards(docs: DataFrame, shards: int = 24, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with columns shard (0 to shards - 1) and slot (0 to the shard's size - 1): a uniform random order, cut into exact sizes.

    Each partition is put in random order and written; a matrix of exact counts, drawn as a uniform shuffle would make them,
    says how many of its first rows go to shard 0, how many of the next to shard 1, and so on; rows are exchanged once, and
    each shard is put in random order again. Sizes of shards are at most one apart. A shard's last order is made in blocks of
    about block_rows rows: a row's random number picks its block, counts of the smaller blocks give the block's first slot, so
    no task holds a shard. The numbers come from hashes of the seed and of a row's place in the written copy, so a lost
    executor changes nothing; another partitioning of the input gives another shuffle.

    Rows are dealt one by one whatever they hold: null and repeated ids, nulls, equal and very long texts make no difference.
    An empty table gives no rows, and fewer rows than shards leave shards empty. Where docs has a column of the name shard or
    slot, that one is kept and the new one gets underscores before its name.
    """
    at, part, rank, block, u = (free_name(docs, c) for c in ("_at", "_part", "_rank", "_block", "_u"))
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    key = free_name(docs, "_key")
    mixed = docs.withColumn(key, F.rand(seed)).sortWithinPartitions(key).drop(key).withColumn(at, F.monotonically_increasing_id())
    mixed = stage(mixed, "permuted", COMPACT)
    place = mixed.select(F.shiftright(at, ROW_BITS).alias("part"))
    matrix = stage(communication_matrix(place.groupBy("part").agg(F.count("*").alias("n")), shards, seed), "matrix")
    # ends: for each shard, the rank in the partition at which its rows end.
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("seats", 1, s), F.lit(0).cast("long"), lambda a, x: a + x))
    ends, sizes = free_name(docs, "_ends"), free_name(docs, "_n")
    bounds = matrix.select(F.col("part").alias(part), upto.alias(ends))
    row_no = (1 << ROW_BITS) - 1

    def placed(rows: DataFrame) -> DataFrame:
        own = rows.withColumns({part: F.shiftright(at, ROW_BITS), rank: F.col(at).bitwiseAND(row_no), u: uniform(F.lit(seed), F.lit(2), F.col(at))})
        own = own.join(bounds, part).withColumn(shard, F.size(F.filter(ends, lambda e: e <= F.col(rank))))
        return own.drop(part, rank, ends)

    totals = matrix.select(F.posexplode("seats").alias(shard, "n")).groupBy(shard).agg(F.ceil(F.sum("n") / block_rows).alias(sizes)).where(F.col(sizes) > 0)
    in_block = F.floor(F.col(u) * F.col(sizes)).cast("long").alias(block)
    counted = placed(mixed.select(at)).join(F.broadcast(totals), shard).groupBy(shard, in_block).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = free_name(docs, "_first")
    firsts = stage(counted.select(shard, block, before.alias(first)), "firsts")
    out = placed(mixed).join(F.broadcast(totals), shard).withColumn(block, F.floor(F.col(u) * F.col(sizes)).cast("long"))
    out = out.withColumn(slot, F.row_number().over(Window.partitionBy(shard, block).orderBy(u, at)).cast("long") - 1)
    out = out.join(firsts, [shard, block]).withColumn(slot, F.col(slot) + F.col(first))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], shard, slot)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 11, block_rows: int = BLOCK_ROWS) -> None:
    """shuffle_to_shards as Parquet in a folder a shard, each file in the order of slot. shard and slot must be new names."""
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column shard or slot")
    out = shuffle_to_shards(docs, shards, seed, block_rows)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffle of whole documents; law `rows`, as a uniform shuffle of exact sizes has no groups and no key."""
    out = shuffle_to_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op11_shuffle_shards": op11_shuffle_shards}
#: The numbers are random, so there is no SQL for them; tests check law, sizes, slots and uniformity.
ORACLE: dict[str, str] = {}
