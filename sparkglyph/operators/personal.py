"""What a user's events teach: transitions, their scores, and the decay of word frequencies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the activity score.
HALF_LIFE, TICKS, CEIL, FLOOR, KM = 200.0, 10_000.0, 1.0, 0.05, 1.0 / (1.0 - math.exp(-0.005))
DECAY = 0.9


def steps(events: DataFrame) -> DataFrame:
    """(user_id, tick, prev, w): every event after a user's first, numbered from 0; blank words are no steps."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.where("event_type is not null and event_type <> ''").select("user_id", "ts", "event_id", F.col("event_type").alias("w"), F.lag("event_type").over(order).alias("prev"))
    rows = rows.where("prev is not null")
    return rows.select("user_id", (F.row_number().over(order) - 1).cast("long").alias("tick"), "prev", "w")


def transitions(events: DataFrame) -> DataFrame:
    """(user_id, prev, w, uses, dee, last_tick): 1 for the first use and exp((last - now) / 200) more for each later one."""
    before = F.lag("tick").over(Window.partitionBy("user_id", "prev", "w").orderBy("tick"))
    rows = steps(events).withColumn("gain", F.coalesce(F.exp((before - F.col("tick")) / HALF_LIFE), F.lit(1.0)))
    return rows.groupBy("user_id", "prev", "w").agg(F.count("*").alias("uses"), F.sum("gain").alias("dee"), F.max("tick").alias("last_tick"))


def score(dee: Column, ticks: Column, ceil: float = CEIL, floor: float = FLOOR) -> Column:
    m = F.lit(ceil) - F.lit(ceil - floor) * F.pow(F.lit(1.0) - F.exp(-ticks / TICKS), F.lit(10.0))
    return F.when(dee < 20.0, m + (F.lit(0.5) - m) * (dee / KM)).otherwise(m + (F.lit(1.0) - m) * (F.pow(F.lit(4.0), dee / KM) - 1.0) / 3.0)


def scores(events: DataFrame) -> DataFrame:
    """transitions with the score they have after all of the user's ticks."""
    ticks = steps(events).groupBy("user_id").agg(F.count("*").alias("ticks"))
    return transitions(events).join(ticks, "user_id").withColumn("score", score(F.col("dee"), F.col("ticks")))


def decayed(words: DataFrame, epochs: Column) -> DataFrame:
    """(user_id, w, frequency) after so many epochs; a word at 0 is gone."""
    left = F.floor(F.col("frequency") * F.pow(F.lit(DECAY), epochs)).cast("long")
    return words.withColumn("frequency", left).where("frequency > 0")


def word_frequencies(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.col("event_type").alias("w")).agg(F.count("*").alias("frequency"))


def double_events(events: DataFrame, gap_s: float) -> DataFrame:
    """Events that repeat the user's one before, less than `gap_s` after it (times without a zone count as the session's)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("before", F.lag("event_type").over(order)).withColumn("at", F.lag("ts").over(order))
    gap = F.timestamp_diff("MICROSECOND", F.col("at"), F.col("ts"))
    return rows.where((F.col("before") == F.col("event_type")) & (gap >= 0) & (gap < int(gap_s * 1_000_000))).select("user_id", "event_id", "event_type", gap.alias("gap_us"))


def metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"))


def recorded(events: DataFrame, most: int = 20) -> DataFrame:
    """transitions as they are recorded one by one: after each, of a word's followers beyond `most` the one with the least
    `dee` goes (the latest of equals), and comes back as new. One pass over each user's events in order, which stream
    through a worker; it holds one user's followers at a time."""
    schema = pa.schema([("user_id", pa.int64()), ("prev", pa.string()), ("w", pa.string()), ("dee", pa.float64()), ("last_tick", pa.int64())])

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, tick, held = None, 0, {}

        def rows() -> pa.RecordBatch:
            flat = [(user, p, w, d, t) for p, own in held.items() for w, (d, t) in own.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [[]] * 5, schema, strict=True)], schema=schema)

        for batch in batches:
            for who, prev, w in zip(*(batch.column(c).to_pylist() for c in ("user_id", "prev", "w")), strict=True):
                if who != user:
                    yield rows()
                    user, tick, held = who, 0, {}
                own = held.setdefault(prev, {})
                dee, last = own.get(w, (0.0, tick))
                own[w] = (dee + math.exp((last - tick) / HALF_LIFE), tick)
                if len(own) > most:
                    least = min(d for d, _ in own.values())
                    del own[[x for x, (d, _) in own.items() if d == least][-1]]
                tick += 1
        yield rows()

    ordered = steps(events).where("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), "tick", "prev", "w").repartition("user_id").sortWithinPartitions("user_id", "tick")
    return ordered.mapInArrow(record, "user_id long, prev string, w string, dee double, last_tick long")


def daily_decay(events: DataFrame, most: int = 5000) -> DataFrame:
    """(user_id, w, frequency): what is left of each word's uses after one epoch a day since its last one, up to the last day
    of all; a word at 0 is gone, and beyond `most` words of a user the least frequent ones."""
    day = F.datediff(F.col("ts"), F.lit("1970-01-01"))
    words = events.groupBy("user_id", F.col("event_type").alias("w")).agg(F.count("*").alias("frequency"), F.max(day).alias("day"))
    left = decayed(words.join(F.broadcast(events.agg(F.max(day).alias("now")))), F.col("now") - F.col("day"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("frequency"), "w"))
    return left.withColumn("place", place).where(F.col("place") <= most).select("user_id", "w", "frequency")


def pruned_dictionary(words: DataFrame, most_nodes: int = 50_000, keep: int = 5000) -> DataFrame:
    """(w, count): all words while their prefixes (the nodes of a trie, with its root) are `most_nodes` at most, else the
    `keep` most frequent ones."""
    nodes = prefix_maxima(words).agg((F.count("*") + 1).alias("nodes"))
    top = words.orderBy(F.desc("count"), "w").limit(keep).select("w").withColumn("top", F.lit(True))
    return words.join(F.broadcast(nodes)).join(top, "w", "left").where((F.col("nodes") <= most_nodes) | F.col("top")).select("w", "count")


def prefix_maxima(words: DataFrame) -> DataFrame:
    """(prefix, most): the highest count under each prefix."""
    parts = words.where("w <> ''").select("count", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    return parts.groupBy(F.left("w", F.col("k")).alias("prefix")).agg(F.max("count").alias("most"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """(key, p50, p99, ...): value number floor(share * n), from 0, of each key's values in order. Equal values are counted
    first, so the window is over distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("v"))
    all_of = F.sum("n").over(Window.partitionBy(key))
    placed = counts.select(key, "v", upto.alias("upto"), all_of.alias("all"))
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("all") * share), F.col("v"))).alias(f"p{round(100 * share)}") for share in shares])


def two_before(events: DataFrame) -> DataFrame:
    """(user_id, event_id, w1, w2): the two events before each, oldest first; null where there is none."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_id", F.lag("event_type", 2).over(order).alias("w1"), F.lag("event_type", 1).over(order).alias("w2"))
