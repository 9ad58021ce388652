"""Pack items of varying length into containers of fixed capacity, holding a mixture of sources.

1. Items above the capacity are the only ones cut: full containers, and a rest that is packed like an item. Full
   containers are no part of the mixture, and so neither are their tokens: shares and deficits are counted over what is packed.
2. Each source is laid out in hash order, and the place of an item on its source's running total of tokens gives its shard of about
   ``shard_tokens``. So every shard holds each source in proportion, to within an item, whatever the weight of the source.
3. In a shard, deficit round-robin over one queue per source fills windows of ``window`` containers: each round a
   source earns its target share of a quantum and spends it on the head of its queue. What it could not spend, or
   overspent, carries to the next round and window. The deficit a shard starts with is what the sources owe after all shards
   before it: a running sum over (shard, source) totals, so no shard waits for another.
4. An item goes to the open container of its window that leaves least room. Where the head of a queue fits nowhere, the largest
   item of that source that still fits takes its place; a window is closed when no source has one. No container lasts beyond its window.

Only keys, sources and sizes reach Python, never texts. Defined cases: null texts count as empty (their size is the
end token); null sources form one queue; null and repeated keys are packed as separate items; other columns are not read; an empty table gives no rows; sizes of zero or less are an error of the caller and count as 1;
a source without a target share comes after all others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from heapq import heappop, heappush
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.session import cut as materialise

#: Copies of one row that are numbered in one go, and stretches of a source's hash order for each shard.
COPIES, STRETCHES = 4096, 4


def byte_tokens(text: F.Column) -> F.Column:
    """Tokens of the byte-level tokenizer: one for each UTF-8 byte and one end token."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class Queue:
    """Items of one source in order of arrival, and by size."""

    def __init__(self, rows: list[int], sizes: list[int]) -> None:
        self.rows, self.at, self.gone = rows, 0, set()
        self.by_size = sorted((sizes[i], i) for i in rows)

    def head(self) -> int | None:
        while self.at < len(self.rows) and self.rows[self.at] in self.gone:
            self.gone.discard(self.rows[self.at])
            self.at += 1
        return self.rows[self.at] if self.at < len(self.rows) else None

    def fitting(self, room: int) -> int | None:
        """The largest item of at most ``room``."""
        at = bisect_right(self.by_size, (room, len(self.by_size) + (1 << 62))) - 1
        return self.by_size[at][1] if at >= 0 else None

    def take(self, i: int, size: int) -> None:
        self.by_size.pop(bisect_left(self.by_size, (size, i)))
        self.gone.add(i)


def fill_windows(sources: list, sizes: np.ndarray, shares: dict, owed: dict, capacity: int, window: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Window and container of each row, and what each source is owed at the end. ``shares`` are of tokens, by source."""
    lengths = sizes.tolist()
    rows: dict = {}
    for i, s in enumerate(sources):
        rows.setdefault(s, []).append(i)
    order = sorted(rows, key=lambda s: (s is None, str(s)))
    queues = [Queue(rows[s], lengths) for s in order]
    whole = sum(max(0.0, shares.get(s) or 0.0) for s in order) or 1.0
    earns = [max(0.0, shares.get(s) or 0.0) / whole * capacity for s in order]  # of a round's quantum, one container
    credit = [owed.get(s, 0.0) for s in order]
    spent = [0] * len(order)

    def affordable(k: int, size: int) -> float:
        """The round in which source ``k`` can pay for its next item."""
        lacks = size + spent[k] - credit[k]
        return max(0, ceil(lacks / earns[k])) if earns[k] else float("inf")

    heap: list = []
    for k, q in enumerate(queues):
        heappush(heap, (affordable(k, lengths[q.head()]), k))
    windows, boxes = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    number, count, last = 0, 0, 0.0
    while heap:
        rooms = [(capacity, count + j) for j in range(window)]  # sorted by room
        used, waiting = set(), []
        while heap and rooms:
            turn, k = heappop(heap)
            q, most = queues[k], rooms[-1][0]
            i = q.head()
            if lengths[i] > most:
                i = q.fitting(most)
                if i is None:
                    waiting.append((turn, k))
                    continue
            last = max(last, turn) if turn != float("inf") else last
            size = lengths[i]
            room, box = rooms.pop(bisect_left(rooms, (size, -1)))
            q.take(i, size)
            spent[k] += size
            windows[i], boxes[i] = number, box
            used.add(box)
            if room > size:
                insort(rooms, (room - size, box))
            head = q.head()
            if head is not None:
                heappush(heap, (affordable(k, lengths[head]), k))
        for entry in waiting:
            heappush(heap, entry)
        number, count = number + 1, count + window
    # Containers are numbered without gaps.
    _, boxes = np.unique(boxes, return_inverse=True) if len(boxes) else (None, boxes)
    return windows, boxes, {s: credit[k] + earns[k] * last - spent[k] for k, s in enumerate(order)}


def pack(df: DataFrame, key: str, source: str, size: F.Column, capacity: int = 8192, window: int = 64, shard_tokens: int = 1 << 24, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows (key, source, piece_index, piece_count, tokens, shard, window, container).

    ``targets`` are shares of tokens by source; by default the shares the sources have in what is packed. A container is
    identified by (shard, container); the full containers of cut items have negative numbers and no window.
    ``shard_tokens`` bounds what one task holds, about 10,000 items of average length, whatever the size of the data.
    A target that the data can't supply holds in each shard for as long as the source lasts there.
    """
    items = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.greatest(size, F.lit(1)).cast("long").alias("size"))
    # Equal rows are counted before they move and numbered, so no repeated row makes a hot shard. The table is read once, for these columns only.
    items = materialise(items.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    blocks = items.select("key", "source", "size", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("block"))
    items = blocks.select("key", "source", "size", F.explode(F.expr(f"sequence(block * {COPIES}, least(n, (block + 1) * {COPIES}) - 1)")).alias("copy"))
    oversized = items.where(F.col("size") > capacity).withColumn("full", F.expr(f"size div {capacity}")).withColumn("rest", F.col("size") % capacity)
    count = F.col("full") + (F.col("rest") > 0).cast("long")
    full = oversized.select("key", "source", "copy", F.explode(F.expr("sequence(0L, full - 1)")).alias("piece_index"), count.alias("piece_count"), F.lit(capacity).cast("long").alias("tokens"), F.lit(0).alias("shard"), F.lit(None).cast("long").alias("window"))
    full = full.withColumn("container", -1 - F.abs(F.xxhash64("key", "copy", "piece_index") % F.lit(1 << 62))).drop("copy")
    rest = oversized.where("rest > 0").select("key", "source", "copy", F.col("full").alias("piece_index"), count.alias("piece_count"), F.col("rest").alias("size"))
    queue = items.where(F.col("size") <= capacity).select("key", "source", "copy", F.lit(0).cast("long").alias("piece_index"), F.lit(1).cast("long").alias("piece_count"), "size").unionByName(rest)

    # Totals by source and stretch of the hash order; a stretch is a fixed part of a shard, so the number of totals is that of sources times shards.
    total = queue.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    place = F.xxhash64("key", "size", "copy")
    queue = queue.withColumn("place", place).withColumn("stretch", F.pmod(F.shiftright("place", 20), F.lit(shards * STRETCHES)))
    stretches = queue.groupBy("source", "stretch").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("source", "stretch", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("source")).alias("of_source"))
    stretches = stretches.select(F.col("source").alias("s"), F.col("stretch").alias("t"), "before", "of_source")
    within = Window.partitionBy("source", "stretch").orderBy("place", "key", "piece_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = queue.join(stretches, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # Each source begins in a shard of its own, or the first shard would get every source of one item.
    start = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(shards)).cast("double")
    placed = placed.withColumn("shard", F.pmod(F.floor(start + F.col("at") / F.col("of_source") * shards), F.lit(shards)).cast("int"))
    placed = materialise(placed.select("shard", "key", "source", "piece_index", "piece_count", "size", "place"))

    # What each source is owed when a shard begins: its share of all tokens in earlier shards, less what they held of it.
    held = placed.groupBy("shard", "source").agg(F.sum("size").alias("held"))
    supply = held.groupBy("source").agg(F.sum("held").alias("of_source"))
    sizes = held.groupBy("shard").agg(F.sum("held").alias("shard_size"))
    # The running total over shards has one row for each ``shard_tokens`` of data; the one by source is spread by source.
    sizes = sizes.withColumn("earlier", F.coalesce(F.sum("shard_size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    owed = held.withColumn("had", F.coalesce(F.sum("held").over(before), F.lit(0))).join(sizes, "shard")
    owed = owed.join(supply.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    owed = owed.withColumn("supplied", F.col("of_source") / F.lit(float(max(int(total), 1))))
    if targets:
        wanted = df.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "t string, share double")
        owed = owed.join(wanted, F.col("source").eqNullSafe(F.col("t")), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    else:
        owed = owed.withColumn("share", F.col("supplied"))
    # Debts are counted against what there is of a source: a target beyond it would be owed for ever.
    owed = owed.select(F.col("shard").alias("debt_shard"), F.col("source").alias("debt_source"), "share", (F.col("supplied") * F.col("earlier") - F.col("had")).alias("owed"))

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("source", T.StringType()), T.StructField("piece_index", T.LongType()), T.StructField("piece_count", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("window", T.LongType()), T.StructField("container", T.LongType())])

    def run(rows: pd.DataFrame, debts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "key", "piece_index"], kind="stable", ignore_index=True)
        names = [s if isinstance(s, str) else None for s in rows["source"]]
        label = [s if isinstance(s, str) else None for s in debts["debt_source"]]
        share, owe = dict(zip(label, debts["share"], strict=True)), dict(zip(label, debts["owed"], strict=True))
        lengths = rows["size"].to_numpy()
        windows, boxes, _ = fill_windows(names, lengths, share, owe, capacity, window)
        return pd.DataFrame({"key": rows["key"], "source": rows["source"], "piece_index": rows["piece_index"], "piece_count": rows["piece_count"], "tokens": lengths, "shard": rows["shard"], "window": windows, "container": boxes})

    packed = placed.groupBy("shard").cogroup(owed.groupBy("debt_shard")).applyInPandas(run, schema)
    # Keys cross to Python as text: a null among numbers would turn them into floats there.
    return full.unionByName(packed).withColumn("key", F.col("key").cast(df.schema[key].dataType))
