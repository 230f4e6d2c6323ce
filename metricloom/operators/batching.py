"""Request batches, byte-bounded admission and loss counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.operators.prefix import row_numbers
from metricloom.session import settle, stored

BATCH_SIZE = 100
QUEUE_BYTES = 100_000_000
# the longest list of items that one task folds in order
FOLD_ROWS = 1_000
# The loss counters.
LOSS_COUNTERS = ("MetricLost", "InvalidLost", "AlertLost", "Fatal")


def request_batches(datums: DataFrame, flush: str = "10 seconds", slice_width: str = "10 milliseconds",
                    size: int = BATCH_SIZE, keys: tuple[str, ...] = ("queue",)) -> DataFrame:
    """Number the datums of every flush in arrival order and cut them into requests.

    Arrival order is (ts, event_id). A flush is counted slice by slice, so even one flush
    holding a third of the data is spread over tasks.
    """
    flushed = datums.withColumn("flush", F.window("ts", flush)["start"])
    slices = F.window("ts", slice_width)["start"]
    numbered = row_numbers(flushed, [*keys, "flush"], ["ts", "event_id"], slices)
    return numbered.withColumn("batch_id", F.floor((F.col("rn") - 1) / size))


def requests(batched: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per request in sending order: of every flush all metric requests, then all alerts.

    The alerts' offset is the flush's number of metric requests, one small row per flush, so the
    requests of a flush are numbered without sorting them together.
    """
    turn = [*keys, "flush"]
    sent = batched.groupBy(*turn, "queue", "batch_id").agg(F.count(F.lit(1)).alias("datums"))
    metrics = sent.where("queue = 'metric'").groupBy(*turn).agg((F.max("batch_id") + 1).alias("__metrics"))
    offset = F.when(F.col("queue") == "metric", F.lit(0)).otherwise(F.coalesce("__metrics", F.lit(0)))
    return sent.join(metrics, turn, "left").withColumn("request_no", F.col("batch_id") + offset + 1).drop("__metrics")


def datum_text(columns: list[Column]) -> Column:
    return F.concat_ws("|", *columns)


def admit(items: DataFrame, keys: list[str], order: list[str], block: Column, size: str = "size",
          bound: int = QUEUE_BYTES, fold_rows: int = FOLD_ROWS, free: DataFrame | None = None) -> DataFrame:
    """Add ``admitted``: an item enters iff used + size <= bound, a rejected one uses nothing.

    ``free`` (keys, free) has the bytes that are left for keys whose queue isn't empty at first.

    ``order`` is unique within ``keys`` and its last column alone identifies a row there;
    ``block`` never decreases along ``order``. Keys and order hold no nulls.

    The decision is sequential, but it moves in stretches. With ``free`` bytes left, only items of at
    most that size can enter, and all of them do up to the first that no longer fits: block totals
    admit whole blocks unseen, and only the block of that item is scanned. It leaves less free space,
    with which the next stretch begins behind it. A key with no more than ``fold_rows`` items to look at
    is folded in order instead; no list is longer than that.
    """
    item = order[-1]
    place = F.struct(*order)
    rows = stored(items.select(*keys, *order, F.col(size).alias("__size"), block.alias("__block")).where("__size > 0"), "admission")
    place_type = rows.select(place.alias("p")).schema["p"].dataType
    state = rows.select(*keys).distinct().select(
        *keys, F.lit(None).cast(place_type).alias("__after"), F.lit(bound).cast("bigint").alias("__free"))
    if free is not None:
        state = state.join(free, keys, "left").select(*keys, "__after", F.coalesce("free", "__free").alias("__free"))
    stretches, folded = [], []
    while True:
        state = settle(state, "admission-state")
        if state.isEmpty():
            break
        behind = F.col("__after").isNull() | (place > F.col("__after"))
        able = rows.join(state, keys).where(behind & (F.col("__size") <= F.col("__free")))
        blocks = able.groupBy(*keys, "__block").agg(F.sum("__size").alias("__total"), F.count(F.lit(1)).alias("__n"))
        whole, earlier = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        blocks = settle(blocks.withColumns({
            "__before": F.coalesce(F.sum("__total").over(earlier), F.lit(0)), "__left": F.sum("__n").over(whole),
        }), "admission-blocks")
        few = blocks.where(F.col("__left") <= fold_rows).select(*keys).distinct()
        # a key that is folded admits nothing by size alone from here on
        ends = state.join(few.withColumn("__few", F.lit(True)), keys, "left")
        stretches.append(ends.select(*keys, "__after", F.when(F.col("__few"), 0).otherwise(F.col("__free")).alias("__free")))
        folded.append(_fold(able.join(few, keys, "left_semi"), keys, order, item))

        crossing = blocks.where((F.col("__left") > fold_rows)).join(state, keys).where(
            (F.col("__before") <= F.col("__free")) & (F.col("__before") + F.col("__total") > F.col("__free")))
        inside = W.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        scanned = able.join(crossing.select(*keys, "__block", "__before"), [*keys, "__block"]).withColumn(
            "__used", F.col("__before") + F.sum("__size").over(inside))
        state = scanned.where("__used > __free").groupBy(*keys).agg(
            F.min(place).alias("__after"),
            F.min_by(F.col("__free") - F.col("__used") + F.col("__size"), place).alias("__free"))

    if not stretches:
        return items.withColumn("admitted", F.lit(True))
    spans = reduce(DataFrame.unionByName, stretches).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__after", "__free"))).alias("__spans"))
    late = settle(reduce(DataFrame.unionByName, folded), "late-admissions").withColumn("__late", F.lit(True))
    decided = items.join(spans, keys, "left").join(late, [*keys, item], "left")
    # the stretch an item lies in is the last that begins before it; what ended one is out
    begun = F.filter("__spans", lambda s: s["__after"].isNull() | (place > s["__after"]))
    ended = F.exists("__spans", lambda s: F.coalesce(s["__after"] == place, F.lit(False)))
    free = F.array_max(F.transform(begun, lambda s: F.struct(s["__after"], s["__free"])))["__free"]
    enters = (F.col(size) == 0) | F.coalesce("__late", F.lit(False)) | ((F.col(size) <= free) & ~ended)
    return decided.withColumn("admitted", F.coalesce(enters, F.lit(False))).select(*items.columns, "admitted")


def _fold(able: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """The items of short keys that enter, taken one after another."""

    def step(state, one):
        fits = one["size"] <= state["free"]
        return F.struct(
            F.when(fits, state["free"] - one["size"]).otherwise(state["free"]).alias("free"),
            F.when(fits, F.concat(state["taken"], F.array(one["item"]))).otherwise(state["taken"]).alias("taken"),
        )

    listed = able.groupBy(*keys, "__free").agg(F.array_sort(F.collect_list(
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("__size").alias("size"),
                 F.col(item).alias("item"))
    )).alias("__items"))
    item_type = able.schema[item].dataType.simpleString()
    start = F.struct(F.col("__free").alias("free"), F.array().cast(f"array<{item_type}>").alias("taken"))
    return listed.select(*keys, F.explode(F.aggregate("__items", start, step)["taken"]).alias(item))


def loss_counters(events: DataFrame, period: str = "1 minute", prefix: str = "Emitter") -> DataFrame:
    """Four counters per period, zeros included, for every period between first and last event.

    ``events`` has ``ts``, ``route`` and ``lost`` (rejected by the queue).
    """
    counted = events.groupBy(F.window("ts", period)["start"].alias("bucket")).agg(
        F.count_if((F.col("route") == "metric") & F.col("lost")).alias("MetricLost"),
        F.count_if(F.col("route") == "invalid").alias("InvalidLost"),
        F.count_if((F.col("route") == "alert") & F.col("lost")).alias("AlertLost"),
        F.count_if(F.col("route") == "fatal").alias("Fatal"),
    )
    span = counted.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    grid = span.select(F.explode(F.sequence("a", "z", F.expr(f"INTERVAL {period}"))).alias("bucket"))
    dense = grid.join(counted, "bucket", "left").na.fill(0, list(LOSS_COUNTERS))
    return dense.unpivot(["bucket"], list(LOSS_COUNTERS), "counter", "value").withColumns({
        "counter": F.concat(F.lit(f"{prefix}."), F.col("counter")), "value": F.col("value").cast("double"),
    })
