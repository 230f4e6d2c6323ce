"""Streaming jobs that carry state from one micro-batch to the next in the shared folder.

Every epoch reads what the epoch before it left under ``path`` and writes its own folder, so an epoch that is
repeated after a failure finds the same state and leaves one copy. A job started again from its checkpoint goes on
where it was. State older than the epoch before the last is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.operators import batching as B
from metricloom.operators import logs as L
from metricloom.operators.prefix import running
from metricloom.session import discard, settle, stored, temporary_tables
from metricloom.streaming.jobs import start_batches


def _left(batch: DataFrame, path: str, name: str, epoch: int) -> DataFrame | None:
    """What the epoch before left under a name; the first epoch finds nothing."""
    return batch.sparkSession.read.parquet(f"{path}/{name}/epoch={epoch - 1}") if epoch > 0 else None


def _leave(rows: DataFrame, path: str, name: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")


def _forget(batch: DataFrame, path: str, names: tuple[str, ...], epoch: int) -> None:
    if epoch > 1:
        for name in names:
            discard(batch.sparkSession, f"{path}/{name}/epoch={epoch - 2}")


def _begun_since(rows: DataFrame, unclosed: DataFrame, keys: list[str], order: str, ts: str, oldest: Column) -> DataFrame:
    """(keys, first) of the unclosed messages whose first line isn't older. There is one for each key at most, settled first, so
    that few meet the lines where these lie."""
    few = settle(unclosed.select(*keys, "first"), "unclosed")
    begun = rows.select(*keys, F.col(order).alias("first"), F.col(ts).alias("__begun"))
    return begun.join(few, [*keys, "first"]).where(F.col("__begun") >= oldest).select(*keys, "first")


def join_messages(lines: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, ts: str, block: Column,
                  hold: str = "5 minutes", flag: str = "logtag", text: str = "log", most_parts: int = L.MESSAGE_PARTS,
                  coarser=None, trigger: dict | None = None) -> StreamingQuery:
    """Partial lines to messages across micro-batches: ``path/messages`` has each message once.

    Lines of a key come in their order. The lines behind the last closing flag of a key are carried until the message is
    closed, until it is ``hold`` older than the newest line of the stream or until it has ``most_parts`` lines; in the two
    latter cases what there is comes as a message that isn't complete (one of very many lines in numbered
    pieces). So no key carries more than ``most_parts`` lines from epoch to epoch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):
            rows = batch.select(*keys, order, ts, flag, text)
            before = _left(batch, path, "tail", epoch)
            rows = stored(rows if before is None else before.select(*rows.columns).unionByName(rows), "lines")
            clock = rows.agg(F.max(ts)).first()[0]
            seen = _left(batch, path, "clock", epoch)
            known = [t for t in (clock, seen.first()[0] if seen is not None else None) if t is not None]
            clock = max(known) if known else None
            messages = stored(L.join_partial_lines(rows, keys, order, block, flag, text, coarser, most_parts), "messages")
            # a message of very many lines has open pieces before its last; none of them waits
            unclosed = messages.where(~F.col("complete") & (F.col("piece") == 0) & (F.col("parts") < most_parts))
            oldest = F.lit(clock).cast("timestamp_ntz") - F.expr(f"INTERVAL {hold}")
            waiting = stored(_begun_since(rows, unclosed, keys, order, ts, oldest), "waiting")
            done = messages.join(waiting, [*keys, "first"], "left_anti").drop("message_no")
            _leave(done, path, "messages", epoch)
            held = rows.join(waiting.withColumnRenamed("first", "__first"), keys).where(F.col(order) >= F.col("__first"))
            _leave(held.select(*rows.columns), path, "tail", epoch)
            _leave(batch.sparkSession.range(1).select(F.lit(clock).cast("timestamp_ntz").alias("clock")), path, "clock", epoch)
        _forget(batch, path, ("tail", "clock"), epoch)

    return start_batches(lines, write, checkpoint, trigger)


def split_late(rows: DataFrame, path: str, checkpoint: str, ts: str, delay: str, period: str,
               trigger: dict | None = None) -> StreamingQuery:
    """Rows older than the newest event of all earlier micro-batches minus ``delay`` are counted, not dropped unseen.

    ``path/punctual`` and ``path/late`` have the rows, ``path/counts`` both counts for every ``period`` of event time that
    an epoch touches, to be added up. One row, the newest event time so far, is carried. Rows without a time are punctual, in a period that is
    null.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        at = F.col(ts).cast("timestamp_ntz")
        mark = _left(batch, path, "mark", epoch)
        newest = None if mark is None else mark.first()[0]
        late = F.lit(False) if newest is None else F.coalesce(at < F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        marked = batch.withColumn("late", late).persist()
        try:
            _leave(marked.where(~F.col("late")).drop("late"), path, "punctual", epoch)
            _leave(marked.where("late").drop("late"), path, "late", epoch)
            both = [F.count_if(~F.col("late")).alias("punctual"), F.count_if("late").alias("late")]
            # a window leaves out what has no time
            timeless = marked.where(at.isNull()).groupBy(F.lit(None).cast("timestamp_ntz").alias("bucket")).agg(*both)
            counts = marked.groupBy(F.window(at, period)["start"].alias("bucket")).agg(*both)
            _leave(counts.unionByName(timeless), path, "counts", epoch)
            _leave(marked.agg(F.greatest(F.max(at), F.lit(newest).cast("timestamp_ntz")).alias("newest")), path, "mark", epoch)
        finally:
            marked.unpersist()
        _forget(batch, path, ("mark",), epoch)

    return start_batches(rows, write, checkpoint, trigger)


def bounded_queue(items: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], block: Column, size: str,
                  bound: int, drained: int, trigger: dict | None = None) -> StreamingQuery:
    """A queue for each key that lives across flushes: a micro-batch is one turn of its sender.

    Arriving items enter in order as long as the bytes in the queue, those left over included, stay within ``bound``;
    others are lost. Then the sender takes the first ``drained`` items of every queue and the rest waits for the next turn.
    ``path/sent`` and ``path/lost`` have the items, ``path/queue`` what waits. ``order`` grows from turn to turn, its
    last column tells the items of a key apart, and ``block`` never falls along it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):
            before = _left(batch, path, "queue", epoch)
            waiting = batch.limit(0) if before is None else before.select(*batch.columns)
            used = waiting.groupBy(*keys).agg((F.lit(bound) - F.sum(size)).cast("bigint").alias("free"))
            # items of no size always enter
            arrived = stored(batch, "arrived")
            decided = stored(B.admit(arrived, keys, order, block, size, bound, free=used), "decided")
            queue = stored(waiting.withColumn("__turn", F.lit(0)).unionByName(
                decided.where("admitted").drop("admitted").withColumn("__turn", F.lit(1))), "queue")
            # what waited lies before what arrived; places are counted in blocks
            placed = running(queue, keys, ["__turn", *order], F.struct("__turn", block.alias("b")), {
                "__place": F.lit(1).cast("bigint")})
            _leave(placed.where(F.col("__place") <= drained).drop("__turn", "__place"), path, "sent", epoch)
            _leave(placed.where(F.col("__place") > drained).drop("__turn", "__place"), path, "queue", epoch)
            _leave(decided.where(~F.col("admitted")).drop("admitted"), path, "lost", epoch)
        _forget(batch, path, ("queue",), epoch)

    return start_batches(items, write, checkpoint, trigger)


def consume_topic(records: DataFrame, path: str, checkpoint: str, start: dict[int, int] | None = None, partition: str = "partition",
                  offset: str = "offset", trigger: dict | None = None) -> StreamingQuery:
    """Take every record of a partitioned topic once, from the given offsets on.

    ``records`` come with their partition and offset, in any order and as often as they like to be sent again. A record
    below its partition's next offset was taken before, or lies before the offset to ``start`` at (0 where none is
    given). ``path/records`` has the records, ``path/progress`` the next offset of every partition seen so far, a row for
    each; this is all that is carried, so offsets of one partition must not come late by a micro-batch.
    """
    first = F.lit(0).cast("bigint")
    for number, at in (start or {}).items():
        first = F.when(F.col(partition) == number, F.lit(at).cast("bigint")).otherwise(first)

    def write(batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):
            known = _left(batch, path, "progress", epoch)
            arrived = batch.where(F.col(partition).isNotNull() & F.col(offset).isNotNull())
            if known is None:
                due = arrived.withColumn("__next", first)
            else:
                due = arrived.join(known, partition, "left").withColumn("__next", F.coalesce("next", first)).drop("next")
            fresh = stored(due.where(F.col(offset) >= F.col("__next")).drop("__next").dropDuplicates([partition, offset]), "records")
            _leave(fresh.select(*batch.columns), path, "records", epoch)
            reached = fresh.groupBy(partition).agg((F.max(offset) + 1).alias("next"))
            both = reached if known is None else known.select(partition, "next").unionByName(reached)
            _leave(both.groupBy(partition).agg(F.max("next").alias("next")), path, "progress", epoch)
        _forget(batch, path, ("progress",), epoch)

    return start_batches(records, write, checkpoint, trigger)
