"""A durable log by aggregate: sequences, replay with divergence, claims, reads that go live, refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def publish(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new (arrival, id, aggregate, data) as rows of the log (aggregate, seq, id, data), numbered on from each aggregate's last; and refused repeats of an id (id)."""
    known = log.select("id").distinct()
    first = F.row_number().over(Window.partitionBy("id").orderBy("arrival"))
    rows = new.withColumn("__n", first)
    fresh = rows.filter("__n = 1").join(known, "id", "left_anti")
    last = log.groupBy("aggregate").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("aggregate").orderBy("arrival"))
    out = fresh.withColumn("place", place).join(last, "aggregate", "left").select("aggregate", (F.coalesce("last", F.lit(-1)) + F.col("place")).alias("seq"), "id", "data")
    refused = rows.filter("__n > 1").select("id").union(rows.filter("__n = 1").join(known, "id", "left_semi").select("id"))
    return out, refused.distinct()


def replay(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (aggregate, seq, id, data) with what a replay does: ``append`` the next ones, ``skip`` what is there,
    refuse ``divergent`` rows and those after a ``gap``."""
    held = log.select("aggregate", "seq", F.struct("id", "data").alias("held"))
    last = log.groupBy("aggregate").agg(F.max("seq").alias("last"))
    rows = incoming.join(held, ["aggregate", "seq"], "left").join(last, "aggregate", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    ahead = F.col("held").isNull()
    place = F.sum(F.when(ahead, 1).otherwise(0)).over(Window.partitionBy("aggregate").orderBy("seq"))
    what = F.when(~ahead & F.col("held").eqNullSafe(F.struct("id", "data")), "skip").when(~ahead, "divergent").when(F.col("seq") == F.col("last") + place, "append").otherwise("gap")
    return rows.select("aggregate", "seq", "id", what.alias("what"))


def read_then_live(log: DataFrame, live: DataFrame, after: int) -> DataFrame:
    """(aggregate, part, seq, id): the history after a sequence number, one marker at its end, then live rows beyond it."""
    mark = log.groupBy("aggregate").agg(F.max("seq").alias("seq"))
    history = log.filter(F.col("seq") > after).select("aggregate", F.lit(0).alias("part"), "seq", "id")
    synced = mark.select("aggregate", F.lit(1).alias("part"), "seq", F.lit("synced").alias("id"))
    beyond = live.join(mark.withColumnRenamed("seq", "mark"), "aggregate", "left").filter("mark is null or seq > mark").select("aggregate", F.lit(2).alias("part"), "seq", "id")
    return history.unionByName(synced).unionByName(beyond)


def claim(asks: DataFrame) -> DataFrame:
    """asks (stream, writer, at) with whether the claim holds: the first asker's does, and every later one of that writer; no other's."""
    first = asks.groupBy("stream").agg(F.min_by("writer", F.struct("at", "writer")).alias("owner"))
    return asks.join(first, "stream").select("stream", "writer", "at", (F.col("writer") == F.col("owner")).alias("granted"))


def append_mail(mail: DataFrame, new: DataFrame) -> DataFrame:
    """new (box, arrival, body) with sequence numbers that go on from those of each box (box, seq)."""
    last = mail.groupBy("box").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("box").orderBy("arrival"))
    return new.withColumn("place", place).join(last, "box", "left").select("box", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("seq"), "body")


def record_flight(events: DataFrame, now: str) -> DataFrame:
    """events (session, at, tool) as lines of the flight log, with the time of arrival where they have none."""
    at = F.coalesce("at", F.lit(now).cast("timestamp"))
    return events.select("session", F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "tool")).alias("line"))


def refreshes(asks: DataFrame, length: int) -> DataFrame:
    """(key, started): when a refresh of some length starts, for asks (key, at) in whole seconds: one runs, one waits, further asks join the waiting one.

    A run begins at an ask while none runs, or when the last one ends, if any ask
    came while it ran. The asks of one key are folded in order.
    """
    ordered = asks.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    start = F.struct(F.lit(None).cast("long").alias("end"), F.lit(False).alias("waits"), F.array().cast("array<long>").alias("runs"))

    def step(s, at):
        idle = s["end"].isNull()
        over = ~idle & (at >= s["end"])  # the run is over, and so is the waiting one's start
        second = over & s["waits"]
        late = second & (at >= s["end"] + length)
        end = F.when(idle | (over & ~s["waits"]) | late, at + length).when(second, s["end"] + length).otherwise(s["end"])
        runs = F.when(idle | (over & ~s["waits"]), F.concat(s["runs"], F.array(at))).when(late, F.concat(s["runs"], F.array(s["end"], at))).when(second, F.concat(s["runs"], F.array(s["end"]))).otherwise(s["runs"])
        waits = F.when(idle | (over & ~s["waits"]) | late, F.lit(False)).otherwise(F.lit(True))
        return F.struct(end.alias("end"), waits.alias("waits"), runs.alias("runs"))

    folded = ordered.select("key", F.aggregate("ats", start, step, lambda s: F.when(s["waits"], F.concat(s["runs"], F.array(s["end"]))).otherwise(s["runs"])).alias("runs"))
    return folded.select("key", F.explode("runs").alias("started"))
