"""Target life cycles: transitions, retirement and reuse, command acknowledgement."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lifecycle(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, allowed: Iterable[tuple[str, str]], initial: Iterable[str], retiring: Iterable[str],
    stream_start: bool = True,
) -> DataFrame:
    """Add previous, observations, retired and issues to each observation.

    previous is the status of the observation before, which may be null. Once a retiring status is seen, retired stays true.
    issues, an array: missing_status; invalid_initial, at the first observation if the stream is seen from its start;
    retired_reused, at every observation after a retiring one; else invalid_transition, if the pair isn't allowed (staying is).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = [f"{a}>{b}" for a, b in allowed]
    now = F.col(status)
    gone = F.coalesce(F.max(F.coalesce(now.isin(*retiring), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    df = df.withColumn("previous", F.lag(status).over(w)).withColumn("observations", F.row_number().over(w)).withColumn("__gone", gone)
    first = F.col("observations") == 1
    wrong = (F.col("previous") != now) & ~F.concat_ws(">", "previous", now).isin(*pairs)
    issues = F.array_compact(F.array(
        F.when(now.isNull(), "missing_status"),
        F.when(first & now.isNotNull() & ~now.isin(*initial), "invalid_initial") if stream_start else F.lit(None).cast("string"),
        F.when(F.col("__gone"), "retired_reused").when(wrong, "invalid_transition"),
    ))
    retired = F.col("__gone") | F.coalesce(now.isin(*retiring), F.lit(False))
    return df.withColumn("issues", issues).withColumn("retired", retired).drop("__gone")


def lifecycle_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, retiring: Iterable[str]) -> DataFrame:
    """The last status of each key, how often it was seen, and whether it has ever been retired. Absence doesn't retire."""
    return df.groupBy(*keys).agg(
        F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("observations"),
        F.coalesce(F.max(F.col(status).isin(*retiring)), F.lit(False)).alias("retired"),
    )


def acknowledgements(commands: DataFrame, acks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Commands with the first acknowledgement after them and before the next command, and acknowledgements of nothing.

    kind: acknowledged, outstanding or unknown_ack; at: the command's (or stray acknowledgement's) place; ack_at.
    """
    both = commands.select(*keys, F.col(order).alias("at"), F.lit(0).alias("__ack")).union(acks.select(*keys, F.col(order).alias("at"), F.lit(1).alias("__ack")))
    w = Window.partitionBy(*keys).orderBy("at", "__ack")
    turn = F.sum(F.when(F.col("__ack") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__turn", turn)
    met = both.groupBy(*keys, "__turn").agg(F.min(F.when(F.col("__ack") == 0, F.col("at"))).alias("at"), F.min(F.when(F.col("__ack") == 1, F.col("at"))).alias("ack_at"))
    told = met.where("at is not null").select(*keys, F.when(F.col("ack_at").isNull(), "outstanding").otherwise("acknowledged").alias("kind"), "at", "ack_at")
    stray = both.where("__turn = 0 and __ack = 1").select(*keys, F.lit("unknown_ack").alias("kind"), "at", F.col("at").alias("ack_at"))
    return told.union(stray)


def command_issues(commands: DataFrame, acks: DataFrame, keys: Sequence[str], seq: str, ts: str, id_: str, text: str, issued: str) -> DataFrame:
    """Violations of the life of numbered commands over a stream's packets: keys, seq, id, code.

    commands: an occurrence each, with the packet's ``seq`` and ``ts``, the command's place in it (pos), its number, text and
    its own time, null for the packet's. acks: a packet's acknowledgement of a number each. In a packet commands come before
    acknowledgements. Codes: duplicate_command_in_packet; command_after_acknowledgement; command_changed and
    command_time_changed, against the command as first issued; non_increasing_command_id, of a new command;
    duplicate_acknowledgement; unknown_acknowledgement.
    """
    k = [*keys]
    c = commands.select(*k, F.col(seq).alias("__s"), F.col(ts).alias("__ts"), "pos", F.col(id_).alias("__id"), F.col(text).alias("__text"), F.col(issued).alias("__at"))
    c = c.withColumn("__again", F.row_number().over(Window.partitionBy(*k, "__s", "__id").orderBy("pos")) > 1)
    by_id = Window.partitionBy(*k, "__id").orderBy("__s", "pos")
    effective = F.coalesce("__at", "__ts")
    c = c.withColumn("__n", F.row_number().over(by_id)).withColumn("__text0", F.first("__text").over(by_id)).withColumn("__at0", F.first(effective).over(by_id))
    # the highest number of the commands before, in the stream's order
    high = F.max("__id").over(Window.partitionBy(*k).orderBy("__s", "pos").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("__high", high)
    a = acks.select(*k, F.col(seq).alias("__s"), F.col(id_).alias("__id")).groupBy(*k, "__s", "__id").agg(F.count("*").alias("times"))
    issued_at = c.groupBy(*k, "__id").agg(F.min("__s").alias("__first"))
    a = a.join(issued_at, [*k, "__id"], "left")
    known = F.coalesce(F.col("__first") <= F.col("__s"), F.lit(False))
    closed = a.where(known).groupBy(*k, "__id").agg(F.min("__s").alias("__closed"))
    c = c.join(closed, [*k, "__id"], "left")
    later = ~F.col("__again") & (F.col("__n") > 1)
    shut = F.coalesce(F.col("__closed") < F.col("__s"), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(F.col("__again"), "duplicate_command_in_packet"), F.when(later & shut, "command_after_acknowledgement"),
        F.when(later & ~shut & (F.col("__text") != F.col("__text0")), "command_changed"),
        F.when(later & ~shut & (F.col("__at") != F.col("__at0")), "command_time_changed"),
        F.when((F.col("__n") == 1) & (F.col("__id") <= F.col("__high")), "non_increasing_command_id"),
    ))
    told = c.select(*k, F.col("__s").alias("seq"), F.col("__id").alias("id"), F.explode(codes).alias("code"))
    said = F.array_compact(F.array(F.when(F.col("times") > 1, "duplicate_acknowledgement"), F.when(~known, "unknown_acknowledgement")))
    return told.union(a.select(*k, F.col("__s").alias("seq"), F.col("__id").alias("id"), F.explode(said).alias("code")))
