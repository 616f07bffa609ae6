"""Quotation linking: quoted passages of messages are traced to the messages they come from.

A line's quote level is the number of > before it.  Neighbouring lines of one
level, up to a blank line, are a passage.  Passages are lower-cased, their
white space is made single, and they are hashed; a quoted passage, or failing
that a line of it, is joined to the first message of its conversation that
says it unquoted.  A message replies to the latest message that it quotes at
its lowest level.  Conversations come out as rows without quotes, each thread
together and in order of turns.  All of it is DataFrame operations.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

QUOTE = r"^(?:[ \t]*>)+"


def passages(messages: DataFrame) -> DataFrame:
    """From (conv, turn, text): (conv, turn, level, whole, norm), a row for each passage and for each line of one with several; equal messages count once."""
    once = messages.where("text is not null").select("conv", "turn", "text").distinct()  # else equal messages' lines would mix
    rows = once.select("conv", "turn", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    marked = rows.withColumn("mark", F.regexp_extract("line", QUOTE, 0)).withColumn("level", F.length(F.regexp_replace("mark", "[^>]", "")))
    bare = F.trim(F.regexp_replace(F.lower(F.expr("substring(line, length(mark) + 1)")), r"\s+", " "))
    lines = marked.select("conv", "turn", "key", "n", "level", bare.alias("norm"))
    message = Window.partitionBy("conv", "turn", "key").orderBy("n")  # a message's lines
    breaks = (F.col("norm") == "") | ~F.col("level").eqNullSafe(F.lag("level").over(message)) | (F.lag("norm").over(message) == "")
    runs = lines.withColumn("run", F.sum(breaks.cast("int")).over(message)).where("norm <> ''")
    grouped = runs.groupBy("conv", "turn", "key", "run", "level").agg(F.array_sort(F.collect_list(F.struct("n", "norm"))).alias("parts"))
    whole = grouped.select("conv", "turn", "level", F.lit(True).alias("whole"), F.array_join("parts.norm", " ").alias("norm"))
    single = grouped.where("size(parts) > 1").select("conv", "turn", "level", F.lit(False).alias("whole"), F.explode("parts.norm").alias("norm"))
    return whole.union(single).distinct()


def links(messages: DataFrame) -> DataFrame:
    """From (conv, turn, text): (conv, turn, reply_to, n_quotes) for each message that quotes an earlier one."""
    quoting = messages.where(F.col("text").rlike("(?m)" + QUOTE))
    concerned = messages.join(quoting.select("conv").distinct(), "conv", "left_semi")
    found = store.stage(passages(concerned).withColumn("digest", F.xxhash64("norm")), "passages")
    said = found.where("level = 0").groupBy("conv", "digest", "norm").agg(F.min("turn").alias("original"))
    quoted = found.where("level > 0")
    same = ["conv", "digest", "norm"]
    traced = quoted.join(said, same).where("original < turn")
    best = traced.groupBy("conv", "turn", "level").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("whole"), F.col("original"))).alias("by_whole"), F.max("original").alias("by_any"), F.count(F.lit(1)).alias("n"))
    chosen = best.withColumn("original", F.coalesce("by_whole", "by_any"))
    return chosen.groupBy("conv", "turn").agg(F.min(F.struct("level", "original")).getField("original").alias("reply_to"), F.sum("n").alias("n_quotes"))


def roots(replies: DataFrame) -> DataFrame:
    """From (conv, turn, reply_to): (conv, turn, root), the first message of each reply's thread, by doubling steps."""
    steps = store.stage(replies.select("conv", "turn", F.col("reply_to").alias("root")), "steps")
    while True:
        upper = steps.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("up"))
        joined = steps.join(upper, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        moved = store.stage(joined.select("conv", "turn", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "steps")
        store.drop(steps)
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds position, from 0 in each group, in the order of `order`; a group may span any number of tasks."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", at)
    placed = store.stage(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    bases = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    at = placed.join(bases, "_part").withColumn("_at", F.col("_base") + F.col("_row")).drop("_part", "_base", "_row")
    firsts = at.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"))
    return at.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).withColumn("position", F.col("_at") - F.col("_first")).drop("_at", "_group", "_first")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, text, reply_to, root, n_quotes) for each message; text is what isn't quoted.

    Null texts stay null and quote nothing.  Equal rows all appear, one after
    the other.  Rows of one turn with different texts share what they quote.
    Rows without conversation or turn are kept, but have no links.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    replies = store.stage(links(rows.select("conv", "turn", "text")), "replies")
    threads = replies.join(roots(replies), ["conv", "turn"])
    own = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(QUOTE)), "\n")
    clean = F.when(F.col("text").rlike("(?m)" + QUOTE), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(F.col("text"))
    linked = rows.join(threads, ["conv", "turn"], "left").select("conv", "turn", "role", clean.alias("text"), "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"))
    return numbered(linked, "conv", ["root", "turn", "role", "text"]).select(F.col("conv").alias(conv), "position", F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "reply_to", "root", "n_quotes")
