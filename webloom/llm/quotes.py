r"""Quotation linking of messages, in DataFrame functions only.

Lines that begin with `>` are quoted; the number of these marks is their level, 0 for a message's own words. Consecutive
lines of one level, without an empty line between them, are a passage. Passages are normalised (lower case, single
spaces) and hashed; a quoted passage is joined to the message of its conversation that first said it in its own words, if that
came before. A passage that no message said as a whole is cut into its lines and sentences, which are joined the same way; it belongs to the
latest message that these are joined to. The message a reply answers is the latest one that its passages of level 1 are joined to (of all levels, if none of
level 1 is). Replies follow what they answer: `root` is the turn of a thread's first message and `rank` a message's place in the thread, each
answer right after what it answers and the answers to it, so that sorting by (conv_id, root, rank) gives the reply order. `own_text` holds the words without quotes.

Only the first message of each passage and the passages themselves meet in the join, by conversation and hash, so
nothing grows with the square of a conversation. Threads are ranked as lists: pointer doubling, in as many rounds as the
logarithm of the longest chain of replies, counts what hangs on each message; answers to one message sum up, in order, what hangs on
those before them, in many tasks if they are many; and a second doubling adds these sums along the way to the root. A message is one row of numbers
in each round, however deep it stands.

Defined results: null text counts as empty; a null conversation is one conversation; a null turn answers nothing and has no root;
turns of any type that can be ordered (negative ones, long ones, texts) count as they compare; of rows that repeat a turn each counts as a message of that turn, and they share
root and rank; passages of no letters or digits link nothing; U+0002 counts as a blank; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, sums_before

def _lines(text: Column) -> Column:
    """level, body of each line; an empty line has level -1."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")

    def one(x: Column) -> Column:
        # marks with at most three blanks before each
        marks = F.regexp_replace(F.regexp_extract(x, r"^([ \t>]*>)", 1), r"(?s)[ \t]{4}.*$", "")
        body = F.when(marks == "", x).otherwise(F.regexp_replace(F.substr(x, F.length(marks) + 1), r"^[ \t]", ""))
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(F.when(F.trim(F.translate(body, "\t", " ")) == "", F.lit(-1)).otherwise(level).alias("level"), body.alias("body"))

    return F.transform(lines, one)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn, nth (of the message's passages), level, passage (as written, without marks), hash."""
    # each line with its level at either end; where that changes from a line to the next, the text is cut
    line = F.transform(_lines(F.translate(named(text_col).cast("string"), "\x02", " ")), lambda x: F.when(x["level"] < 0, "-\x02\x02-").otherwise(F.concat_ws("\x02", x["level"].cast("string"), x["body"], x["level"].cast("string"))))
    whole = F.concat(F.array_join(line, "\n"), F.lit("\n*"))
    parts = F.filter(F.split(whole, "\x02([0-9]+)\n(?!\\1\x02)|\x02-\n(?!-)"), lambda x: ~x.startswith("-") & (x != "*"))
    rows = messages.select(named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), F.posexplode(parts).alias("nth", "part"))
    body = F.regexp_replace(F.regexp_replace("part", "^[0-9]+\x02", ""), "\x02[0-9]+\n[0-9]+\x02", "\n")
    rows = rows.select("conv_id", "turn", "nth", F.regexp_extract("part", "^([0-9]+)\x02", 1).cast("int").alias("level"), body.alias("passage"))
    norm = normalised(F.col("passage"))
    return rows.withColumn("hash", F.when(F.regexp_like(norm, F.lit(r"[\p{L}\p{N}]")), F.sha2(norm, 256)))


def _pieces(found: DataFrame) -> DataFrame:
    """found with the hash of each line and sentence of a passage, once, instead of the passage's."""
    norm = normalised(F.col("passage"))
    parts = F.concat(F.transform(F.split("passage", "\n"), normalised), F.split(norm, r"(?<=[.!?\u2026])\s+"))
    rows = found.withColumn("piece", F.explode(F.array_distinct(parts))).where(F.regexp_like("piece", F.lit(r"[\p{L}\p{N}]")))
    return rows.withColumn("hash", F.sha2("piece", 256)).drop("piece", "passage")


def _first_said(said: DataFrame) -> DataFrame:
    return said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).withColumnsRenamed({"conv_id": "c", "hash": "h"})


def links(found: DataFrame) -> DataFrame:
    """conv_id, turn, nth, level, origin (the turn that first said the passage, or the latest of those that first said its lines and sentences) of the quoted passages that have one."""
    own, quoted = found.where("level = 0 and hash is not null"), found.where("level > 0 and hash is not null")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("origin") < F.col("turn"))
    whole = quoted.join(_first_said(own), same, "left").drop("c", "h")
    rest = _pieces(whole.where("origin is null").drop("origin").distinct().withColumn("of", F.col("hash")))
    met = rest.join(_first_said(_pieces(own)), same).groupBy("conv_id", "turn", "nth", "level", "of").agg(F.max("origin").alias("later"))
    met = met.withColumnsRenamed({"conv_id": "c", "turn": "t", "nth": "k", "level": "l"})
    at = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("nth") == F.col("k")) & (F.col("level") == F.col("l")) & (F.col("hash") == F.col("of"))
    out = whole.join(met, at, "left").withColumn("origin", F.coalesce("origin", "later"))
    return out.where("origin is not null").select("conv_id", "turn", "nth", "level", "origin")


def own_words(text: Column) -> Column:
    """A message without its quoted lines: own lines as they are, what quotes leave empty at either end trimmed."""
    own = F.filter(_lines(text.cast("string")), lambda x: x["level"] <= 0)
    kept = F.filter(F.transform(own, lambda x: F.when((x["level"] == -1), F.lit("")).otherwise(x["body"])), lambda x: x.isNotNull())
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _doubled(nodes: DataFrame, carry: str, pushed: bool) -> DataFrame:
    """conv_id, turn, top (the first message of the thread), depth and `carry` of nodes(conv_id, turn, parent, carry): each round doubles the distance that a message's pointer `up` reaches. carry adds up from a message to the root, or, pushed, to each message from all that hang on it."""
    now = cut(nodes.select("conv_id", "turn", F.col("parent").alias("up"), F.coalesce("parent", "turn").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), carry))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col(carry).alias("more"))
        both = now.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("t")), "left")
        if pushed:
            below = now.where("up is not null").groupBy(F.col("conv_id").alias("c3"), F.col("up").alias("t3")).agg(F.sum(carry).alias("below"))
            both = both.join(below, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("turn") == F.col("t3")), "left")
        gained = F.coalesce("below" if pushed else "more", F.lit(0))
        now = cut(both.select("conv_id", "turn", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col(carry) + gained).alias(carry)))
    return now.drop("up")


def threads(answers: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth, rank of all messages of answers(conv_id, turn, parent), those answered included: rank counts the messages of the thread that come before, an answer after its parent and after the earlier answers with all that hangs on these."""
    first = answers.select("conv_id", F.col("parent").alias("turn")).distinct().withColumn("parent", F.lit(None).cast(answers.schema["parent"].dataType))
    nodes = answers.select("conv_id", "turn", "parent").unionByName(first).groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    nodes = cut(nodes.withColumn("size", F.lit(1).cast("long")))
    if nodes.isEmpty():
        return nodes.select("conv_id", "turn", F.col("turn").alias("root"), F.col("size").alias("depth"), F.col("size").alias("rank"))
    sizes = _doubled(nodes, "size", pushed=True).withColumnsRenamed({"conv_id": "c", "turn": "t"}).select("c", "t", "size")
    sized = nodes.drop("size").join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).drop("c", "t")
    behind = sums_before(sized.where("parent is not null"), ["conv_id", "parent"], [F.col("turn")], {"size": "before"}).withColumn("rank", F.col("before") + 1)
    steps = behind.select("conv_id", "turn", "parent", "rank").unionByName(sized.where("parent is null").select("conv_id", "turn", "parent", F.lit(0).cast("long").alias("rank")))
    return _doubled(steps, "rank", pushed=False).withColumnRenamed("top", "root")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, parent (the turn it answers, null if none), root (its own turn, if none), depth, rank, n_quotes (quoted passages), n_linked, own_text."""
    own = messages.select(named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).cast("string").alias("text"))
    found = passages(own)
    joined = links(found)
    parent = F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin"))
    answers = cut(joined.groupBy("conv_id", "turn").agg(parent.alias("parent"), F.count(F.lit(1)).alias("n_linked")), few=True)
    quoted = found.where("level > 0").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"))
    key = lambda c, t: F.col("conv_id").eqNullSafe(F.col(c)) & F.col("turn").eqNullSafe(F.col(t))
    side = quoted.withColumnsRenamed({"conv_id": "c", "turn": "t"})
    for more in (answers, threads(answers)):  # all but a message's text: one row for each turn that quotes or is quoted
        more = more.withColumnsRenamed({"conv_id": "c2", "turn": "t2"})
        side = side.join(more, F.col("c").eqNullSafe(F.col("c2")) & F.col("t").eqNullSafe(F.col("t2")), "full").withColumns({"c": F.coalesce("c", "c2"), "t": F.coalesce("t", "t2")}).drop("c2", "t2")
    out = own.join(side, key("c", "t"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", "parent", F.coalesce("root", "turn").alias("root"), count("depth"), count("rank"), count("n_quotes"), count("n_linked"), own_words(F.col("text")).alias("own_text"))
