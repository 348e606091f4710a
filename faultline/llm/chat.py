"""Reply trees to chat texts, with a loss mask. Only DataFrame functions.

Messages point to the message they answer. Jump pointers double their reach in each self-join, so a path of n messages
takes log2(n) joins; branches are ranked by the sum of their scores; each chosen branch becomes one text.

Template of a turn: ``<turn>role``, newline, text, ``</turn>``, newline. Inside texts and roles every ``<turn`` and
``</turn``, and every form of them that already holds backslashes after ``<``, gets one more backslash there; taking one
away restores the text. In roles a newline is written as a backslash and n, a backslash as a backslash and b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import stored

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*/?turn)", r"<\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*/?turn)", "<$1")


def _role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_back(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """The messages of the `best` branches of each tree: tree, branch (1 is best), depth (0 is the root), node.

    `messages`: tree, node (unique in its tree), parent (null at a root), score. A branch runs from a root to a message
    without an answer; its score is the sum of its messages' scores (null counts 0), ties go to the smaller leaf. A message
    whose parent is missing starts a branch. Messages on a cycle, and those below one, belong to no branch.
    """
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    m = m.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), "score")
    start = stored(m.select("tree", "node", "up", "score", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist")), "jump")
    running, ended, levels = start.where("up is not null"), start.where("up is null"), []
    most = start.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 2 ** len(levels) < most:
        # after k rounds `up` is 2**k messages away, score and dist cover the messages passed on the way; what has reached
        # its root is only looked up from then on, so a round joins no more than the messages at depth 2**k and below
        levels.append(running)
        far = ended.union(running).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_s"), F.col("dist").alias("_d"))
        step = running.join(far, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_s")).alias("score"), (F.col("dist") + F.col("_d")).alias("dist")
        )
        step = stored(step, "jump")
        running, ended = step.where("up is not null"), ended.union(step.where("up is null"))
    rooted = ended.select("tree", "node", "score", F.col("dist").alias("depth"))
    answered = start.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    on = rooted.join(answered, ["tree", "node"], "left_anti").withColumn("branch", rank).where(F.col("branch") <= best).select("tree", "branch", "node")
    for step in levels:  # distances 0 .. 2**k - 1 become 0 .. 2**(k+1) - 1
        above = on.join(step.select("tree", "node", "up"), ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"))
        on = stored(on.union(above), "branch")
    return on.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "branch", "depth", "node")


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _role(role), F.lit("\n"), escape(text), F.lit(CLOSE))


def chats(turns: DataFrame, keys: list[str], order: str, learn: str = "assistant") -> DataFrame:
    """One row per `keys`: formatted, and mask with one (start, length) per turn, in code points; length 0 is no loss.

    `turns`: keys, `order`, role, text; null role or text counts as empty. Equal places are ordered by role and text.
    A conversation is one string, so it is gathered in one task; Spark bounds a string to 2 GB.
    """
    t = turns.select(*keys, F.col(order).alias("_o"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = t.select(
        *keys, "_o", "role", "text", turn(F.col("role"), F.col("text")).alias("piece"),
        F.when(F.col("role") == learn, F.length(escape(F.col("text")))).otherwise(0).alias("len"),
        (F.length(F.lit(OPEN)) + F.length(_role(F.col("role"))) + 1).alias("lead"),
    )
    w = Window.partitionBy(*keys).orderBy("_o", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = piece.withColumn("_n", F.row_number().over(w)).withColumn("start", before + F.col("lead"))
    return (
        piece.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_n", "piece", F.struct(F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("length")).alias("span")))).alias("_a"))
        .select(*keys, F.array_join("_a.piece", "").alias("formatted"), F.col("_a.span").alias("mask"))
    )


def read_back(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """Turns from the texts alone, and what lies under the mask: keys, pos, role, text, masked (null where no loss)."""
    pieces = formatted.select(*keys, F.posexplode(F.arrays_zip(F.split("formatted", r"(?<=</turn>\n)", -1).alias("piece"), F.col("mask").alias("span"))).alias("pos", "_z"))
    pieces = pieces.select(*keys, "pos", F.col("_z.piece").alias("piece"), F.col("_z.span").alias("span")).where("piece <> ''")
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_at", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))
    body = F.substring("piece", F.lit(len(OPEN) + 1), F.length("piece") - len(OPEN) - len(CLOSE))
    cut = F.substring("piece", (F.col("span.start") - F.col("_at") + 1).cast("int"), F.col("span.length").cast("int"))
    return pieces.withColumn("_b", body).select(
        *keys, "pos",
        _role_back(F.substring_index("_b", "\n", 1)).alias("role"),
        unescape(F.substring("_b", F.locate("\n", F.col("_b")) + 1, F.length("_b"))).alias("text"),
        F.when(F.col("span.length") > 0, unescape(cut)).alias("masked"),
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts.

    Every conversation is a chain of replies in the order of turn (then role and text); so repeated rows and equal turns
    all stay. Null texts and roles are empty, rows with a null conv_id form one conversation, an empty table gives no row.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = F.struct(F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("none"))
    c = stored(c.select(tree.alias("tree"), F.row_number().over(w).alias("node"), "role", "text"), "messages")
    chain = c.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    chosen = branches(chain).join(c.select("tree", "node", "role", "text"), ["tree", "node"])
    text = chats(chosen, ["tree"], "depth")
    text = stored(text, "chats")
    back = read_back(text, ["tree"])
    per = back.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"), "masked"))).alias("_a"))
    loss = F.array_join(F.filter("_a.masked", lambda x: x.isNotNull()), "")
    per = per.select(
        "tree", F.size("_a").cast("long").alias("n_turns"), F.sha2(F.array_join("_a.t", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
    )
    chars = text.select("tree", F.length("formatted").cast("long").alias("formatted_chars"))
    return per.join(chars, "tree").select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )
