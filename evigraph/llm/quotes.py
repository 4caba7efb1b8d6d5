"""Quotation linking in messages, with DataFrame functions only.

A line's quote level is the number of ``>`` at its start. Runs of lines of one
level are passages; a level-0 line that ends in ``:`` just before a quote is its
attribution. A passage, normalised to lower-case letters and digits between
single spaces, is hashed and joined to the hashes of the whole own text, the
paragraphs and the lines of all messages. Its source is the earliest such
message of the same conversation before the quoting one, or else the earliest
by (conversation, turn) before it. A passage that has none is trimmed: its source,
by the same order, is a message whose own text has each of its lines as a run of
words, or, if it is of fewer than RUN words, as a line or sentence. Such messages
are looked up by the passage's rarest run of at most RUN words. A message replies
to the source of its first passage of the lowest level that has one. Messages
come back without quotes, with their place in the conversation, in which every
reply follows what it replies to, and with their thread's first message and depth.

Results in odd cases: null and empty texts stay as they are and quote nothing;
passages without letters or digits have no source, and lines without any don't
count in a trimmed passage; rows with a null
conversation or turn are returned but neither quote nor are quoted, and have no
place. Repeated (conv_id, turn) rows each count as a message, and share links.
Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._text import cut, read

#: Turns of a conversation that are ranked together.
TURNS = 1024
#: Words of the runs by which sources of trimmed passages are looked up.
RUN = 4


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passage_key(text: Column) -> Column:
    """Hash of a normalised passage; null if nothing is left of it."""
    own = normalised(text)
    return F.when(own != "", F.xxhash64(own))


def quote_lines(messages: DataFrame) -> DataFrame:
    """Lines of the messages that quote: id, conv_id, turn, line, level, body, attribution."""
    lines = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("id", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw"))
    marks = F.regexp_extract("raw", r"^((?:[ \t]*>)*)", 1)
    lines = lines.select("id", "conv_id", "turn", "line", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.expr(r"substring(raw, length(regexp_extract(raw, '^((?:[ \\t]*>)*)', 1)) + 1)").alias("body"))
    order = Window.partitionBy("id").orderBy("line")  # the lines of one message
    after = F.lead("level").over(order)
    lines = lines.withColumn("attribution", (F.col("level") == 0) & F.rtrim("body").endswith(":") & (F.coalesce(after, F.lit(0)) > 0))
    new = F.coalesce((F.lag("level").over(order) != F.col("level")).cast("int"), F.lit(1))
    return lines.withColumn("new", new).withColumn("run", F.sum("new").over(order)).drop("new")


def _runs(words: Column, full: Column) -> Column:
    """Hashes of the runs of RUN words (of all that fit, if full), and else of shorter ones too."""
    run = lambda i, n: F.xxhash64(F.lit(n), *(F.get(words, i + j) for j in range(n)))
    starts = lambda n: F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    of = lambda n: F.transform(starts(n), lambda i: run(i, n))
    return F.when(full, of(RUN)).otherwise(F.concat(*(of(n) for n in range(1, RUN + 1))))


def _earliest(found: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Adds source: the earliest message with the key in the same conversation, or else anywhere, before the quoting one."""
    here = given.groupBy(key, "conv_id").agg(F.min("turn").alias("here"))
    any_where = given.groupBy(key).agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = found.join(here, [key, "conv_id"], "left").join(any_where, key, "left")
    inside = F.col("here") < F.col("turn")
    before = (F.col("first.conv_id") < F.col("conv_id")) | ((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") < F.col("turn")))
    source = F.when(inside, F.struct("conv_id", F.col("here").alias("turn"))).when(before, F.col("first"))
    return found.withColumn("source", source).drop("here", "first")


def _trimmed(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages with a source, if any, that has each of their lines somewhere."""
    lines = F.filter(F.transform(F.split("passage", "\n"), normalised), lambda x: x != "")
    passages = passages.withColumn("lines", F.array_sort(F.array_distinct(lines))).withColumn("trim", F.xxhash64("lines"))
    passages = passages.withColumn("n", F.size(F.split(F.array_join("lines", " "), " ")))
    asked = cut(passages.select("trim", "lines", "n").dropDuplicates(["trim"]), "asked")
    # a line of RUN words or more is looked up by its runs of RUN words, a shorter one as a whole
    line = cut(asked.select("trim", F.explode("lines").alias("line")).select("trim", F.split("line", " ").alias("w")), "lines")
    whole = F.coalesce(*(F.when(F.size("w") == n, F.xxhash64(F.lit(n), *(F.get("w", F.lit(j)) for j in range(n)))) for n in range(1, RUN)))
    runs = line.select("trim", F.explode(F.when(F.size("w") < RUN, F.array(whole)).otherwise(_runs(F.col("w"), F.lit(True)))).alias("run")).distinct()
    texts = texts.filter("conv_id is not null and turn is not null and own <> ''").select("conv_id", "turn", "own", normalised(F.col("own")).alias("norm"))
    texts = cut(texts.filter("norm <> ''").dropDuplicates(["conv_id", "turn", "norm"]).select("*", F.xxhash64("conv_id", "turn", "norm").alias("message"), F.split("norm", " ").alias("w")), "texts")  # words are split once, not for each run
    held = texts.select("message", F.explode(F.array_distinct(_runs(F.col("w"), F.lit(False)))).alias("run"))
    held = cut(held.join(runs.select("run").distinct(), "run", "left_semi"), "runs")
    often = held.groupBy("run").agg(F.count("*").alias("often"))
    rarest = runs.join(often, "run", "left").groupBy("trim").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "run")).alias("least"))
    rarest = rarest.filter("least.often > 0").select("trim", "least.run")
    pairs = rarest.join(held, "run").select("trim", "message").join(asked, "trim").join(texts, "message")
    units = F.transform(F.split("own", r"\r?\n|[.!?]+\s+"), normalised)
    inside = F.forall("lines", lambda x: F.contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" "))))
    given = pairs.filter(inside & ((F.col("n") >= RUN) | F.forall("lines", lambda x: F.array_contains(units, x)))).select("trim", "conv_id", "turn")
    return _earliest(passages, given, "trim")


def link(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), quotes, linked, reply_conv,
    reply_turn, thread_conv, thread_turn, depth, place."""
    rows = cut(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("id", F.xxhash64("conv_id", "turn", "role", "text")), "messages")
    whole = rows.filter("conv_id is not null and turn is not null")
    lines = cut(quote_lines(whole.dropDuplicates(["id"])), "lines")
    in_order = lambda rule: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rule, F.struct("line", "body")))), lambda x: x["body"]), "\n")
    clean = lines.groupBy("id").agg(F.trim(in_order((F.col("level") == 0) & ~F.col("attribution"))).alias("own"))
    passages = lines.filter("level > 0").groupBy("id", "conv_id", "turn", "run").agg(F.min("level").alias("level"), in_order(F.lit(True)).alias("passage"))
    passages = passages.withColumn("key", passage_key(F.col("passage")))
    texts = rows.join(clean, "id", "left").withColumn("own", F.coalesce("own", "text"))

    asked = passages.filter("key is not null").select("key").distinct()
    pieces = F.concat(F.array("own"), F.split("own", r"\r?\n[ \t]*\r?\n"), F.split("own", r"\r?\n"))
    given = texts.filter("conv_id is not null and turn is not null and own <> ''").select("conv_id", "turn", F.explode(F.array_distinct(pieces)).alias("piece"))
    given = given.select("conv_id", "turn", passage_key(F.col("piece")).alias("key")).join(asked, "key", "left_semi")
    found = cut(_earliest(passages, given, "key"), "passages")
    lost = found.filter("source is null and key is not null").drop("source")
    if lost.limit(1).count():
        found = found.filter("source is not null or key is null").unionByName(_trimmed(lost, texts).select(*found.columns))
    replies = found.groupBy("id").agg(F.count("*").alias("quotes"), F.count("source").alias("linked"), F.min(F.when(F.col("source").isNotNull(), F.struct("level", "run", "source")))["source"].alias("reply"))
    out = cut(texts.join(replies, "id", "left").select("conv_id", "turn", "role", F.col("own").alias("text"), F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"), F.col("reply.conv_id").alias("reply_conv"), F.col("reply.turn").alias("reply_turn")), "replies")
    return _places(_threads(out))


def _threads(rows: DataFrame) -> DataFrame:
    """Adds the first message of each thread and the depth in it, by pointer jumps along replies."""
    up = rows.filter("reply_conv is not null").groupBy("conv_id", "turn").agg(F.min(F.struct(F.col("reply_conv").alias("c"), F.col("reply_turn").alias("t"))).alias("up"))
    up = cut(up.select("conv_id", "turn", "up.c", "up.t", F.lit(1).cast("long").alias("depth")), "threads")
    while True:  # rounds grow with the logarithm of the depth
        further = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("depth").alias("more"))
        new = up.join(further, ["c", "t"], "left")
        new = cut(new.select("conv_id", "turn", F.coalesce("c2", "c").alias("c"), F.coalesce("t2", "t").alias("t"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("c2").isNotNull().alias("moved")), "threads")
        up = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break
    out = rows.join(up, ["conv_id", "turn"], "left")
    return out.select(*rows.columns, F.coalesce("c", "conv_id").alias("thread_conv"), F.coalesce("t", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _places(rows: DataFrame) -> DataFrame:
    """Adds place, 1 for a conversation's first message.

    Replies point to earlier turns, so the order of turns is a reply order.
    Turns are ranked within stretches of TURNS, and stretches by their sizes,
    so no task holds a whole long conversation.
    """
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / TURNS))
    sizes = rows.filter("conv_id is not null and turn is not null").groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text"))
    ranked = rows.withColumn("rank", rank).join(before, ["conv_id", "stretch"], "left")
    return ranked.withColumn("place", (F.col("before") + F.col("rank")).cast("long")).drop("stretch", "rank", "before")


def op2_quote_linking(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "conversations"))
