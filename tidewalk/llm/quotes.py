"""Conversations in reply order, linked by their quotations, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Quote markers before a line, and lines that introduce a quotation in four languages.
MARKERS = r"^(?:[ \t]{0,3}>)+"
INTRODUCES = r"^\s*(?:On\s.*\swrote|Am\s.*\sschrieb.*|Le\s.*\sécrit|El\s.*\sescribió)\s*:\s*$"
#: Characters of a normalised passage that link a reply to its original; shorter ones count only where none of these does.
LEAST = 12


def depth_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKERS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Letters and digits in lower case, everything else as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_words(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    lines = F.filter(F.split(text, r"\r?\n", -1), lambda x: (depth_of(x) == 0) & ~x.rlike(INTRODUCES))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def _passages(messages: DataFrame) -> DataFrame:
    """Paragraphs of messages at each quote level: conv_id, turn, level, h, size."""
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", r"\r?\n", -1)).alias("at", "line")).distinct()
    lines = lines.withColumn("level", depth_of(F.col("line"))).withColumn("line", normalised(F.regexp_replace("line", MARKERS, "")))
    order = Window.partitionBy("conv_id", "turn", "t").orderBy("at")  # one message's lines
    begins = (F.col("line") == "") | (F.lag("line").over(order) == "") | (F.lag("level").over(order) != F.col("level"))
    lines = lines.withColumn("run", F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(order)).where("line <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    runs = lines.groupBy("conv_id", "turn", "t", "run", "level").agg(whole.alias("passage"))
    return runs.select("conv_id", "turn", "level", F.xxhash64("passage").alias("h"), F.length("passage").alias("size")).distinct()


def quotation_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: the earlier turn of the same conversation whose own paragraphs a message quotes most of.

    Passages of level k are looked up among unquoted paragraphs, least quoted levels first; ties go to the longest
    quotations, then the latest turn. Passages under 12 characters decide only for messages without longer ones found. A paragraph that several earlier turns have counts for the latest of those before the reply.
    """
    spark = messages.sparkSession
    quoting = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").where(F.col("text").rlike("(?m)" + MARKERS))
    convs = table(quoting.select("conv_id").distinct(), "quoting")
    if convs.isEmpty():
        return spark.createDataFrame([], "conv_id long, turn long, reply_to long")
    passages = table(_passages(messages.where("turn IS NOT NULL").join(convs, "conv_id", "left_semi")), "passages")
    # originals and quotations of one passage in one order: the latest original before each quotation
    both = passages.select("conv_id", "h", "turn", "level", "size", F.when(F.col("level") == 0, F.col("turn")).alias("original"))
    before = Window.partitionBy("conv_id", "h").orderBy("turn", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("reply_to", F.last("original", ignorenulls=True).over(before)).where("level > 0 AND reply_to < turn")
    votes = found.groupBy("conv_id", "turn", "reply_to").agg((F.max("size") >= LEAST).alias("long"), F.min("level").alias("level"), F.sum("size").alias("size"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("long", (-F.col("level")).alias("l"), "size", "reply_to"))["reply_to"].alias("reply_to"))
    return table(best, "replies")


def _threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread (first turn of the chain of replies), level: by doubling the pointers to originals."""
    now = table(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("level")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("level").alias("more"))
        step = now.join(up, ["conv_id", "thread"], "left")
        if step.where("above IS NOT NULL").isEmpty():
            return now
        now = table(step.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "threads")


def _target(turn: Column) -> Column:
    """The turn that `as_mail` lets a turn quote: the one before, or for every third the one before that."""
    return turn - F.when(F.pmod(turn, F.lit(3)) == 2, 2).otherwise(1)


def as_mail(messages: DataFrame) -> DataFrame:
    """`messages` as they would look in a mail thread: conv_id, turn, role, text.

    But for each fourth turn, a message's text has before it the text of the turn it answers, quoted by '> ', and above
    that, by '>> ', the text which that one answers. Of a turn with several rows the smallest text is quoted; null ids,
    turns and texts are left as they are and not quoted; an empty table gives no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    answers = F.when(F.pmod(F.col("turn"), F.lit(4)) != 0, _target(F.col("turn")))
    out = rows.withColumn("one", answers).withColumn("two", _target(F.col("one")))
    for k in ("one", "two"):
        out = out.join(said.select("conv_id", F.col("turn").alias(k), F.col("said").alias(f"said_{k}")), ["conv_id", k], "left")
    quoted = [F.concat(F.lit(mark), F.replace(f"said_{k}", F.lit("\n"), F.lit("\n" + mark))) for k, mark in (("two", ">> "), ("one", "> "))]
    text = F.when(F.col("said_one").isNull(), F.col("text")).otherwise(F.concat_ws("\n\n", F.concat_ws("\n", *quoted), "text"))
    return out.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull(), text).alias("text"))


def chat(messages: DataFrame) -> DataFrame:
    """Per row of `messages`: conv_id, turn, role, content (without quotations), quote_depth, reply_to, thread, level,
    rendered. A conversation in reply order is its rows by (thread, turn): a reply follows the message it quotes.

    Lines are quoted as deep as they have '>' before them; paragraphs of each level are normalised, hashed and joined
    to unquoted paragraphs of earlier turns of the conversation. thread is the first turn of a chain of quotations
    (the turn itself without any), level the steps to it. rendered is '<|role|>', a line break and the content. There is
    no row a conversation: one may hold a third of all messages, which no task could gather.

    Null texts have null content and render as empty; null conv_id or turn: never linked, thread is the turn; null
    roles render as 'user'. Repeated rows get equal links. Other columns are ignored, an empty table gives no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    replies = quotation_links(rows)
    threads = _threads(replies) if not replies.isEmpty() else replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("level"))
    linked = replies.join(threads, ["conv_id", "turn"])
    out = rows.join(linked, ["conv_id", "turn"], "left")
    content = own_words(F.col("text"))
    depth = F.array_max(F.transform(F.split("text", r"\r?\n", -1), depth_of))
    return out.select(
        "conv_id",
        "turn",
        "role",
        content.alias("content"),
        F.coalesce(depth, F.lit(0)).alias("quote_depth"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("level", F.lit(0)).alias("level"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce(content, F.lit(""))).alias("rendered"),
    )


#: The same in DuckDB's SQL, over messages m.
_CHAT = r"""
l AS (SELECT DISTINCT conv_id, turn, text, pos, string_split_regex(text, '\r?\n')[pos] line
      FROM (SELECT *, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) pos FROM m)),
d AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]{0,3}>)+', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM l),
own AS (SELECT conv_id, turn, text, max(level) quote_depth,
               regexp_replace(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT regexp_matches(line,
                 '^\s*(?:On\s.*\swrote|Am\s.*\sschrieb.*|Le\s.*\sécrit|El\s.*\sescribió)\s*:\s*$')), '^\s+|\s+$', '', 'g') content
        FROM d GROUP BY conv_id, turn, text),
b AS (SELECT *, CASE WHEN coalesce(words = '' OR lag(words) OVER w = '' OR lag(level) OVER w <> level, true) THEN 1 ELSE 0 END b
      FROM d WHERE conv_id IS NOT NULL AND turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id, turn, text ORDER BY pos)),
r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) run FROM b),
p AS (SELECT DISTINCT conv_id, turn, level, string_agg(words, ' ' ORDER BY pos) passage FROM r WHERE words <> ''
      GROUP BY conv_id, turn, text, run, level),
v AS (SELECT q.conv_id, q.turn, q.level, q.passage, max(o.turn) reply_to FROM p q JOIN p o
      ON o.conv_id = q.conv_id AND o.passage = q.passage AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
w AS (SELECT conv_id, turn, reply_to, CASE WHEN max(length(passage)) >= 12 THEN 1 ELSE 0 END long, min(level) level, sum(length(passage)) size FROM v GROUP BY ALL),
links AS (SELECT conv_id, turn, reply_to FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY long DESC, level, size DESC, reply_to DESC) = 1),
up AS (SELECT conv_id, turn, reply_to AS thread, 1 AS level FROM links
       UNION ALL SELECT up.conv_id, up.turn, links.reply_to, up.level + 1 FROM up JOIN links ON links.conv_id = up.conv_id AND links.turn = up.thread),
top AS (SELECT conv_id, turn, min(thread) thread, max(level) level FROM up GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.text IS NULL THEN NULL ELSE coalesce(own.content, '') END AS content,
       CAST(coalesce(own.quote_depth, 0) AS INTEGER) AS quote_depth, links.reply_to,
       coalesce(top.thread, m.turn) AS thread, CAST(coalesce(top.level, 0) AS INTEGER) AS level,
       '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(own.content, '') AS rendered
FROM m LEFT JOIN own ON own.conv_id IS NOT DISTINCT FROM m.conv_id AND own.turn IS NOT DISTINCT FROM m.turn AND own.text = m.text
LEFT JOIN links ON links.conv_id = m.conv_id AND links.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""

_MESSAGES = "SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM conversations"
CHAT_SQL = f"WITH RECURSIVE m AS ({_MESSAGES}),{_CHAT}"
#: The same over what `as_mail` makes of them.
MAIL_SQL = rf"""
WITH RECURSIVE a AS ({_MESSAGES}), s AS (SELECT conv_id, turn, min(text) said FROM a GROUP BY ALL),
t AS (SELECT *, one - CASE WHEN one % 3 = 2 THEN 2 ELSE 1 END AS two FROM (SELECT *, CASE WHEN turn % 4 <> 0 THEN turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END END AS one FROM a)),
m AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.text IS NULL OR x.said IS NULL THEN t.text ELSE
      coalesce('>> ' || replace(y.said, chr(10), chr(10) || '>> ') || chr(10), '') || '> ' || replace(x.said, chr(10), chr(10) || '> ') || chr(10) || chr(10) || t.text END AS text
  FROM t LEFT JOIN s x ON x.conv_id = t.conv_id AND x.turn = t.one LEFT JOIN s y ON y.conv_id = t.conv_id AND y.turn = t.two),{_CHAT}"""
