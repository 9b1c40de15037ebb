"""Chat formatting by quotation linking: replies are found by the passages that they quote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: A quoted line begins with one or more marks, each with white space around it.
MARKS = r"^[ \t]*((?:>[ \t]*)+)"


def lines_of(text: Column) -> Column:
    """Each line as (level, content): level is the number of quotation marks before it, 0 for the writer's own."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS, "").alias("content"))

    return F.transform(lines, parsed)


def normalised(content: Column) -> Column:
    """Lower case, with one space for each run of white space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(content), r"\s+", " "))


def passages(lines: Column, kept: Callable[[Column], Column]) -> Column:
    """(level, passage): consecutive kept lines of a level as one normalised text, whatever their line ends; blank lines and others part them."""
    marked = F.transform(lines, lambda x: F.when(kept(x) & (normalised(x["content"]) != ""), x["level"]))
    plain = lambda x: F.regexp_replace(x["content"], "[\x01\x02]", " ")
    goes_on = lambda levels, i: (i > 0) & F.get(levels, i - 1).eqNullSafe(F.get(levels, i))
    text = lambda levels: F.array_join(F.transform(lines, lambda x, i: F.when(F.get(levels, i).isNull(), "").when(goes_on(levels, i), F.concat(F.lit("\n"), plain(x))).otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), plain(x)))), "")
    parts = F.get(F.transform(F.array(marked), lambda levels: F.split(text(levels), "\x01", -1)), 0)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), normalised(F.substring_index(p, "\x02", -1)).alias("passage")))


def sentences(passage: Column) -> Column:
    """Sentences of a normalised passage."""
    marked = F.regexp_replace(F.regexp_replace(passage, "\x01", ""), r"([.!?…][\"')\]”’]?) |([。！？])", "$1$2\x01")
    return F.filter(F.transform(F.split(marked, "\x01", -1), F.trim), lambda s: s != "")


#: Turns of a cell, in which the nearest earlier message is searched by one window.
CELL = 1024


def nearest(wanted: DataFrame, said: DataFrame) -> DataFrame:
    """wanted (conv_id, turn, hash, ...) with parent: the latest message before the turn that has the hash, of said (conv_id, turn, hash). Rows without one are left out.

    No pair of a message and a quote is made: one window goes over a cell of turns, another over the cells.
    """
    keys = ["conv_id", "hash", "cell"]
    rest = [c for c in wanted.columns if c not in ("conv_id", "hash")]
    marks = said.join(wanted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    both = wanted.withColumn("said", F.lit(None).cast("long")).unionByName(marks.withColumn("said", F.col("turn")), allowMissingColumns=True).withColumn("cell", F.floor(F.col("turn") / CELL))
    inside = F.last("said", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("turn", F.col("said").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = both.groupBy(*keys).agg(F.max("said").alias("said"))
    before = F.last("said", ignorenulls=True).over(Window.partitionBy("conv_id", "hash").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("inside", inside).filter("said IS NULL").join(cells.select(*keys, before.alias("before")), keys)
    return found.select("conv_id", "hash", *rest, F.coalesce("inside", "before").alias("parent")).filter("parent IS NOT NULL")


def positions(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, position) of rows (conv_id, turn, thread_turn): the place in the conversation's reply order, from 0. A sort of all rows and counts of its parts, so that no conversation is one task's."""
    laid = scratch.written(placed.orderBy("conv_id", "thread_turn", "turn").select("conv_id", "turn", F.monotonically_increasing_id().alias("at")), "laid")
    part = F.shiftright("at", 33)
    parts = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = laid.withColumn("part", part).join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("conv_id", "turn", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("at"))
    first = laid.groupBy("conv_id").agg(F.min("at").alias("first"))
    return laid.join(first, "conv_id").select("conv_id", "turn", (F.col("at") - F.col("first")).alias("position"))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message with its place in the reply order of its conversation and its text without quotes.

    Lines are parsed into quotation levels. Consecutive quoted lines of a level are a passage, as one text whatever its line ends; blank lines part passages. Each passage is normalised and hashed, and meets the
    latest earlier message of the conversation that has it as a passage or line of its own. A passage that meets none is met by its sentences, each with
    the latest earlier message that has it, within a line or over line ends: so partial quotes count too. A message replies to the message that
    most characters of its passages and sentences of the lowest level come from (then the latest). Replies of replies are followed to the first message of their thread.
    position numbers the messages of a conversation by (thread_turn, turn): each follows what it replies to.

    Returns (conv_id, turn, role, content, formatted, n_quoted, max_level, parent_turn, thread_turn, depth, position). content holds the own lines,
    of which runs of blank ones at the ends are dropped; formatted wraps them in role marks. A message without quotes, or whose
    quotes are found nowhere, begins a thread of its own (parent null, depth 0). A null role is `unknown`, null text is empty; rows with a null
    conversation or turn stay, unlinked and without position. Of repeated (conv_id, turn) all stay, linked by what any of them quotes, with one position. Texts of any length are read whole. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(messages.sparkSession)
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), lines_of(F.col(text)).alias("lines"))
    base = base.withColumns({
        "max_level": F.array_max(F.transform("lines", lambda x: x["level"])),
        "n_quoted": F.size(F.filter("lines", lambda x: x["level"] > 0)),
        "content": F.regexp_replace(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n"), r"\A\s*\n|\s+\z", ""),
    })
    known = base.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.filter("n_quoted > 0").select("conv_id", "turn", F.explode(passages(F.col("lines"), lambda x: x["level"] > 0)).alias("p")).select("conv_id", "turn", "p.*")
    key = ["conv_id", "turn", "level", "hash"]
    quoted = scratch.written(quoted.select("conv_id", "turn", "level", F.sha2("passage", 256).alias("hash"), F.char_length("passage").alias("chars"), "passage").dropDuplicates(key), "quoted")
    own = known.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    lines = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: normalised(x["content"]))
    blocks = F.transform(passages(F.col("lines"), lambda x: x["level"] == 0), lambda p: p["passage"])
    hashed = lambda texts: own.select("conv_id", "turn", F.explode(F.array_distinct(texts)).alias("t")).filter("t != ''").select("conv_id", "turn", F.sha2("t", 256).alias("hash"))
    met = scratch.written(nearest(quoted.drop("passage"), hashed(F.concat(lines, blocks))), "met")
    rest = quoted.join(met, key, "left_anti").select("conv_id", "turn", "level", F.explode(sentences(F.col("passage"))).alias("s"))
    rest = scratch.written(rest.select("conv_id", "turn", "level", F.sha2("s", 256).alias("hash"), F.char_length("s").alias("chars")).distinct(), "rest")
    if not rest.isEmpty():
        met = met.unionByName(nearest(rest, hashed(F.flatten(F.transform(F.concat(lines, blocks), sentences)))))
    votes = met.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct((-F.col("level")).alias("nearest"), "chars", "parent"))
    parents = votes.groupBy("conv_id", "turn").agg(best.alias("best")).select("conv_id", "turn", F.col("best.parent").alias("parent"))
    parents = scratch.written(parents.withColumns({"top": F.col("parent"), "depth": F.lit(1)}), "parents")
    while True:
        up = parents.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("above"), F.col("depth").alias("more"))
        step = parents.join(up, ["conv_id", "top"], "left").select("conv_id", "turn", "parent", F.coalesce("above", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        step = scratch.written(step, "parents")
        scratch.close(step)
        parents = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    threads = known.select("conv_id", "turn").distinct().join(parents, ["conv_id", "turn"], "left")
    threads = threads.select("conv_id", "turn", "parent", F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    threads = scratch.written(threads.join(positions(threads, scratch), ["conv_id", "turn"]), "threads")
    scratch.close(threads)
    placed = base.join(threads, ["conv_id", "turn"], "left")
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>\n"))
    return placed.select("conv_id", "turn", "role", "content", formatted.alias("formatted"), "n_quoted", "max_level", F.col("parent").alias("parent_turn"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "position")


def with_quotes(messages: DataFrame) -> DataFrame:
    """messages of which each also quotes the one before, from its first line, wrapped after five words, and below it the one before that: for tables in which nobody quotes."""
    first = F.regexp_replace(F.substring_index(F.regexp_replace("text", ">", ""), "\n", 1), r"((?:\S+ ){5})", "$1\n> ")
    before = messages.groupBy("conv_id", "turn").agg(F.min(first).alias("line"))
    once = before.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("> "), "line", F.lit("\n")).alias("quote"))
    twice = before.select("conv_id", (F.col("turn") + 2).alias("turn"), F.concat(F.lit("> > "), F.replace("line", F.lit("\n> "), F.lit("\n> > ")), F.lit("\n")).alias("nested"))
    found = messages.join(once, ["conv_id", "turn"], "left").join(twice, ["conv_id", "turn"], "left")
    return found.select("conv_id", "turn", "role", F.concat(F.coalesce("quote", F.lit("")), F.coalesce("nested", F.lit("")), "text").alias("text"))


def sql(table: str = "conversations") -> str:
    """For texts in which the lines' marks stand at the start; links over several levels of replies are followed by recursion."""
    normal = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    split = "list_filter(list_transform(string_split(regexp_replace(passage, '([.!?…][\"'')\\]”’]?) |([。！？])', '\\1\\2' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role,
                  string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM {table}),
l AS (SELECT rid, conv_id, turn, role, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM m),
p AS (SELECT rid, conv_id, turn, role, pos, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level,
             regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') AS content FROM l),
b AS (SELECT rid, conv_id, turn, role, max(level) AS max_level, CAST(count(*) FILTER (level > 0) AS INTEGER) AS n_quoted,
             regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (level = 0), ''), '\A\s*\n|\s+\z', '', 'g') AS content FROM p GROUP BY ALL),
n AS (SELECT rid, conv_id, turn, pos, level, content, {normal('content')} AS line, pos - row_number() OVER (PARTITION BY rid, level, {normal('content')} = '' ORDER BY pos) AS run
      FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (SELECT rid, conv_id, turn, level, {normal("string_agg(content, chr(10) ORDER BY pos)")} AS passage FROM n WHERE line <> '' GROUP BY rid, conv_id, turn, level, run),
q AS (SELECT DISTINCT conv_id, turn, level, passage FROM g WHERE level > 0),
w AS (SELECT conv_id, turn, line AS passage FROM n WHERE level = 0 AND line <> '' UNION SELECT conv_id, turn, passage FROM g WHERE level = 0),
f AS (SELECT q.conv_id, q.turn, level, passage, max(w.turn) AS parent FROM q JOIN w USING (conv_id, passage) WHERE w.turn < q.turn GROUP BY ALL),
qs AS (SELECT DISTINCT conv_id, turn, level, s FROM (SELECT conv_id, turn, level, unnest({split}) AS s FROM q ANTI JOIN f USING (conv_id, turn, level, passage))),
ws AS (SELECT DISTINCT conv_id, turn, s FROM (SELECT conv_id, turn, unnest({split}) AS s FROM w)),
fs AS (SELECT qs.conv_id, qs.turn, level, s, max(ws.turn) AS parent FROM qs JOIN ws USING (conv_id, s) WHERE ws.turn < qs.turn GROUP BY ALL),
v AS (SELECT conv_id, turn, level, parent, sum(length(passage)) AS found FROM (FROM f UNION ALL FROM fs) GROUP BY ALL),
t AS (SELECT conv_id, turn, parent FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, found DESC, parent DESC) = 1),
up AS (SELECT conv_id, turn, parent, parent AS top, 1 AS depth FROM t UNION ALL
       SELECT up.conv_id, up.turn, up.parent, t.parent, depth + 1 FROM up JOIN t ON t.conv_id = up.conv_id AND t.turn = up.top),
d AS (SELECT conv_id, turn, parent, arg_max(top, depth) AS top, max(depth) AS depth FROM up GROUP BY ALL),
o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(top, turn), turn) - 1 AS position FROM (SELECT DISTINCT conv_id, turn FROM n) LEFT JOIN d USING (conv_id, turn))
SELECT b.conv_id, b.turn, role, content, '<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' || chr(10) AS formatted, n_quoted, CAST(max_level AS INTEGER) AS max_level,
       parent AS parent_turn, coalesce(top, b.turn) AS thread_turn, CAST(coalesce(depth, 0) AS INTEGER) AS depth, position
FROM b LEFT JOIN d ON b.conv_id = d.conv_id AND b.turn = d.turn LEFT JOIN o ON o.conv_id = b.conv_id AND o.turn = b.turn
"""


#: with_quotes() of the table.
QUOTING = r"""(WITH o AS (SELECT conv_id, turn, min(regexp_replace(string_split(replace(text, '>', ''), chr(10))[1], '((?:\S+ ){5})', '\1' || chr(10) || '> ', 'g')) AS line FROM conversations GROUP BY ALL)
 SELECT c.conv_id, c.turn, c.role, coalesce('> ' || a.line || chr(10), '') || coalesce('> > ' || replace(z.line, chr(10) || '> ', chr(10) || '> > ') || chr(10), '') || c.text AS text
 FROM conversations c LEFT JOIN o a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN o z ON z.conv_id = c.conv_id AND z.turn = c.turn - 2)"""

SQL = sql()
SQL_OF_QUOTES = sql(QUOTING)
