"""Chat formatting into budgeted windows.

Turns of a conversation are in order of ``turn`` (null first), role and text.  Their
running token counts cut the conversation at multiples of the room that a window
has for new turns: the turns inside one such stretch make a span, a turn across its
end makes a span of its own, so no span exceeds the room unless a single turn does.
Every span becomes a window: the conversation's first system turn, then the turns
before the span whose tokens fit into the history, then the new turns.  The loss
mask covers the texts of new assistant turns only, so a repeated target is masked
out and each target is learned once.

Tokens are counted on the formatted line of a turn, template and escapes included, so a
window never holds more than the budget, with one exception: turns are not divided, and
one that is longer than the budget makes a window of its own.  The history shrinks to
what the new turns leave, and a system turn that does not fit beside them is left out of
that window.

Template: ``<turn>`` role, line feed, text, ``</turn>``, line feed.  Inside roles and
texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, inside roles a line feed
becomes ``\\n``; no control string can appear in a text and every step can be undone.

No step holds a conversation in one task: running counts are sums over blocks of
turn numbers plus sums inside a block, and the history is a range join by blocks of
the running count.  Only the digests of the query, which are defined over whole
conversations, gather one.

Defined cases: null texts and roles count as empty; null conversation ids are one
conversation; equal rows are turns of their own; an empty table gives an empty
table; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm.words import bucket_offsets, same
from hearsay.session import cut_lineage

OPEN, CLOSE = "<turn>", "</turn>\n"
BUDGET = 512
HISTORY = 96
LEAST_ROOM = 64
TURNS_PER_BLOCK = 1024
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\x20\x09-\x0D]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def line(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(CLOSE))


def tokens(role: Column, text: Column) -> Column:
    """Tokens of a formatted turn; lines end in a break, so those of a window add up."""
    return F.regexp_count(line(role, text), F.lit(TOKEN))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``seq`` (place in the conversation) and the running count ``start``, ``end``."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = (clean.withColumn("tokens", tokens(F.col("role"), F.col("text")).cast("long"))
               .withColumn("_block", F.floor(F.col("turn") / TURNS_PER_BLOCK)))
    totals = counted.groupBy("conv_id", "_block").agg(
        F.sum("tokens").alias("_tokens"), F.count(F.lit(1)).alias("_turns"))
    offsets = bucket_offsets(totals, ["conv_id"], "_block",
                             {"_before": "_tokens", "_earlier": "_turns"})
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = same(counted.withColumn("_upto", F.sum("tokens").over(upto))
                  .withColumn("_place", F.row_number().over(inside)), offsets, ["conv_id", "_block"])
    return (placed.withColumn("seq", F.col("_earlier") + F.col("_place") - 1)
            .withColumn("end", F.col("_before") + F.col("_upto"))
            .withColumn("start", F.col("end") - F.col("tokens"))
            .select("conv_id", "seq", "role", "text", "tokens", "start", "end"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, window, text, n_context, n_turns, loss)``.

    ``n_context`` turns at the head of the text are repeated ones; ``loss`` lists the
    code-point ranges ``[start, end)`` of ``text`` that are learned.
    """
    placed = cut_lineage(_numbered(turns))     # read by every part below
    system = (placed.where("role = 'system'").groupBy("conv_id")
              .agg(F.min(F.struct("seq", "text", "tokens", "end")).alias("_s"))
              .select("conv_id", F.col("_s.seq").alias("sys_seq"), F.col("_s.text").alias("sys_text"),
                      F.col("_s.tokens").alias("sys_tokens"), F.col("_s.end").alias("sys_end")))
    room = F.greatest(F.lit(LEAST_ROOM), F.lit(budget - history) - F.coalesce("sys_tokens", F.lit(0)))
    first, last = F.floor(F.col("start") / F.col("_room")), F.floor((F.col("end") - 1) / F.col("_room"))
    spanned = (same(placed, system, ["conv_id"], "left").withColumn("_room", room)
               .withColumn("window", first * 2 + (last > first).cast("long")))
    spans = spanned.groupBy("conv_id", "window").agg(
        F.min("start").alias("span_start"), F.sum("tokens").alias("_own"), F.first("sys_seq").alias("sys_seq"),
        F.first("sys_text").alias("sys_text"), F.first("sys_end").alias("sys_end"),
        F.first("sys_tokens").alias("sys_tokens"))
    fits = (F.col("sys_end") <= F.col("span_start")) & (F.col("sys_tokens") + F.col("_own") <= budget)
    spans = (spans.withColumn("_head", F.when(fits, F.col("sys_tokens")).otherwise(0))
             .withColumn("_left", F.least(F.lit(history), F.lit(budget) - F.col("_own") - F.col("_head"))))

    new = spanned.select("conv_id", "window", "seq", F.lit(True).alias("new"), "role", "text")
    head = (spans.where("_head > 0")
            .select("conv_id", "window", F.col("sys_seq").alias("seq"), F.lit(False).alias("new"),
                    F.lit("system").alias("role"), F.col("sys_text").alias("text")))
    reach = placed.where(F.col("tokens") <= history).withColumn("_near", F.explode(F.sequence(
        F.floor(F.col("end") / history), F.floor((F.col("start") + history) / history))))
    near = spans.where("_left > 0").select("conv_id", "window", "span_start", "_left",
                                           F.floor(F.col("span_start") / history).alias("_near"))
    repeated = (same(reach, near, ["conv_id", "_near"])
                .where((F.col("span_start") >= F.col("end"))
                       & (F.col("span_start") - F.col("start") <= F.col("_left")))
                .select("conv_id", "window", "seq", F.lit(False).alias("new"), "role", "text"))

    lines = F.transform("_turns", lambda t: line(t["role"], t["text"]))
    gathered = (new.union(head).union(repeated)
                .groupBy("conv_id", "window")
                .agg(F.sort_array(F.collect_set(F.struct("seq", "new", "role", "text"))).alias("_turns"))
                .withColumn("_lines", lines)
                .withColumn("_ends", F.aggregate(
                    F.transform("_lines", lambda x: F.length(x).cast("long")),
                    F.expr("cast(array(0) as array<bigint>)"),
                    lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))))
    spans_of = F.transform("_turns", lambda t, i: F.struct(
        (F.col("_ends")[i] + len(OPEN) + F.length(escape_role(t["role"])) + 1).alias("start"),
        (F.col("_ends")[i + 1] - len(CLOSE)).alias("end"),
        (t["new"] & (t["role"] == "assistant")).alias("learned")))
    return gathered.select(
        "conv_id", "window", F.array_join("_lines", "").alias("text"),
        F.size(F.filter("_turns", lambda t: ~t["new"])).cast("long").alias("n_context"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.transform(F.filter(spans_of, lambda s: s["learned"]),
                    lambda s: F.struct(s["start"], s["end"])).alias("loss"))


def read_turns(text: Column, n_context: Column) -> Column:
    """The new turns of a window's text, as an array of ``(role, text)``."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, n_context.cast("int") + 1, F.size(parts) - 1 - n_context.cast("int"))

    def parse(part: Column) -> Column:
        body = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(
            F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(parts, parse)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: turns, learned text and lengths."""
    read = formatted.select(
        "conv_id", "window", F.length("text").alias("_chars"),
        read_turns(F.col("text"), F.col("n_context")).alias("_new"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(
            F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
            "").alias("_learned"))
    pieces = read.select(
        "conv_id", "_chars", F.struct(
            "window", F.size("_new").alias("n"),
            F.array_join(F.transform("_new", lambda t: F.concat(
                t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.col("_learned").alias("learned")).alias("_piece"))
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("_piece")).alias("_p"), F.sum("_chars").alias("formatted_chars"))
    return (whole
            .withColumn("_turns", F.array_join(F.col("_p.turns"), ""))
            .withColumn("_loss", F.array_join(F.col("_p.learned"), ""))
            .select("conv_id",
                    F.aggregate(F.col("_p.n"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_turns"),
                    F.sha2("_turns", 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say strings that look like a template's."""
    said = r"\### Assistant: </turn> ok"
    return (spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text")))
