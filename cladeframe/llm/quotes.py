"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

Lines are parsed into quote levels, quoted passages are normalised and hashed, the hashes are joined to the
messages that wrote the passages themselves, and the links make a forest of replies. Messages that quote
nothing known follow the turn before them. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import BROADCAST_IDS, global_index, need, staged
from cladeframe.llm.spans import let

MARKS = r"^(?:[\x20\t]?>)+"
QUOTING = r"(?m)^[\x20\t]?>"
#: A line that introduces a quotation: it goes with the quotation.
ATTRIBUTION = r"(?i)^\x20*(?:on|le|am|el)\b.{3,200}\b(?:wrote|a écrit|schrieb|escribió)\x20*:\x20*$"
#: Normalised passages shorter than this many characters link only within a conversation; elsewhere they'd meet by chance.
LEAST = 8
RUNS = "array<struct<level:int,text:string>>"


def parsed_lines(text: Column) -> Column:
    """array of (level, text): how many quote marks a line has, and the line without them."""
    return F.transform(
        F.split(text, r"\r?\n"),
        lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS + r"[\x20\t]?", "").alias("text")),
    )


def quoted_runs(lines: Column) -> Column:
    """Successive lines of one level above 0, put together."""

    def cut(own: Column) -> Column:
        n = F.size(own)
        level = lambda i: F.element_at(own, i)["level"]
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))

        def joined(b: Column) -> Column:
            ends = F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(n + 1))
            texts = lambda i, j: F.array_join(F.transform(F.slice(own, i, j - i), lambda x: x["text"]), "\n")
            runs = F.zip_with(b, ends, lambda i, j: F.when(level(i) > 0, F.struct(level(i).alias("level"), texts(i, j).alias("text"))))
            return F.filter(runs, lambda r: r.isNotNull())

        return let(begins, joined)

    return F.when(F.size(lines) > 0, let(lines, cut)).otherwise(F.array().cast(RUNS))


def own_words(lines: Column) -> Column:
    """The lines of level 0, without those that introduce a quotation."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")


def passages(text: Column) -> Column:
    """Distinct normalised passages of a text: all of it, its paragraphs, lines and sentences."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"), F.split(text, r"(?<=[.!?])\s+"))
    plain = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.filter(plain, lambda x: F.length(x) > 0))


def hashes(text: Column) -> Column:
    """array of (h, g, length): two 64-bit hashes and the length of each passage."""
    return F.transform(passages(text), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.reverse(x)).alias("g"), F.length(x).alias("length")))


def linked(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text), numbered: id, conv_id, turn, role, body, n_quotes, parent, how.

    The id follows conv_id and turn (then the text, for rows that share both). A quoted passage's original
    is the first message that wrote it itself, in the quoting message's conversation if one did, else anywhere,
    and always an earlier one; passages of under LEAST characters are sought in the same conversation only. Of a message's
    passages the one of the outermost level, then of LEAST characters or more, then in the same conversation, then the longest decides. Else the parent is the turn before; the first turn has none. how: quote, turn or first.
    """
    need(messages, "conv_id", "turn", "role", "text")
    spark = messages.sparkSession
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = staged(global_index(rows, [F.col("conv_id"), F.col("turn"), F.xxhash64("text")], "id", "messages"), "numbered")
    lines = parsed_lines(F.col("text"))
    quoting = F.col("text").rlike(QUOTING)
    split = numbered.withColumn("_lines", F.when(quoting, lines))
    split = split.select(
        "id",
        "conv_id",
        "turn",
        "role",
        F.coalesce(own_words(F.col("_lines")), F.col("text")).alias("body"),
        F.coalesce(quoted_runs(F.col("_lines")), F.array().cast(RUNS)).alias("quotes"),
    )
    split = staged(split, "split")
    asked = split.where(F.size("quotes") > 0).select("id", "conv_id", F.explode("quotes").alias("q")).select("id", "conv_id", "q.level", F.explode(hashes(F.col("q.text"))).alias("p"))
    asked = staged(asked.select("id", "conv_id", "level", "p.h", "p.g", "p.length"), "asked")
    wanted = staged(asked.select("h").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    told = split.select("id", "conv_id", F.explode(hashes(F.col("body"))).alias("p")).select("id", "conv_id", "p.h", "p.g", "p.length")
    # Only passages that someone quotes are kept; each has one row a conversation at most.
    told = told.join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
    near = staged(told.groupBy("conv_id", "h", "g").agg(F.min("id").alias("near"), F.max("length").alias("length")), "originals")
    far = staged(near.where(F.col("length") >= LEAST).groupBy("h", "g").agg(F.min("near").alias("far")), "first-originals")
    met = asked.join(near.drop("length"), ["conv_id", "h", "g"], "left").join(far, ["h", "g"], "left")
    here = F.col("near") < F.col("id")
    met = met.withColumn("same", F.coalesce(here, F.lit(False)).cast("int")).withColumn("parent", F.when(here, F.col("near")).when(F.col("far") < F.col("id"), F.col("far")))
    best = F.max_by("parent", F.struct(-F.col("level"), F.col("length") >= LEAST, F.col("same"), F.col("length"), -F.col("parent")))
    found = met.where("parent IS NOT NULL").groupBy("id").agg(best.alias("quoted"))
    before = split.select((F.col("id") + 1).alias("id"), F.col("conv_id").alias("_conv"), F.col("id").alias("_before"))
    out = split.join(found, "id", "left").join(before, "id", "left")
    turn = F.when(F.col("_conv").eqNullSafe(F.col("conv_id")) & F.col("_before").isNotNull(), F.col("_before"))
    how = F.when(F.col("quoted").isNotNull(), "quote").when(turn.isNotNull(), "turn").otherwise("first")
    return out.select("id", "conv_id", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("quoted", turn).alias("parent"), how.alias("how"))


def rooted(links: DataFrame) -> DataFrame:
    """id, root, depth from id, parent, where a parent's id is always smaller: pointers are doubled until all reach a root."""
    is_root = F.col("parent").isNull()
    now = links.select("id", F.col("parent").alias("up"), F.when(is_root, 0).otherwise(1).cast("long").alias("depth"), F.when(is_root, F.col("id")).alias("root"))
    now = staged(now, "pointers")
    while not (open_ := now.where("root IS NULL")).isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"))
        moved = open_.drop("root").join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("root"))
        now = staged(now.where("root IS NOT NULL").unionByName(moved), "pointers")
    return now.select("id", "root", "depth")


def conversations(messages: DataFrame) -> DataFrame:
    """Messages without their quotations, in reply order.

    conv_id, turn, role, body, n_quotes, how, parent_conv, parent_turn (null for first), thread_conv,
    thread_turn (the message the thread starts with), depth (replies from there), position (from 0 in its
    thread, parents before replies). Null and empty texts have an empty body; repeated rows are messages of
    their own; an empty table gives an empty result.
    """
    links = staged(linked(messages), "links")
    placed = links.join(rooted(links.select("id", "parent")), "id")
    ordered = staged(global_index(placed, [F.col("root"), F.col("id")], "_at", "threads"), "in-order")
    first = ordered.groupBy("root").agg(F.min("_at").alias("_first"))
    who = links.select(F.col("id").alias("_id"), F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
    parent = who.select(F.col("_id").alias("parent"), F.col("_c").alias("parent_conv"), F.col("_t").alias("parent_turn"))
    start = who.select(F.col("_id").alias("root"), F.col("_c").alias("thread_conv"), F.col("_t").alias("thread_turn"))
    heads = staged(first.join(start, "root"), "heads")
    out = ordered.join(heads, "root").join(parent, "parent", "left")
    return out.select("conv_id", "turn", "role", "body", "n_quotes", "how", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", (F.col("_at") - F.col("_first")).alias("position"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its parent, order and text without quotes; nulls, ties and repeated rows as in conversations()."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
