"""Chat formatting with Spark expressions only.

Template, per block of adjacent turns of one role::

    <s>ROLE\\nTEXT<t>TEXT...</s>

Inside roles and texts ``~``, ``<``, ``[`` and (in roles) line feeds are written
``~0``, ``~1``, ``~2`` and ``~3``; so no control string can occur in a text and
the writing can be undone. The loss mask comes as segments that concatenate to
the formatted string, each either wholly under the mask (one assistant text) or
wholly outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for a, b in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("~3"))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text).

    Returns conv_id, formatted string, segments array<struct<text, loss>>.
    Turns are ordered by turn, then role, then text, nulls first; null roles and
    texts count as empty; repeated rows are turns of their own; rows with a null
    conv_id form one conversation; texts of any length stay whole; other columns
    are ignored; an empty table gives no rows. A conversation is one output row, so its turns meet in one
    task by nature; nothing else does.
    """
    t = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t")
    )
    # Where a block begins: linear in the turns, no growing accumulator.
    t = t.withColumn("starts", F.expr("filter(sequence(1, size(t)), i -> i = 1 OR NOT (t[i - 1].role <=> t[i - 2].role))"))
    t = t.withColumn(
        "blocks",
        F.expr(
            "transform(starts, (s, k) -> named_struct('role', t[s - 1].role, 'texts',"
            " transform(slice(t, s, coalesce(get(starts, k + 1), size(t) + 1) - s), x -> x.text)))"
        ),
    )
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def block(b: Column) -> Column:
        head = F.array(seg(F.concat(F.lit("<s>"), _escape_role(b.role), F.lit("\n")), no))
        texts = F.flatten(
            F.transform(
                b.texts,
                lambda x, i: F.when(i == 0, F.array(seg(escape(x), b.role == LOSS_ROLE))).otherwise(F.array(seg(F.lit("<t>"), no), seg(escape(x), b.role == LOSS_ROLE))),
            )
        )
        return F.concat(head, texts, F.array(seg(F.lit("</s>"), no)))

    t = t.withColumn("segments", F.flatten(F.transform("blocks", block)))
    return t.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, undone."""
    blocks = F.split(formatted, "</s>", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        cut = F.locate("\n", b)
        role = F.substring(b, F.lit(4), cut - 4)
        body = F.substring(b, cut + 1, F.length(b))
        return F.transform(F.split(body, "<t>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The digest columns, read back from ``formatted`` and ``segments`` of :func:`format_chat`."""
    d = formatted.withColumn("turns", read_back(F.col("formatted")))
    d = d.withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
