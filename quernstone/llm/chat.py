r"""Chat formatting: typed content parts, flattened into one escaped, reversible transcript.

The template is `<turn:ROLE>` BODY `</turn>` per turn. In roles and bodies a backslash becomes `\b` and
`<` becomes `\l`, in roles `>` also `\g`, so neither a marker nor a placeholder can occur in content; `unescape` reverses it.
Parts other than text become placeholders `<image:0>`, `<audio:1>`, `<document:2>`, numbered in order
through the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read
from quernstone.llm.spans import prefix_sums

OPEN, SHUT, END = "<turn:", ">", "</turn>"
ATTACHED = ("image", "audio", "document")
PARTS = "array<struct<type:string,text:string,uri:string,units:bigint>>"
#: Tokens that a placeholder expands to for each unit: image tiles, seconds of audio, pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
#: Rough text tokens: a word, or a run of other visible characters.
TEXT_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A single text part, for conversations whose turns are plain text."""
    part = F.struct(
        F.lit("text").alias("type"),
        text.alias("text"),
        F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("bigint").alias("units"),
    )
    return F.array(part).cast(PARTS)


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: conv_id, n_turns, formatted, loss_spans, attachments, text_tokens, expanded_tokens.

    `turns` needs conv_id, turn, role and parts (PARTS). Turns are ordered by turn (null first), then
    role and content, so ties and repeated rows have one order and are all kept. Null role, parts or
    text count as empty. A part whose type is not image, audio or document is text. A null conv_id is
    a conversation of its own. An empty table gives an empty result; other columns are ignored.
    loss_spans: array<struct<s, e>> over `formatted` in code points, one per turn of `loss_role`,
    its body only. attachments: array<struct<id, turn_no, type, uri, tokens>>. expanded_tokens counts a
    placeholder as UNIT_TOKENS of its type times its units (1 at least, null: 1).

    A conversation is one output string, so its turns meet in one task; that is the row's own size,
    not a group of rows. Conversations are spread by hash over all partitions.
    """
    kind = lambda p: F.when(p["type"].isin(*ATTACHED), p["type"]).otherwise("text")
    flat = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.transform(
            F.coalesce("parts", F.expr(f"cast(array() as {PARTS})")),
            lambda p: F.struct(
                kind(p).alias("type"),
                F.coalesce(p["text"], F.lit("")).alias("text"),
                p["uri"].alias("uri"),
                F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)).alias("units"),
            ),
        ).alias("parts"),
    )
    each = F.array_sort(F.collect_list(F.struct("turn", "role", "parts")))
    chats = flat.groupBy("conv_id").agg(each.alias("turns"))
    # the number of the first attachment of each turn
    count = lambda t: F.size(F.filter(t["parts"], lambda p: p["type"] != "text"))
    chats = chats.withColumn("firsts", prefix_sums(F.transform("turns", count)))

    def visit(parts: Column, first: Column) -> Column:
        """Each part with its attachment's number."""
        flags = F.transform(parts, lambda p: F.when(p["type"] != "text", 1).otherwise(0))
        return F.zip_with(
            parts, prefix_sums(flags), lambda p, before: F.struct(p.alias("p"), (first + before).alias("id"))
        )

    chats = chats.withColumn(
        "turns",
        F.zip_with("turns", "firsts", lambda t, f: F.struct(t["role"].alias("role"), visit(t["parts"], f).alias("parts"))),
    )
    body = lambda t: F.array_join(
        F.transform(
            t["parts"],
            lambda x: F.when(x["p"]["type"] == "text", escape(x["p"]["text"])).otherwise(
                F.concat(F.lit("<"), x["p"]["type"], F.lit(":"), x["id"].cast("string"), F.lit(">"))
            ),
        ),
        "",
    )
    chats = chats.withColumn(
        "pieces",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SHUT)).alias("head"),
                body(t).alias("body"),
            ),
        ),
    )
    lengths = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))
    chats = chats.withColumn("starts", prefix_sums(lengths))
    loss = F.filter(
        F.zip_with(
            "pieces",
            "starts",
            lambda p, s: F.struct(
                (s + F.length(p["head"])).alias("s"),
                (s + F.length(p["head"]) + F.length(p["body"])).alias("e"),
                (p["role"] == loss_role).alias("on"),
            ),
        ),
        lambda x: x["on"],
    )
    rates = F.create_map(*[F.lit(x) for pair in UNIT_TOKENS.items() for x in pair])
    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(
                F.filter(t["parts"], lambda x: x["p"]["type"] != "text"),
                lambda x: F.struct(
                    x["id"].alias("id"),
                    i.alias("turn_no"),
                    x["p"]["type"].alias("type"),
                    x["p"]["uri"].alias("uri"),
                    (F.element_at(rates, x["p"]["type"]) * x["p"]["units"]).alias("tokens"),
                ),
            ),
        )
    )
    texts = F.flatten(F.transform("turns", lambda t: F.transform(t["parts"], lambda x: x["p"])))
    text_tokens = F.aggregate(
        F.filter(texts, lambda p: p["type"] == "text"),
        F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.regexp_count(p["text"], F.lit(TEXT_TOKEN)),
    )
    chats = chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(loss, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("loss_spans"),
        attachments.alias("attachments"),
        text_tokens.alias("text_tokens"),
    )
    expanded = F.aggregate("attachments", F.col("text_tokens"), lambda acc, a: acc + a["tokens"])
    return chats.withColumn("expanded_tokens", expanded)


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a transcript; placeholders stay in the text."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), SHUT, 1)).alias("role"),
            unescape(
                F.substring(p, F.length(F.substring_index(p, SHUT, 1)) + 2, F.length(p))
            ).alias("text"),
        ),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", saying), (-7, 1, "assistant", saying)], "conv_id long, turn long, role string, text string"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(turns.withColumn("parts", text_parts(F.col("text"))))
    said = F.array_join(
        F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["s"] + 1, x["e"] - x["s"]))), ""
    )
    return chats.withColumn("_loss", loss).select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"),
        "expanded_tokens",
    )


#: sha256 of the same texts, taken from the table instead of the transcript.
OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
counted AS (
  SELECT *, length(role) + length(text) + 8 + 6
    + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')))
    + (length(text) - length(replace(replace(text, '\', ''), '<', ''))) AS chars,
    CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+')) AS BIGINT) AS tokens
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments,
  CAST(sum(tokens) AS BIGINT) AS expanded_tokens
FROM counted GROUP BY conv_id
"""
