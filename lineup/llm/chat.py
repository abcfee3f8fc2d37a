"""Operator 7: chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered array of parts ``struct<kind string, text string, ref string, units long>``. A visitor over the array
flattens it into one string: text parts are escaped, an image, audio or document part becomes a placeholder
``<|kind:index:tokens|>``, and an attachment record (kind, reference, placeholder index, expanded token count) is kept. A turn is written
as ``<|turn|>role LF content<|end|> LF``. Escaping touches control strings only and is undone exactly; kinds are escaped too, so neither a
text nor a kind can write a turn or a placeholder, and reading back tells a placeholder from a text that looks like one. Between two text parts that stand
side by side a border mark is written, so that no control string forms across them and reading back returns them as they were.

Defined results: null text is an empty part, a null role an empty role, null parts no parts, a null kind the kind ``unknown``; empty text parts leave no
trace; turns are ordered by turn number (nulls first), then role and content, so repeated rows stay in the conversation; a row with a null
conversation id is a conversation of its own; an empty table gives no rows; extra columns are not read. A conversation must fit in a row, as its digest covers all its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The escape mark, then each control string's opening and what it becomes. The order matters for undoing.
ESCAPES = (("~", "~0"), ("<|", "~1|"), ("</s>", "~1/s>"), ("<s>", "~1s>"), ("[INST]", "~2INST]"), ("[/INST]", "~2/INST]"))
#: Between adjacent text parts; a raw ``~`` is always escaped, so no text can write it.
BORDER = "~3"
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Tokens that a unit of an attachment expands to: image patches, seconds of audio, document pages.
UNIT_TOKENS = {"image": 1, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for code, raw in ((BORDER, ""), ("~1", "<"), ("~2", "["), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _safe_name(x: Column) -> Column:
    """A role or kind, without line ends and marks of placeholders."""
    for raw, code in (("\n", "~n"), (":", "~c"), ("|", "~p")):
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def _name(x: Column) -> Column:
    for raw, code in (("\n", "~n"), (":", "~c"), ("|", "~p")):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return unescape(x)


def text_part(text: Column) -> Column:
    """A message that is plain text, as an array of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def _tokens(part: Column) -> Column:
    per = F.lit(1)
    for kind, n in UNIT_TOKENS.items():
        per = F.when(part["kind"] == kind, n).otherwise(per)
    return (F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * per).cast("bigint")


def _visit(part: Column, index: Column, before: Column) -> Column:
    mark = F.concat(F.lit("<|"), _safe_name(escape(F.coalesce(part["kind"], F.lit("unknown")))), F.lit(":"), index.cast("string"), F.lit(":"), _tokens(part).cast("string"), F.lit("|>"))
    border = F.when((index > 0) & F.coalesce(before["kind"] == "text", F.lit(False)), BORDER).otherwise("")
    return F.when(part["kind"] == "text", F.concat(border, escape(F.coalesce(part["text"], F.lit(""))))).otherwise(mark)


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_spans`` (start from 0 and length, in characters), ``attachments``, ``expanded_tokens``."""
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts")).alias("t"),
    )
    alone = rows.where(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("turns"))
    rows = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).unionByName(alone)
    rows = rows.withColumn(
        "pieces",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), _safe_name(escape(t["role"])), F.lit("\n")).alias("head"),
                F.array_join(F.transform(t["parts"], lambda p, i: _visit(p, i, F.get(t["parts"], i - 1))), "").alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, p):
        at = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(at.cast("bigint").alias("start"), F.length(p["body"]).cast("bigint").alias("length")))
        return F.struct((at + F.length(p["body"]) + len(CLOSE)).cast("bigint").alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    kept = F.flatten(
        F.transform(
            "turns",
            lambda t, n: F.filter(
                F.transform(t["parts"], lambda p, i: F.struct(n.alias("turn_index"), i.alias("part_index"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
                lambda a: ~a["kind"].eqNullSafe(F.lit("text")),
            ),
        )
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", start, step)["spans"].alias("loss_spans"),
        kept.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def _body(x: Column) -> Column:
    return F.substr(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(CLOSE))


def _parts(body: Column, turn: Column) -> Column:
    """Typed parts of a formatted content: raw ``<|`` only opens placeholders there."""

    def text(x):
        part = lambda own: F.struct(F.lit("text").alias("kind"), unescape(own).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
        return F.filter(F.transform(F.split(x, BORDER), part), lambda p: p["text"] != "")

    def rest(x):
        mark = F.split(F.substring_index(x, "|>", 1), ":")
        at = F.get(mark, F.lit(1)).cast("int")
        ref = F.get(F.filter("attachments", lambda a: (a["turn_index"] == turn) & (a["part_index"] == at)), F.lit(0))["ref"]
        own = F.struct(_name(F.get(mark, F.lit(0))).alias("kind"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), F.get(mark, F.lit(2)).cast("bigint").alias("tokens"))
        return F.concat(F.array(own), text(F.substr(x, F.instr(x, "|>") + 2)))

    cut = F.split(body, r"<\|")
    return F.flatten(F.transform(cut, lambda x, i: F.when(i == 0, text(x)).otherwise(rest(x))))


def read_back(df: DataFrame, parts: bool = True) -> DataFrame:
    """Undo ``format_chats``: ``turns`` (role, content, parts; unescaped; in content placeholders of attachments stay as they are written) and ``loss_text``."""
    turns = F.transform(
        F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30),
        lambda x, n: F.struct(_name(F.substring_index(x, "\n", 1)).alias("role"), unescape(_body(x)).alias("content"), *([_parts(_body(x), n).alias("parts")] if parts else [])),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return df.withColumns({"turns": turns, "loss_text": loss})


def digests(df: DataFrame) -> DataFrame:
    """The counts and digests of formatted chats, from what is read back."""
    back = read_back(df, parts=False)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "loss_spans",
        "expanded_tokens",
    ).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = rows.unionByName(own).withColumn("parts", text_part(F.col("text")))
    return digests(format_chats(rows))


_ESCAPED = "text"
for _raw, _safe in ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_raw}', '{_safe}')"
_NAME = "replace(replace(replace(role, chr(10), '~n'), ':', '~c'), '|', '~p')"
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (0, -7, 0, 'user', '</s>[INST] ok [/INST]'), (0, -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum({len(OPEN) + 1 + len(CLOSE)} + length({_ESCAPED.replace("text", "role")}) + length({_NAME}) - length(role) + length({_ESCAPED})) AS chars
  FROM t GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN own END)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
