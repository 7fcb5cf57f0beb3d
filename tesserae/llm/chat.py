"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar of a formatted conversation::

    conversation = { turn }
    turn         = "### " role LF body LF "</turn>" LF

``role`` is percent-encoded, so it holds no line feed. ``body`` is strict: ``###`` and ``</turn>`` occur in it only
behind a backslash. The parser splits at ``LF </turn> LF``, takes the first line as the header and undoes
``\\\\``, ``\\###`` and ``\\</turn>`` from left to right; any other backslash stands for itself.

Each text is rendered and reparsed; while the parser does not give back the very same text the next of three escape
levels is tried: nothing, the control strings, the control strings and every backslash. The last always succeeds.
As no delimiter can straddle two rendered turns, turns may be tried one by one; the whole conversation is
parsed once more at the end and compared with its source, and a difference stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

END = "\n</turn>\n"
_CONTROL = "###|</turn>"
_ESCAPED = r"\\(\\|###|</turn>)"


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    return F.regexp_replace(text, rf"(\\|{_CONTROL})" if level == 2 else f"({_CONTROL})", r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, _ESCAPED, "$1")


def well_formed(body: Column) -> Column:
    """Whether each control string in ``body`` is escaped."""
    return ~F.regexp_replace(body, _ESCAPED, " ").rlike(_CONTROL)


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), F.url_encode(role), F.lit("\n"), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, body, text>> of a formatted conversation; ``body`` is still escaped."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(head) + 2)
        return F.struct(
            F.url_decode(F.substr(head, F.lit(5))).alias("role"), body.alias("body"), unescape(body).alias("text")
        )

    return F.transform(pieces, turn)


def format_conversations(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn_from: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, turns, formatted, loss_spans``.

    ``turns`` is the source (role, text), ``loss_spans`` (start, length) in code points of ``formatted`` for the
    bodies of ``learn_from`` turns. Null texts and roles are empty strings; rows of a null conversation form one
    conversation; a null turn comes first; rows with equal turn numbers are ordered by role, then text, and repeated
    rows are repeated turns. An empty table gives no row. Other columns are not read, whatever their names.

    One shuffle, by conversation: the running offset (a window) and the list share it. A conversation's turns
    meet in one row, because that row is the result.
    """
    src = df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def returns(level: int) -> Column:
        body = escape(F.col("text"), level)
        back = parse(render(F.col("role"), body))
        return well_formed(body) & (F.size(back) == 1) & (back[0]["text"] == F.col("text"))

    level = F.when(returns(0), 0).when(returns(1), 1).otherwise(2)
    body = F.when(F.col("level") == 0, escape(F.col("text"), 0)).when(F.col("level") == 1, escape(F.col("text"), 1))
    turns = (
        src.withColumn("level", level)
        .withColumn("body", body.otherwise(escape(F.col("text"), 2)))
        .withColumn("piece", render(F.col("role"), F.col("body")))
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = turns.withColumn("pos", F.coalesce(before, F.lit(0)))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text", "body", "piece"))).alias("t")
    )
    lead = F.length(F.lit("### ")) + 1  # and the line feed behind the role
    out = whole.select(
        "conv_id",
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda t: t["role"] == learn_from),
            lambda t: F.struct(
                (t["pos"] + lead + F.length(F.url_encode(t["role"]))).alias("start"),
                F.length(t["body"]).alias("length"),
            ),
        ).alias("loss_spans"),
    )
    back = F.transform(
        parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    same = F.when(back == F.col("turns"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not parse back to its turns"))
    )
    return out.withColumn("formatted", same)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"]))), ""
    )


CONFLICT = r"\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, digested from what the parser reads back."""
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONFLICT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    done = format_conversations(rows.unionByName(own))
    read = done.select(
        "conv_id", "formatted", parse(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH src AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), bodies AS (
  SELECT *,
    CASE
      WHEN NOT regexp_matches(text, '###|</turn>') AND NOT regexp_matches(text, '\\\\') THEN text
      WHEN regexp_replace(regexp_replace(text, '(###|</turn>)', '\\\1', 'g'), '\\(\\|###|</turn>)', '\1', 'g') = text
       AND NOT regexp_matches(regexp_replace(regexp_replace(text, '(###|</turn>)', '\\\1', 'g'), '\\(\\|###|</turn>)', ' ', 'g'), '###|</turn>')
      THEN regexp_replace(text, '(###|</turn>)', '\\\1', 'g')
      ELSE regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')
    END AS body
  FROM src
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length(url_encode(role)) + 14)::BIGINT AS formatted_chars
FROM bodies GROUP BY conv_id
"""
