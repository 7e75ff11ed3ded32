"""Chat formatting by prefix-target expansion, native.

A conversation becomes one example per assistant turn: all turns before it are
context, and of the example only that reply is trainable. Turns after the last
reply end in an example of their own, of which nothing is trainable, so no turn
is lost. Each turn is written START role SEPARATOR text END; control strings
inside roles and texts (the template's own and those of other templates) get a
backslash after their first character, and a backslash is doubled, so reading
back undoes it exactly.

Defined cases: null roles and texts are empty; rows without a conv_id are
conversations of one turn each; turns of equal number are ordered by role, then
text; a null turn comes first; a conversation, its longest example included, is
one row, so turns of any length are whole; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, whole

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a text may not hold unescaped.
CONTROL = (
    START, SEPARATOR, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) to examples: conv_id, alone (tells conversations without a conv_id
    apart), example (from 0), formatted, loss_start and loss_length (characters of formatted; length 0: context only), is_whole
    (the example holds all turns)."""
    return _expand(_turns(turns), trained_role)


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, alone, turn, role, text; alone keeps rows without a conv_id apart."""
    rows = need(turns, "conv_id", "turn", "role", "text").withColumns({"role": whole(F.col("role")), "text": whole(F.col("text"))})
    return rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))


def _expand(rows: DataFrame, trained_role: str) -> DataFrame:
    convs = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = convs.select(
        "conv_id", "alone",
        F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEPARATOR), escape(t["text"]), F.lit(END))).alias("written"),
        F.transform("turns", lambda t: F.when(t["role"] == trained_role, F.length(escape(t["text"]))).otherwise(F.lit(-1))).alias("reply"),
    )
    n = F.size("written")
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("reply", i) >= 0) | (i == n - 1))
    return convs.select(
        "conv_id", "alone", n.alias("n"), "written", "reply", F.posexplode(ends).alias("example", "last")
    ).select(
        "conv_id", "alone", "example",
        F.array_join(F.slice("written", 1, F.col("last") + 1), "").alias("formatted"),
        F.greatest(F.get("reply", F.col("last")), F.lit(0)).alias("loss_length"),
        (F.col("last") == F.col("n") - 1).alias("is_whole"),
    ).withColumn(
        "loss_start", F.length("formatted") - F.lit(len(END)) - F.col("loss_length")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars (over all its examples). They lie together already, so nothing is shuffled."""
    between = lambda a, b: F.regexp_extract_all("formatted", F.lit(f"(?s){_quoted(a)}(.*?){_quoted(b)}"), F.lit(1))
    roles, texts = between(START, SEPARATOR), between(SEPARATOR, END)
    told = F.array_join(F.zip_with(roles, texts, lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n"))), "")
    parts = examples.select(
        "conv_id", "alone", "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_whole"), F.struct(F.size(roles).cast("long").alias("n"), F.sha2(told, 256).alias("sha"))).alias("whole"),
        unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"),
    )
    grouped = parts.groupBy("conv_id", "alone").agg(
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    return grouped.select(
        "conv_id", F.col("whole.n").alias("n_turns"), F.col("whole.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "<|>[]()" else c for c in s)


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', -7
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', -7),
l AS (
  SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(START) + len(SEPARATOR) + len(END)} AS n FROM t),
k AS (
  SELECT *, sum(n) OVER w AS upto, lead(conv_id) OVER w IS NULL AND row_number() OVER w = count(*) OVER (PARTITION BY conv_id, alone) AS is_last
  FROM l WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR is_last))::BIGINT AS formatted_chars
FROM k GROUP BY conv_id, alone
"""


def chat_report(turns: DataFrame) -> DataFrame:
    """Every conversation, and conversation -7, formatted and read back. A conversation -7 of the table is another."""
    probe = _turns(probe_conversation(turns.sparkSession)).withColumn("alone", F.lit(-7).cast("long"))
    return read_back(_expand(_turns(turns).union(probe), "assistant"))
