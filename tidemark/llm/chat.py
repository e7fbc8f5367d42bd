"""Operator 2: chat formatting by a grammar round trip.

A conversation is rendered turn by turn as

    ### ROLE:\\n TEXT </turn>\\n          (without the blanks shown here)

A deterministic parser reads rendered text back: it cuts at the turn ends, takes the role up to the
first unescaped colon, refuses a text in which a control string stands unescaped, and undoes the
escapes (a backslash stands for the character behind it). Rendering starts without escapes. The
parser's turns are compared with the source; a conversation that doesn't come back identical is
rendered again with its conflicting texts and roles escaped, and compared again. A conversation that
would still differ stops the job, so that what is returned is proven to be reversible.

The loss mask is a list of spans of the formatted text: what stands between the header and the turn
end of each assistant turn.

Everything is DataFrame functions over one grouping by conversation. A conversation is one row of
output, so its turns meet in one task; different conversations spread evenly, also when many have the
same texts.

Cases: null texts and roles are empty ones. Rows with the same turn number are ordered by role, then
text; repeated rows stay. A null conv_id is a conversation. An empty table gives no rows. Other
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import sums_before
from tidemark.llm.tables import read

OPEN, CLOSE, END = "### ", ":\n", "</turn>\n"
#: What a text holds if it has to be escaped.
CONFLICT = r"\\|### |</turn>"
#: What a parsed body must not hold unescaped: a header, whose mark is escaped by a backslash before it.
STRAY = r"(?<!\\)(?:\\\\)*### "
HEADED = r"(?s)^### ((?:[^\\:]++|\\.)*+):\n(.*)$"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("### "), F.lit("\\### "))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """The conversation's text from an array of (role, text) that are escaped already."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation; null for a text that the grammar doesn't have."""
    cut = F.split(formatted, END, -1)
    segments = F.slice(cut, 1, F.size(cut) - 1)  # nothing stands behind the last turn end
    role = lambda s: F.regexp_extract(s, HEADED, 1)
    body = lambda s: F.regexp_extract(s, HEADED, 2)
    wrong = lambda s: ~s.rlike(HEADED) | body(s).rlike(STRAY) | body(s).contains("</turn>")
    turns = F.transform(segments, lambda s: F.struct(unescape(role(s)).alias("role"), unescape(body(s)).alias("text")))
    return F.when((F.element_at(cut, -1) == "") & ~F.exists(segments, wrong), turns)


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points) and escaped (whether it was needed).

    messages: conv_id, turn, role, text.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    safe = lambda t: F.struct(
        F.when(t["role"].rlike(CONFLICT + "|:"), escape_role(t["role"])).otherwise(t["role"]).alias("role"),
        F.when(t["text"].rlike(CONFLICT), escape(t["text"])).otherwise(t["text"]).alias("text"),
    )
    chats = chats.select("conv_id", plain.alias("source")).withColumn("first", render(F.col("source")))
    chats = chats.withColumn("same", parse(F.col("first")).eqNullSafe(F.col("source")))
    chats = chats.withColumn("written", F.when(F.col("same"), F.col("source")).otherwise(F.transform("source", safe)))
    chats = chats.withColumn("formatted", F.when(F.col("same"), F.col("first")).otherwise(render(F.col("written"))))
    proven = F.col("same") | parse(F.col("formatted")).eqNullSafe(F.col("source"))
    chats = chats.withColumn("formatted", F.when(proven, F.col("formatted")).otherwise(F.raise_error("a conversation can't be read back").cast("string")))
    head = lambda t: F.length(t["role"]) + len(OPEN + CLOSE)
    sizes = F.transform("written", lambda t: (head(t) + F.length(t["text"]) + len(END)).cast("long"))
    masked = F.arrays_zip(F.col("written").alias("turn"), F.col("source").alias("source"), sums_before(sizes).alias("at"))
    spans = F.transform(
        F.filter(masked, lambda m: m["source"]["role"] == "assistant"),
        lambda m: F.struct((m["at"] + head(m["turn"])).cast("int").alias("start"), F.length(m["turn"]["text"]).alias("length")),
    )
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"), (~F.col("same")).alias("escaped"))


#: The conversation added to the table: its texts hold the template's own control strings.
PLANTED = r"\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant")))))
    planted = spark.range(1).select(said.alias("t")).select(F.lit(-7).alias("conv_id"), "t.turn", "t.role", F.lit(PLANTED).alias("text"))
    chats = format_chats(messages.unionByName(planted)).withColumn("turns", parse(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # A text's span counts code points; the formatted text is cut at the spans, then freed of its escapes.
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    chats = chats.withColumns({"told": told, "loss": loss})
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
