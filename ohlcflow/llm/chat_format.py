"""Chat formatting with typed content parts (DataFrame functions only).

A message is a role and an ordered list of parts; a part is text, image, audio or
document.  Parts become formatted text: neighbouring texts are joined, then escaped, an
attachment becomes its placeholder, and its reference and expanded token count are
recorded in the order of the placeholders.  A turn is

    <s>ROLE newline CONTENT </s>

with the content of an assistant as it is and that of any other role between
``[INST] `` and `` [/INST]``; a conversation is its turns one after the other.

Control strings inside texts and roles are escaped reversibly: one backslash goes
behind the first character of a control string, and of one that already has
backslashes there, so unescaping takes exactly one away.  Percent signs and line
ends of a role are written as %25 and %0A.

Output per conversation: ``formatted``, ``turn_spans`` (byte start and length of every
turn), ``loss_spans`` (byte start and length of every assistant content, in order),
``attachments`` (part type, reference, tokens), ``expanded_tokens``.  Spans count
UTF-8 bytes, so reading one back costs its own length only.

Rows are escaped and formatted one by one, before the shuffle; the group that then
gathers a conversation holds only its finished turns, as its one formatted string must.
Defined results: null role or text is empty; rows without a conversation id form one
conversation of their own; turns with equal numbers (or none, which come first) are
ordered by role, then text; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
BEGIN, END = "<s>", "</s>"
INST, INST_END = "[INST] ", " [/INST]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 1024}
LOSS_ROLE = "assistant"

#: What a control string is, without its first character.
_REST = r"(/?s>|/?INST\]|IMG\]|AUD\]|DOC\])"

PARTS_TYPE = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A message's content that is text only."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("tokens"))).cast(PARTS_TYPE)


def placeholder(part: Column) -> Column:
    """Placeholder of an attachment; null for any other part."""
    mark = F.lit(None).cast("string")
    for kind, shown in PLACEHOLDERS.items():
        mark = F.when(part["type"] == kind, F.lit(shown)).otherwise(mark)
    return mark


def attachment_places(parts: Column) -> Column:
    """0, the places of the attachments (from 1) and the place behind the last part."""
    places = F.filter(F.transform(parts, lambda p, i: F.when(p["type"].isin(*PLACEHOLDERS), i + 1)),
                      lambda i: i.isNotNull())
    return F.concat(F.array(F.lit(0)), places, F.array(F.size(parts) + 1))


def visit(parts: Column, places: Column) -> Column:
    """Formatted text of all parts; unknown part types are formatted as text.

    Texts between two attachments are joined before they are escaped: a control string may
    form across them."""
    def run(end: Column, i: Column) -> Column:
        first = F.get(places, i)
        texts = F.transform(F.slice(parts, first + 1, end - first - 1), lambda p: F.coalesce(p["text"], F.lit("")))
        return F.concat(escape(F.array_join(texts, "")), F.coalesce(placeholder(F.get(parts, end - 1)), F.lit("")))

    return F.array_join(F.transform(F.slice(places, F.lit(2), F.size(places) - 1), run), "")


def attachments(parts: Column) -> Column:
    """References and expanded token counts of the attachments, in order."""
    def tokens(p: Column) -> Column:
        given = p["tokens"]
        for kind, n in DEFAULT_TOKENS.items():
            given = F.when((p["type"] == kind) & given.isNull(), F.lit(n)).otherwise(given)
        return given.cast("bigint")

    kept = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDERS))
    return F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"),
                                                tokens(p).alias("tokens")))


def bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def format_turns(messages: DataFrame) -> DataFrame:
    """One row per message (``conv_id``, ``turn``, ``role``, ``parts``) with its formatted turn
    ``shown``, the byte place of its loss content inside it and its attachments."""
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(PARTS_TYPE)).alias("parts"))
    m = m.withColumn("places", attachment_places(F.col("parts")))
    m = m.withColumn("content", visit(F.col("parts"), F.col("places")))
    m = m.withColumn("head", F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n")))
    loss = F.col("role") == LOSS_ROLE
    body = F.when(loss, F.col("content")).otherwise(F.concat(F.lit(INST), F.col("content"), F.lit(INST_END)))
    return m.select(
        "conv_id", "turn", "role", F.concat("head", body, F.lit(END)).alias("shown"),
        F.when(loss, bytes_of(F.col("head"))).alias("loss_from"),
        F.when(loss, bytes_of(F.col("content"))).alias("loss_length"),
        attachments(F.col("parts")).alias("attachments"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation; see the module's text.

    The window gives every turn its byte start; the group by the same key reuses its shuffle."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "shown")
    upto = F.sum(bytes_of(F.col("shown"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = format_turns(messages).withColumn("start", upto - bytes_of(F.col("shown")))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "start", "shown", "loss_from", "loss_length", "attachments"))).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["loss_length"].isNotNull()), lambda t: F.struct(
        (t["start"] + t["loss_from"]).alias("start"), t["loss_length"].alias("length")))
    c = c.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(
            t["start"].alias("start"), bytes_of(t["shown"]).alias("length"))).alias("turn_spans"),
        loss.alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"))
    return c.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0).cast("bigint"))))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: ``turns`` (role, content without escapes) and ``loss_text``.

    Attachments show as their placeholders in a turn's content."""
    def turn(shown: Column) -> Column:
        inner = F.substring(shown, F.lit(len(BEGIN) + 1), F.length(shown))
        cut = F.instr(inner, "\n")
        role, body = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + 1, F.length(inner))
        plain = F.when(role == LOSS_ROLE, body).otherwise(
            F.substring(body, F.lit(len(INST) + 1), F.length(body) - len(INST) - len(INST_END)))
        return F.struct(unescape_role(role).alias("role"), unescape(plain).alias("text"))

    shown = F.split("formatted", END, -1)
    turns = F.transform(F.slice(shown, 1, F.greatest(F.size(shown) - 1, F.lit(0))), turn)
    raw = F.encode("formatted", "UTF-8")
    d = formatted.withColumn("turns", turns).withColumn("_raw", raw)
    span = lambda s: unescape(F.decode(F.substring(F.col("_raw"), (s["start"] + 1).cast("int"),
                                                   s["length"].cast("int")), "UTF-8"))
    return d.withColumn("loss_text", F.array_join(F.transform("loss_spans", span), "")).drop("_raw")
