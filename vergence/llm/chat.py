"""Chat formatting: typed content parts become one training text with a loss mask.

A visitor flattens the parts of each turn (text, image, audio, document) into text and ordered
placeholders; it records what each placeholder refers to and how many tokens it expands to.  The
template marks turns, and control strings inside texts are escaped so that the marks can be told
apart and the texts read back.  Everything is an expression over rows, then one shuffle by
conversation; only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A turn is BEGIN role MIDDLE content END.
BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST] ", "</s>"
#: The role whose texts are learned.
LEARNED = "assistant"
PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: What parts other than text expand to: pixels of an image patch's side, tokens of a second of sound, tokens of a page.
PATCH_PIXELS, SECOND_TOKENS, PAGE_TOKENS = 28, 25, 576
#: A mark, or a placeholder, with any number of escapes after its first character.
_REST = r"\\*(?:/?s>|\|(?:image|audio|document|other)\|>)"
_CONTROL = rf"<(?={_REST})|\[(?=\\*/?INST\])"
_ESCAPED = rf"(<)\\(?={_REST})|(\[)\\(?=\\*/?INST\])"
_PLACEHOLDER = r"<\|(image|audio|document|other)\|>"


def escaped(text: Column) -> Column:
    """Control strings get a backslash after their first character, and one more where they have some: reversible."""
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def text_part(text: Column) -> Column:
    """Parts of a turn that is only a text."""
    none = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"))
    return F.array(part).cast(PARTS)


def _kind(part: Column) -> Column:
    kind = F.coalesce(F.lower(part["kind"]), F.lit("text"))
    return F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise("other")


def _rendered(part: Column) -> Column:
    """The visitor: what a part is in the turn's content."""
    return F.when(_kind(part) == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def _tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to: one at least, as where a size isn't known."""
    patches = lambda side: F.ceil(F.greatest(side, F.lit(1)) / PATCH_PIXELS)
    n = F.when(_kind(part) == "image", patches(part["width"]) * patches(part["height"])).when(_kind(part) == "audio", F.ceil(part["seconds"] * SECOND_TOKENS)).when(_kind(part) == "document", part["pages"] * PAGE_TOKENS)
    return F.greatest(F.coalesce(n.cast("long"), F.lit(1)), F.lit(1))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss, attachments, expanded_tokens): one row for each conversation.

    loss holds (start, end, start_byte, end_byte) of each learned turn's content in formatted, in
    code points and in UTF-8 bytes, end exclusive.  attachments are those of the placeholders, in
    their order: (turn, kind, ref, tokens).

    Rows of a conversation stand by turn, nulls first, and then by role and content, so that ties
    have one order; repeated rows are turns of their own.  Null parts, no parts and null texts are
    an empty content, a null role is an empty one, and a null id is a conversation like any other.
    A kind that isn't known is kept as a placeholder of one token.  Other columns are ignored; an
    empty table gives no rows.  A conversation is one record, so one task holds it: 2 GB at most,
    the most of a Spark string."""
    parts = F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS))
    attached = F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    role = F.coalesce(F.col(role_col), F.lit(""))
    turns = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), (role == learned).alias("learned"), F.concat(F.lit(BEGIN), escaped(role), F.lit(MIDDLE)).alias("head"),
        F.array_join(F.transform(parts, _rendered), "").alias("content"), attached.alias("attached"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "head", "content").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda length: F.coalesce(F.sum(length("head") + length("content") + len(END)).over(before), F.lit(0)) + length("head")
    placed = turns.withColumns({"start": start(F.length), "start_byte": start(F.octet_length)})
    turn = F.struct("start", "start_byte", "turn", "learned", "head", "content", "attached")
    of_chat = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    span = lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["content"])).alias("end"), t["start_byte"].alias("start_byte"), (t["start_byte"] + F.octet_length(t["content"])).alias("end_byte"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "")
    refs = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = of_chat.select("conv_id", whole.alias("formatted"), F.transform(F.filter("turns", lambda t: t["learned"]), span).alias("loss"), refs.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """(role, text, placeholders) of each turn of a formatted conversation; placeholders stay in the text as they stand."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # after the last mark there is nothing

    def turn(piece: Column) -> Column:
        both = F.split(F.substr(piece, F.lit(len(BEGIN) + 1)), r" \[/INST\] ", 2)
        return F.struct(unescaped(F.get(both, F.lit(0))).alias("role"), unescaped(F.get(both, F.lit(1))).alias("text"), F.regexp_extract_all(F.get(both, F.lit(1)), F.lit(_PLACEHOLDER), F.lit(1)).alias("placeholders"))

    return F.transform(pieces, turn)


def read_learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, read by their bytes."""
    data = F.encode(formatted, "UTF-8")
    return F.transform(loss, lambda s: unescaped(F.decode(F.substring(data, s["start_byte"].cast("int") + 1, (s["end_byte"] - s["start_byte"]).cast("int")), "UTF-8")))


def digest(chats: DataFrame) -> DataFrame:
    """What formatted and loss say of each conversation, as hashes."""
    told = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", "formatted", told.alias("told"), F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.array_join(read_learned(F.col("formatted"), F.col("loss")), "").alias("learned"))
    return read.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
