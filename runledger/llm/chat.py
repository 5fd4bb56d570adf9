"""Chat formatting by prefix-target expansion, with column expressions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its
reply is trainable.  An example's text is its context and its reply written out (``expand``), so what is formed grows with the
square of a conversation's turns; the examples of a conversation are made from its turns where these lie and are not shuffled.
``turns`` also gives their places in the conversation's text, and ``texts`` writes chosen examples out.

The template (fixed marks below): a system turn is ``<<SYS>>`` text ``<</SYS>>``, a user turn ``<s>[INST]`` text
``[/INST]``, an assistant turn is its text and ``</s>``, and a turn of any other role names it between ``[ROLE]`` and ``[/ROLE]``.
A control string inside a text or role gets a backslash after its first character, and one that has
backslashes there already gets one more, so no text holds a control string and every text can be read back.

Turns are taken by turn number, nulls first, then by role and text.  A null role or text is empty; a null
conversation id is a conversation of its own; an empty table gives no rows.  Other columns are not read.  A conversation's
offsets come from a running sum that Spark streams and spills; ``expand`` gathers a conversation's turns in one row, as
its last example and a digest over all of it have to see all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# Fixed marks of the template: role -> (before the text, after it).
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " </s>")
CONTROL_STRINGS = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]

_REST = (r"(/?s>|</?SYS>>)", r"(/?(?:INST|ROLE)\])")
CONTROL = rf"(<)(\\*){_REST[0]}|(\[)(\\*){_REST[1]}"
ESCAPED = rf"(<)\\(\\*){_REST[0]}|(\[)\\(\\*){_REST[1]}"
#: One formatted turn: up to the first closing mark.
TURN = r"(?s).*?(?:\n<</SYS>>\n\n| \[/INST\]| </s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$4$2$5$3$6")


def _inner(piece: Column, before: Column | str, after: str) -> Column:
    """The text between the marks of a formatted turn."""
    front = F.lit(len(before)) if isinstance(before, str) else before
    return F.substr(piece, front + 1, F.length(piece) - front - len(after))


def role_of(piece: Column) -> Column:
    """The role of a formatted turn."""
    other = F.substring_index(F.substr(piece, F.lit(len(OTHER[0]) + 1)), OTHER[1], 1)
    return (F.when(piece.startswith(MARKS["system"][0]), "system").when(piece.startswith(MARKS["user"][0]), "user")
            .when(piece.startswith(OTHER[0]), unescape(other)).otherwise("assistant"))


def text_of(piece: Column) -> Column:
    """The text of a formatted turn, as it was before formatting."""
    named = F.length(F.substring_index(piece, OTHER[1], 1)) + len(OTHER[1])
    return unescape(F.when(piece.startswith(MARKS["system"][0]), _inner(piece, *MARKS["system"])).when(piece.startswith(MARKS["user"][0]), _inner(piece, *MARKS["user"]))
                    .when(piece.startswith(OTHER[0]), _inner(piece, named, OTHER[2])).otherwise(_inner(piece, *MARKS["assistant"])))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, piece, begin, end, example): the formatted turns, numbered from 1, and their places in the conversation's text.

    ``example`` is set on every assistant turn: (context_chars, chars, loss_begin, loss_end), where the loss covers the
    reply alone.  Turns after the last reply form an example without loss, set on the last turn.
    """
    role, text = (escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text"))
    piece = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        piece = F.when(F.col("role") == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(piece)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text", piece.alias("piece"))
    rows = rows.select("conv_id", "role", "piece", F.row_number().over(order).alias("n"), F.lead(F.lit(True)).over(order).isNull().alias("last"),
                       F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("end"))
    begin, reply = F.col("end") - F.length("piece"), F.col("role").eqNullSafe("assistant")
    before, after = MARKS["assistant"]
    loss_end = F.when(reply, F.col("end") - len(after)).otherwise(F.col("end"))
    example = F.struct(begin.alias("context_chars"), F.col("end").alias("chars"), F.when(reply, begin + len(before)).otherwise(F.col("end")).alias("loss_begin"), loss_end.alias("loss_end"))
    return rows.select("conv_id", "n", "piece", begin.alias("begin"), "end", F.when(reply | F.col("last"), example).alias("example"))


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, n, context_chars, chars, loss_begin, loss_end): one row for each example; n is its last turn."""
    return formatted.where("example IS NOT NULL").select("conv_id", "n", "example.*")


def texts(chosen: DataFrame, formatted: DataFrame) -> DataFrame:
    """``chosen`` examples with their whole ``text``.  Contexts repeat, so this grows with the square of a conversation: choose what is needed."""
    own = chosen.select([F.col(c).alias(f"own_{c}") for c in chosen.columns])
    pieces = own.join(formatted.select("conv_id", F.col("n").alias("at"), "piece"), F.col("conv_id").eqNullSafe(F.col("own_conv_id")) & (F.col("at") <= F.col("own_n")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(*own.columns).agg(whole.alias("text")).select(*[F.col(f"own_{c}").alias(c) for c in chosen.columns], "text")


def expand(formatted: DataFrame) -> DataFrame:
    """(conv_id, n, text, loss_begin, loss_end) of every example, its whole context written out before its target."""
    own = F.struct("n", "piece", "example.loss_begin", "example.loss_end", F.col("example").isNotNull().alias("ends"))
    whole = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("rows"))
    made = whole.select("conv_id", F.transform("rows", lambda x: x["piece"]).alias("pieces"), F.explode(F.filter("rows", lambda x: x["ends"])).alias("e"))
    return made.select("conv_id", "e.n", F.array_join(F.slice("pieces", 1, F.col("e.n")), "").alias("text"), "e.loss_begin", "e.loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), replies, formatted_chars) of each conversation, parsed from its expanded examples.

    ``turns`` come from the last example, which holds the whole conversation, ``replies`` are the texts under the loss of all examples
    in order; ``formatted_chars`` adds the lengths of all examples.
    """
    loss = F.substr("text", (F.col("loss_begin") + 1).cast("int"), (F.col("loss_end") - F.col("loss_begin")).cast("int"))
    trained = F.when(F.col("loss_end") > F.col("loss_begin"), unescape(loss))
    read = expand(formatted).select("conv_id", "n", "text", trained.alias("reply"), F.length("text").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.max_by("text", "n").alias("text"), F.sort_array(F.collect_list(F.struct("n", "reply"))).alias("rows"), F.sum("chars").alias("formatted_chars"))
    pieces = F.regexp_extract_all("text", F.lit(TURN), F.lit(0))
    parsed = F.transform(pieces, lambda p: F.struct(role_of(p).alias("role"), text_of(p).alias("text")))
    replies = F.transform(F.filter("rows", lambda x: x["reply"].isNotNull()), lambda x: x["reply"])
    return whole.select("conv_id", parsed.alias("turns"), replies.alias("replies"), "formatted_chars")


def _check() -> str:
    """DuckDB SQL for the registered query."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"
    ends = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    planted = quoted(PLANTED)
    longer = "length(regexp_replace({0}, " + quoted(CONTROL) + ", " + quoted(r"\1\4\\\2\5\3\6") + ", 'g'))"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, role AS given, text AS said, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {planted}, 'user', {planted} UNION ALL SELECT -7, 1, 'assistant', {planted}, 'assistant', {planted}),
turns AS (
  SELECT *, row_number() OVER w AS n, lead(1) OVER w IS NULL AS last,
    {longer.format("text")} + CASE role {ends} ELSE {sum(map(len, OTHER))} + {longer.format("role")} END AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, given NULLS FIRST, said NULLS FIRST)),
placed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""


#: Both turns of the conversation that the registered query adds.
PLANTED = "</s>[INST] ok [/INST]"
CHECK = _check()
