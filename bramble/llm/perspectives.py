"""Multi-party perspective rotation: each dialogue rendered once for every participant.

The participant is the assistant, all others are users with their names, system turns stay system turns; the mask holds the
places of the assistant's words and the end marks after them, which are what a model is trained on. Only DataFrame functions.

The participants are those of the whole dialogue. A dialogue of more than `part_turns` turns comes in several rows for each of
them, so that no row grows with the longest dialogue: part k holds its turns from k * part_turns on, counted in their order. The
parts make one rendering: their texts, joined in order, are the dialogue's, and start and mask count from its first character.

What is said can't forge a turn: in texts and names a backslash is put between `<` and `|`, also where backslashes stand there
already, so that taking one away gives the text back; line ends in names are shown as blanks.

Defined cases: null text is empty; a null speaker is shown as the user `unknown`, but nothing is rendered from its perspective,
and it isn't the participant of that name, if there is one; rows with a null dialogue id are dialogues of one turn each; turns
with equal numbers stand in the order of speaker and text, null turns first; a dialogue without a participant (system turns
only) gives no row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
#: What would begin a mark, and what is put for it.
MARK, MARKED = r"<(\\*)\|", r"<\\$1|"


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = 1000) -> DataFrame:
    """_id, part, perspective, n_turns, start, text, and mask: an array of (start, end), ends exclusive.

    n_turns and text are the part's; start and mask are in characters of the dialogue's rendering, in which text begins at start.
    """
    slim = turns.select(
        F.col(id_col).alias("_id"),
        F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("_alone"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(speaker_col), F.lit(UNKNOWN)).alias("_speaker"),
        F.col(speaker_col).isNull().alias("_nobody"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), MARK, MARKED).alias("_text"),
    )
    # All that follows is by dialogue, so turns are shuffled once.
    ordered = Window.partitionBy("_id", "_alone").orderBy("_turn", "_speaker", "_text", "_nobody")
    people = F.collect_set(F.when(~F.col("_nobody") & (F.col("_speaker") != SYSTEM), F.col("_speaker")))
    numbered = slim.select("_id", "_alone", "_speaker", "_nobody", "_text", (F.row_number().over(ordered) - 1).alias("_n"), people.over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_people"))
    each = numbered.withColumn("perspective", F.explode("_people")).drop("_people")
    own = ~F.col("_nobody") & (F.col("_speaker") == F.col("perspective"))
    head = F.concat(F.lit(BEGIN), F.when(own, "assistant").when(F.col("_speaker") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), F.regexp_replace(F.regexp_replace("_speaker", MARK, MARKED), r"[\r\n]", " "))), F.lit("\n"))
    each = each.select("_id", "_alone", "perspective", "_n", own.alias("_own"), head.alias("_head"), F.concat(F.col("_text"), F.lit(END)).alias("_body"))
    before = Window.partitionBy("_id", "_alone", "perspective").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    length = (F.length("_head") + F.length("_body") + 1).cast("long")
    placed = each.withColumn("_at", F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))).withColumn("part", F.floor(F.col("_n") / part_turns).cast("long"))
    piece = F.struct("_n", "_at", "_own", "_head", "_body")
    parts = placed.groupBy("_id", "_alone", "part", "perspective").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    text = F.concat(F.array_join(F.transform("_pieces", lambda p: F.concat(p["_head"], p["_body"])), "\n"), F.lit("\n"))
    begin = lambda p: p["_at"] + F.length(p["_head"])
    mask = F.transform(F.filter("_pieces", lambda p: p["_own"]), lambda p: F.struct(begin(p).alias("start"), (begin(p) + F.length(p["_body"])).alias("end")))
    return parts.select("_id", "part", "perspective", F.size("_pieces").cast("long").alias("n_turns"), F.col("_pieces")[0]["_at"].alias("start"), text.alias("text"), mask.alias("mask"))
