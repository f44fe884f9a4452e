"""Operator 7, chat formatting by multi-party perspective rotation, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask marks the messages to learn from, which are the speaker's own. ``system`` messages keep their
role in every perspective and are no participant's.

The messages of a conversation are numbered in order of turn, speaker and text, and a row of the result holds a stretch
of ``SEGMENT`` of them: segment 0 is the whole dialogue unless that is longer, and the segments of a longer one follow
each other without a gap. The numbers come from one range sort of all messages with a count per partition and
conversation, so a conversation with a third of all rows, or of one turn alone, is numbered and rendered by many tasks.

A dialogue of M messages among P speakers is rendered P times, M * P messages in all; that is what rotation means, and
for one in which everybody speaks once it is quadratic.

Cases: a null text is empty; a null role is the participant ``unknown``; a null turn sorts first; messages that agree in
all columns are each kept; a null conversation id is a conversation; a conversation of system messages alone has no
perspective; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Messages of a row.
SEGMENT = 256
SYSTEM = "system"
HEAD, NAME, TAIL = "<|", "|>", "<|end|>\n"


def messages(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    return turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def participants(said: DataFrame) -> DataFrame:
    """``(conv_id, perspective)``: each speaker but the system once."""
    return said.where(F.col("speaker") != SYSTEM).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.lit(1).alias("one")).drop("one")


def numbered(said: DataFrame) -> DataFrame:
    """``said`` with ``n``, the place of each message in its conversation, from 0."""
    order = ["conv_id", "turn", "speaker", "text"]
    # The last key tells messages apart that agree in all columns, so that they too can be dealt to several partitions.
    dealt = said.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ordered = materialize(dealt.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()), "chat")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("conv_id", part.alias("p")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("conv_id").orderBy("p")) - F.col("k")
    base = counts.select(F.col("conv_id").alias("c"), "p", (before - F.col("first")).alias("shift"))
    placed = ordered.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (part == F.col("p")))
    return placed.select(*said.columns, (F.col("at") + F.col("shift")).alias("n"))


def segments(said: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, segment, said)``: stretches of ``segment`` messages, in order."""
    gathered = numbered(said).groupBy("conv_id", F.floor(F.col("n") / segment).alias("segment"))
    return gathered.agg(F.array_sort(F.collect_list(F.struct("n", "speaker", "text"))).alias("said"))


def _render(m: Column, perspective: Column) -> Column:
    own = F.when(m["speaker"] == SYSTEM, F.lit(SYSTEM)).when(m["speaker"] == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["speaker"]))
    return F.concat(F.lit(HEAD), own, F.lit(NAME), m["text"], F.lit(TAIL))


def rotate(turns: DataFrame, segment: int = SEGMENT, **columns: str) -> DataFrame:
    """``(conv_id, perspective, segment, n_messages, rendered, mask, n_learned_chars)``.

    ``mask`` has a 1 for each message of the perspective and a 0 for the others, in order; ``n_learned_chars`` counts
    the characters of the learned messages' texts.
    """
    said = messages(turns, **columns)
    # Every perspective of every segment has a row before the texts are joined, by conversation and segment: no key is hot.
    sizes = said.groupBy(F.col("conv_id").alias("c")).agg(F.ceil(F.count(F.lit(1)) / segment).alias("segments"))
    who = participants(said).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")))
    slots = who.select("c", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments").cast("long") - 1)).alias("s"))
    both = segments(said, segment).join(slots, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    p = F.col("perspective")
    learned = F.filter("said", lambda m: m["speaker"] == p)
    return both.select(
        "conv_id", "perspective", "segment", F.size("said").cast("long").alias("n_messages"),
        F.array_join(F.transform("said", lambda m: _render(m, p)), "").alias("rendered"),
        F.array_join(F.transform("said", lambda m: F.when(m["speaker"] == p, F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
        F.aggregate(learned, F.lit(0).cast("long"), lambda a, m: a + F.char_length(m["text"])).alias("n_learned_chars"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = f"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1) / {SEGMENT}) AS BIGINT) AS segment FROM said),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}')
SELECT s.conv_id, w.perspective, s.segment, count(*) AS n_messages,
       string_agg('{HEAD}' || CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END
                  || '{NAME}' || text || '{TAIL}', '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
       string_agg(CASE WHEN speaker = perspective THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, speaker, text) AS mask,
       CAST(sum(CASE WHEN speaker = perspective THEN length(text) ELSE 0 END) AS BIGINT) AS n_learned_chars
FROM placed s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id
GROUP BY s.conv_id, w.perspective, s.segment
"""
