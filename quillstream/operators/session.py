"""Conversation state as windows over a table of turns (session_id, turn_no, question, answer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words

HISTORY = 5
# Openings that mark a follow-up question.
TRIGGERS = [
    "what about", "how about", "and ", "what of",
    "same for", "compare with", "versus", "vs ",
    "explain in detail", "explain more", "tell me more",
    "elaborate", "more details", "can you explain",
    "what was", "what were", "previous", "last question",
    "give more", "expand on", "in detail", "more about",
]
# End of fixed values.


def is_followup(question: Column) -> Column:
    """Opens like a follow-up, is an opening, or has at most four words."""
    q = strip(F.lower(question))
    starts = F.lit(False)
    for t in TRIGGERS:
        starts = starts | q.startswith(t)
    return starts | q.isin([t.strip() for t in TRIGGERS]) | (F.size(words(question)) <= 4)


def resolve(turns: DataFrame) -> DataFrame:
    """``turns`` with resolved: a follow-up after the session's question before it."""
    last = F.lag("question").over(Window.partitionBy("session_id").orderBy("turn_no"))
    return turns.withColumn("resolved", F.when(last.isNotNull() & is_followup(F.col("question")), F.concat_ws(" ", last, F.col("question"))).otherwise(F.col("question")))


def history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """``turns`` with history: the n turns before, oldest first."""
    before = Window.partitionBy("session_id").orderBy("turn_no").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("question", "answer")).over(before))


def messages(history: Column) -> Column:
    """History as alternating messages of user and model."""
    message = lambda role, part: F.struct(F.lit(role).alias("role"), F.array(part).alias("parts"))
    return F.flatten(F.transform(history, lambda t: F.array(message("user", t["question"]), message("model", t["answer"]))))


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """Turns with ``new`` (session_id, question, answer, order) numbered on after them."""
    last = turns.groupBy("session_id").agg(F.max("turn_no").alias("last"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("order"))
    rows = new.withColumn("k", number).join(last, "session_id", "left")
    return turns.unionByName(rows.select("session_id", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("bigint").alias("turn_no"), "question", "answer"))


def without_session(turns: DataFrame, session_id: str) -> DataFrame:
    return turns.filter(~F.col("session_id").eqNullSafe(F.lit(session_id)))


def sessions(turns: DataFrame) -> DataFrame:
    """session_id, n_turns, last_turn."""
    return turns.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.max("turn_no").alias("last_turn"))


def created(uploads: DataFrame, answers: DataFrame) -> DataFrame:
    """Sessions as uploads (session_id, filenames) make them, with what they hold of
    ``answers``' turns: session_id, filenames, history_turns, last_question."""
    held = answers.groupBy("session_id").agg(F.count("*").alias("history_turns"), F.max_by("question", "turn_no").alias("last_question"))
    return uploads.join(held, "session_id", "left").withColumn("history_turns", F.coalesce("history_turns", F.lit(0).cast("bigint")))


def session(sessions_: DataFrame, session_id: str) -> DataFrame:
    """One session; no row if it is not there."""
    return sessions_.filter(F.col("session_id") == session_id)


def needs_reindex(uploads: DataFrame) -> DataFrame:
    """``uploads`` (session_id, upload_no, filenames) with reindex: whether the
    sorted names differ from those of the upload before."""
    names = F.sort_array("filenames")
    before = F.lag(names).over(Window.partitionBy("session_id").orderBy("upload_no"))
    return uploads.withColumn("reindex", ~names.eqNullSafe(before))
