"""Token streams of language models, as rows: fragments to lines to text, with what ends a response.

A response comes in fragments (response, seq, fragment) that may break anywhere. Its lines,
from ``data: `` on, hold pieces of the answer, up to ``[DONE]``, a finish reason, or the piece with which the
answer would run in a loop. Lines that can't be read are skipped, like a last line
without an end. All of it is windows and groups by response; a piece meets those of
the 600 characters before it to tell a loop, never the whole answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers
from ..functions import text as T

LOOP_WINDOW, LOOP_TIMES = 200, 3
DONE, FINISH, LOOP, END = "done", "finish", "loop", "end"


def lines(fragments: DataFrame) -> DataFrame:
    """(response, line, text): the ended lines of each response, whatever fragments they lie in."""
    place = Window.partitionBy("response").orderBy("seq")
    rows = fragments.select("response", "seq", F.split(F.coalesce("fragment", F.lit("")), "\n", -1).alias("parts")).withColumn("breaks", F.size("parts") - 1)
    before = F.coalesce(F.sum("breaks").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # before lines are exploded: a generator beside windows would come first
    rows = rows.withColumns({"before": before, "ended": F.sum("breaks").over(Window.partitionBy("response"))})
    rows = rows.select("response", "seq", "before", "ended", F.posexplode("parts").alias("i", "part"))
    rows = rows.withColumn("line", F.col("before") + F.col("i")).where("line < ended")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "")
    return rows.groupBy("response", "line").agg(whole.alias("text"))


def pieces(rows: DataFrame) -> DataFrame:
    """(response, line, piece, stop): what each line brings; stop: done or finish. rows: (response, line, text)."""
    text = T.trim_blank("text")
    rows = rows.select("response", "line", text.alias("text")).where(F.col("text").startswith("data: "))
    rows = rows.select("response", "line", F.expr("substring(text, 7)").alias("data"))
    rows = rows.select("response", "line", (F.col("data") == "[DONE]").alias("over"), F.when(F.col("data") != "[DONE]", answers.chat_response("data")).alias("r"))
    finished = F.coalesce((F.col("r.finish") != "") & (F.col("r.finish") != "null"), F.lit(False))
    stop = F.when(F.col("over"), DONE).when(finished, FINISH)
    return rows.select("response", "line", F.nullif("r.delta", F.lit("")).alias("piece"), stop.alias("stop")).where("piece IS NOT NULL OR stop IS NOT NULL")


def shown(rows: DataFrame) -> DataFrame:
    """(response, line, piece, ended): the pieces before what ends their response; a row without a piece says how a response ended there."""
    here = Window.partitionBy("response")
    rows = rows.withColumn("last", F.min(F.when(F.col("stop").isNotNull(), F.col("line"))).over(here)).where("last IS NULL OR line <= last")
    rows = rows.withColumn("piece", F.when(F.col("stop").isNull(), F.col("piece")))
    so_far = here.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0)))
    near = F.array_join(F.collect_list("piece").over(here.orderBy("upto").rangeBetween(-LOOP_WINDOW * LOOP_TIMES, 0)), "")
    loops = F.col("piece").isNotNull() & T.repetition_loop(near, LOOP_WINDOW, LOOP_TIMES)
    rows = rows.withColumn("loops", loops).withColumn("loop", F.min(F.when(F.col("loops"), F.col("line"))).over(here)).where("loop IS NULL OR line <= loop")
    return rows.select("response", "line", F.when(~F.col("loops"), F.col("piece")).alias("piece"), F.when(F.col("loops"), LOOP).otherwise(F.col("stop")).alias("ended"))


def texts(fragments: DataFrame) -> DataFrame:
    """(response, text, n_pieces, ended) of every response; ended: done, finish, loop, or end where the stream just ends."""
    found = shown(pieces(lines(fragments)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("line", "piece")))), lambda x: x["piece"]), "")
    whole = found.groupBy("response").agg(joined.alias("text"), F.count("piece").alias("n_pieces"), F.max("ended").alias("ended"))
    every = fragments.select("response").distinct()
    return every.join(whole, "response", "left").select("response", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_pieces", F.lit(0)).cast("long").alias("n_pieces"), F.coalesce("ended", F.lit(END)).alias("ended"))
