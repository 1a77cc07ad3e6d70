"""Answers to chat requests: what an index recalls for the input, then the channel's own entries, then a reply.

Each micro-batch is a batch job: inputs become centroids, the index' nearest turns are found for all of
them at once, histories of the batch's channels are read, and an answerer, which is a relation too,
gives replies. Histories and responses are written in a folder a batch, so a batch that is run
again after a failure takes its own place and nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import retrieval
from parlance.operators.vocabulary import encode
from parlance.session import checkpointed
from parlance.sources import files
from parlance.streaming.channels import HISTORY

RECALLED = 5
#: Histories are gathered into one folder after so many batches.
GATHER = 50
HISTORIES = "channel string, entries array<string>, batch bigint"


def recalled(requests: DataFrame, index: DataFrame, vocab: DataFrame, embeddings: DataFrame, dim: int, k: int = RECALLED) -> DataFrame:
    """requests (channel, seq, input) with recalled, the k nearest turns of the index, nearest first, as entries."""
    asked = requests.select(F.col("seq").alias("section_idx"), F.lit(0).cast("bigint").alias("turn_idx"), F.col("input").alias("text"))
    vectors = retrieval.centroids(encode(asked, vocab), embeddings, ["section_idx"], dim)
    order = retrieval.INDEX_ORDER
    near = retrieval.top_k_each(index, vectors.select(F.col("section_idx").alias("query_id"), F.col("embedding").alias("query")), k, order)
    entries = near.join(index.select(*order, retrieval.rendered(F.col("person_id"), F.col("tokens")).alias("entry")), order)
    listed = entries.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]).alias("recalled"))
    return requests.join(listed, requests["seq"] == listed["query_id"], "left").drop("query_id").withColumn("recalled", F.coalesce("recalled", F.array().cast("array<string>")))


def histories(spark: SparkSession, path: str, before: int) -> DataFrame:
    """(channel, entries) after all batches before one."""
    if not files.found(spark, f"{path}/batch=*"):
        return spark.createDataFrame([], "channel string, entries array<string>")
    return spark.read.schema(HISTORIES).parquet(path).where(F.col("batch") < before).groupBy("channel").agg(F.max_by("entries", "batch").alias("entries"))


def _keep(spark: SparkSession, rows: DataFrame, path: str, batch: int) -> None:
    rows.select("channel", "entries").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if batch and batch % GATHER == 0:
        held = checkpointed(histories(spark, path, batch + 1))
        held.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        fs, _ = files._at(spark, path)
        for n in range(batch - GATHER, batch):
            fs.delete(files._at(spark, f"{path}/batch={n}")[1], True)


def replies(requests: DataFrame, held: DataFrame, answer: Callable[[DataFrame], DataFrame], most: int = HISTORY) -> tuple[DataFrame, DataFrame]:
    """(channel, seq, reply) of requests (channel, seq, input, recalled), and (channel, entries) after them.

    answer gets (channel, seq, input, memory) and gives (channel, seq, reply); a request whose reply
    is null, or that it leaves out, failed, and the channel stays as it was. A channel's requests
    are answered in order, one round for each, since each may need the reply before; all channels share a round.
    """
    nth = F.row_number().over(Window.partitionBy("channel").orderBy("seq"))
    asked = checkpointed(requests.withColumn("nth", nth))
    rounds = asked.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0]
    now = asked.select("channel").distinct().join(held, "channel", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<string>")))
    now, out = checkpointed(now), None
    for n in range(1, rounds + 1):
        memory = F.concat("recalled", "entries")
        put = asked.where(F.col("nth") == n).join(now, "channel").select("channel", "seq", "input", memory.alias("memory"))
        got = answer(put).select("channel", "seq", "reply")
        got = checkpointed(put.select("channel", "seq", "input").join(got, ["channel", "seq"], "left"))
        after = F.when(F.col("reply").isNull(), F.col("entries")).otherwise(F.concat("entries", F.array("input", "reply")))
        now = now.join(got.select("channel", "input", "reply"), "channel", "left").select("channel", after.alias("entries"))
        now = checkpointed(now.withColumn("entries", F.slice("entries", F.greatest(F.size("entries") - most + 1, F.lit(1)), most)))
        got = got.select("channel", "seq", "reply")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else asked.select("channel", "seq", F.lit(None).cast("string").alias("reply")), now


# What is answered where there is no reply.
UNAUTHORIZED, NO_INPUT, FAILED = "unauthorized", "missing or empty 'input'", "generation failed"


def responses(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """(seq, status, content_type, body) of checked requests (seq, refused, ...) and their replies (seq, reply)."""
    rows = requests.join(answered.select("seq", "reply"), "seq", "left")
    status = F.coalesce(F.col("refused"), F.when(F.col("reply").isNull(), 503).otherwise(200))
    rows = rows.withColumn("status", status)
    text = F.when(F.col("status") == 401, UNAUTHORIZED).when(F.col("status") == 400, NO_INPUT).when(F.col("status") == 503, FAILED)
    kind = F.when(F.col("status") == 200, "application/json; charset=utf-8").otherwise("text/plain; charset=utf-8")
    return rows.select("seq", "status", kind.alias("content_type"), F.coalesce(text, F.to_json(F.struct("reply"))).alias("body"))


def checked(stream: DataFrame, api_key: str) -> DataFrame:
    """(seq, channel, input, refused) of requests (seq, api_key, body); refused is 401, 400 or null."""
    text = T.one_spaced_trim(T.json_field(F.col("body"), "input"))
    refused = F.when(F.coalesce(F.col("api_key"), F.lit("")) != api_key, 401).when(F.coalesce(text, F.lit("")) == "", 400)
    return stream.select("seq", F.coalesce(T.json_field(F.col("body"), "channel_id"), F.lit("default")).alias("channel"), text.alias("input"), refused.alias("refused"))


def serve(stream: DataFrame, api_key: str, index: str, vocab: DataFrame, embeddings: DataFrame, dim: int, answer: Callable[[DataFrame], DataFrame], folder: str, live: bool = False):
    """Starts a query that answers requests (seq, api_key, body); seq is theirs alone.

    Responses are in folder/responses, histories in folder/histories. With live, inputs and replies are put into the index too,
    as turns of person 1 and 0 of a section numbered by seq, for the batches after.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        asked = checkpointed(checked(rows, api_key))
        fine = asked.where("refused is null").select("channel", "seq", "input")
        static = retrieval.open_index(spark, index).where(F.col("batch") < number)
        with_memory = recalled(fine, static, vocab, embeddings, dim)
        answered, now = replies(with_memory, histories(spark, f"{folder}/histories", number), answer)
        answered = checkpointed(answered)
        responses(asked, answered).write.mode("overwrite").parquet(f"{folder}/responses/batch={number}")
        if live:
            both = fine.join(answered.select("seq", "reply"), "seq").where("reply is not null")
            said = F.array(F.struct(F.lit(1).alias("person_id"), F.col("input").alias("text")), F.struct(F.lit(0).alias("person_id"), F.col("reply").alias("text")))
            turns = both.select(F.col("seq").alias("section_idx"), F.posexplode(said).alias("turn_idx", "t")).select("section_idx", F.col("turn_idx").cast("bigint"), "t.person_id", "t.text")
            retrieval.insert_live(turns, vocab, embeddings, dim, index, number)
        _keep(spark, now, f"{folder}/histories", number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").start()
