"""Tokenising a stream of text files chunk by chunk (ST1-ST3).

The reference walks its input in chunks of at most N bytes, tokenises each
chunk, writes one part per chunk and keeps running totals.  Here that is a
Structured Streaming query over a folder: ``maxBytesPerTrigger`` bounds the
bytes of each micro-batch (whole files, one text per file), which is one chunk or
is cut into many (starting a micro-batch costs more than a small chunk's work),
the tokeniser is
the same stateless expression, and the running totals are a streaming
aggregate whose state is a single row.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.tokenize import byte_length, ptb_tokens
from ..operators.batching import next_fit
from ..session import cut_lineage
from ..sources.files import few_listing_tasks

TEXT_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def text_stream(spark: SparkSession, folder: str, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """ST1 source: ``(path, text)`` per file arriving in ``folder``.

    ``wholetext`` is passed to ``text()`` itself (an ``.option`` is ignored
    there): without it every line would be a text and T3, T7, T15 change.
    """
    reader = spark.readStream.schema(TEXT_SCHEMA)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    df = reader.text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tokenised_stream(stream: DataFrame) -> DataFrame:
    """ST1: the stateless tokeniser on each arriving text."""
    return stream.select("path", byte_length("text").alias("bytes"), ptb_tokens("text").alias("tokens"))


def running_totals(tokenised: DataFrame) -> DataFrame:
    """ST2: files, bytes and tokens so far (complete mode; state is one row)."""
    return tokenised.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("bigint").alias("bytes"),
                         F.sum(F.size("tokens")).cast("bigint").alias("tokens"))


def write_parts(texts: DataFrame, out: str, checkpoint: str, trigger_available_now: bool = True, chunk_bytes: int | None = None) -> StreamingQuery:
    """ST3: one part folder per chunk, one token per line, in file order.

    ``texts`` is the text stream (``path``, ``text``).  ``foreachBatch`` writes
    ``out/chunk=<number>``.  Without ``chunk_bytes`` a micro-batch is a chunk and
    its id the number.  With it the files of a micro-batch, in the order of their
    paths, are packed into chunks of at most that many bytes (W1; a larger file is
    a chunk of its own), numbered from the batch id times ``CHUNK_IDS``: the cost
    of a micro-batch is paid once for many small chunks.  Either way a replayed
    batch has the same chunks and overwrites its own folders, so a restart does
    not duplicate tokens.  The texts are range-partitioned (into as many ranges as
    the micro-batch has splits) and sorted on chunk and ``path`` and tokenised only
    then (finding the ranges reads the texts, not their tokens), so a chunk's part
    files, read in name order, hold the tokens in order and no task holds a whole
    chunk.

    ``out/_manifest/batch=<batch id>`` lists the chunks' files: ``(chunk, part,
    path, bytes, tokens)``, the part file (by its number) in which a file's tokens
    lie.  It is written after the parts: a chunk that it does not list is not
    complete.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        n = max(1, batch.rdd.getNumPartitions())
        chunked = batch.select("path", "text", F.lit(batch_id).cast("bigint").alias("chunk"))
        if chunk_bytes:
            # Sizes and paths are read once; the packing works on them alone.
            sizes = cut_lineage(batch.select("path", byte_length("text").cast("bigint").alias("bytes")))
            packed = next_fit(sizes, ["path"], "bytes", chunk_bytes + 1)
            packed = packed.select("path", (F.lit(batch_id * CHUNK_IDS) + F.col("batch_id")).cast("bigint").alias("chunk"))
            chunked = batch.select("path", "text").join(cut_lineage(packed), "path")
        ordered = chunked.repartitionByRange(n, "chunk", "path").sortWithinPartitions("chunk", "path")
        # Held for the second write; what a lost executor held is made again.
        t = ordered.select("chunk", "path", byte_length("text").cast("bigint").alias("bytes"), ptb_tokens("text").alias("_t")).persist(StorageLevel.DISK_ONLY)
        try:
            parts = t.where(F.size("_t") > 0).sortWithinPartitions("chunk", "path").select("chunk", F.concat_ws("\n", "_t").alias("value"))
            parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").text(out.rstrip("/"))
            listed = t.select("chunk", F.spark_partition_id().alias("part"), "path", "bytes", F.size("_t").cast("bigint").alias("tokens"))
            # A row per file: a few files hold them.
            listed.repartition(1 + n // 32, "path").write.mode("overwrite").parquet(f"{out.rstrip('/')}/{MANIFEST}/batch={batch_id}")
        finally:
            t.unpersist()

    w = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()


#: Numbers for the chunks of one micro-batch.
CHUNK_IDS = 1 << 32
#: Folder of the manifests beside the chunks; readers of the parts skip it.
MANIFEST = "_manifest"


def chunk_manifest(spark: SparkSession, out: str) -> DataFrame:
    """``(chunk, part, path, bytes, tokens)``: the files of every chunk written so far."""
    schema = "chunk long, part int, path string, bytes long, tokens long"
    return spark.read.schema(schema).parquet(f"{out.rstrip('/')}/{MANIFEST}").select("chunk", "part", "path", "bytes", "tokens")


def part_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The parts read back in order: ``(chunk, path, pos, token)``, every token with
    the file that the manifest says it came from and its place in that file.

    A part file is read as one text (like the files that it was made of) and meets
    the list of its files, whose running sums name the lines of each.  Tokens become
    rows only then: the texts of the parts move once, token rows never."""
    with few_listing_tasks(spark):
        texts = spark.read.text(out, wholetext=True)
    place = [F.regexp_extract("_metadata.file_path", r"/chunk=(\d+)/part-(\d+)", k).cast("bigint") for k in (1, 2)]
    texts = texts.select(place[0].alias("chunk"), place[1].alias("part"), F.col("value").alias("_text"))
    before = Window.partitionBy("chunk", "part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunk_manifest(spark, out).where("tokens > 0").withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files = starts.groupBy("chunk", F.col("part").cast("bigint").alias("part")).agg(F.collect_list(F.struct("path", "at", "tokens")).alias("_files"))

    def own(lines: Column) -> Column:
        return F.transform("_files", lambda f: F.struct(f["path"].alias("path"), F.slice(lines, (f["at"] + 1).cast("int"), f["tokens"].cast("int")).alias("tokens")))

    # The outer list has one element, so that a text is cut into lines once.
    found = F.flatten(F.transform(F.array(F.split("_text", "\n")), own))
    found = texts.join(files, ["chunk", "part"]).select("chunk", F.explode(found).alias("_f"))
    rows = found.select("chunk", "_f.path", F.posexplode_outer("_f.tokens").alias("pos", "token"))
    return rows.where(F.col("token") != "").select("chunk", "path", F.col("pos").cast("bigint").alias("pos"), "token")


def totals_to_table(tokenised: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """ST2 sink: the running totals in an in-memory table, updated per batch."""
    return (running_totals(tokenised).writeStream.outputMode("complete").format("memory")
            .queryName(table).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
