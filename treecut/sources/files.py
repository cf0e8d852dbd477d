"""Text sources: whole files, file manifests and large files by lines."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokenize import WS_CLASS, normalise_marks, ptb_tokens, split_tokens, tokens
from ..operators.compare import packed, unpacked
from ..operators.ordering import offsets_within
from ..session import cut_lineage, scratch_path


def _qualified(spark: SparkSession, path: str):
    """``path`` with its file system's scheme and authority, and the file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop), fs


_ROOT = r"^[a-zA-Z][\w+.-]*:(//[^/]*)?/+"


def _top_level_only(df: DataFrame, root: str, path_col: str) -> DataFrame:
    """Keep files directly inside the qualified ``root`` (the reference lists one
    level).

    The filter is on the file path, so Spark prunes the other files before
    reading them.
    """
    below = [p for p in re.sub(_ROOT, "/", root).split("/") if p]
    depth = F.size(F.split(F.regexp_replace(F.col(path_col), _ROOT, "/"), "/"))
    return df.where(depth == F.lit(len(below) + 2))


#: Tasks that list folders, for each that the cluster runs at once.
LISTING_FACTOR = 4


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, folders are listed by a few tasks for each core, many folders to a
    task.  Spark starts a task for every folder, up to 10,000, and such a task
    takes far longer to start than its folder to list."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(min(int(before or 10_000), LISTING_FACTOR * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _corpus_files(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    root, fs = _qualified(spark, path)
    return df if fs.isFile(root) else _top_level_only(df, root.toString(), "path")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``, one row per file, the whole file as one text.

    ``path`` is one file or a directory whose plain files (not subfolders)
    are read.  As with every Spark file source, names starting with ``.`` or
    ``_`` are skipped (the reference's C++ driver skips dot files too), and
    an empty file gives no row.
    """
    with few_listing_tasks(spark):
        df = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _corpus_files(spark, path, df)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``(path, length)`` of the corpus files; contents are never read."""
    with few_listing_tasks(spark):
        df = spark.read.format("binaryFile").load(path).select(
            F.col("_metadata.file_path").alias("path"), F.col("length").cast("bigint").alias("length"))
    return _corpus_files(spark, path, df)


def _records(spark: SparkSession, path: str, sep: str, over: int = 0) -> DataFrame:
    """What stands between two ``sep`` in text files of more than ``over`` bytes: ``(path,
    block, lid, line, file_size)``."""
    with few_listing_tasks(spark):
        df = spark.read.option("lineSep", sep).text(path)
    if over:
        df = df.where(F.col("_metadata.file_size") > over)
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("lid"),
        F.col("value").alias("line"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a file-order key, cut at ``\\n`` only.

    ``(path, block, lid, line, file_size)``: ``block`` is the split's start
    offset and ``lid`` a monotonically increasing id, so ``(block, lid)``
    orders the lines of a file even when the file is cut into many splits
    read in parallel.  ``\\r`` stays in the line.
    """
    return _records(spark, path, "\n")


#: Characters of a piece of a file that is cut at blanks, at least.
PIECE = 1 << 16


def read_pieces(spark: SparkSession, path: str, least: int = PIECE, sep: str = " ", over: int = 0) -> DataFrame:
    """Files cut at blanks (or another ``sep``), whatever lines they have: like
    ``read_lines``, with pieces of at least ``least`` characters as lines.

    Spark's reader finds the blanks of every split; neighbouring words of a
    split are put together again where they are read, so a line of any length
    is many pieces read in parallel and nothing is shuffled.  Only a stretch
    without any blank has to fit into a cell.  ``over``: only files of more bytes.
    """
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("lid", pa.int64()), ("line", pa.string()), ("file_size", pa.int64())])

    def joined(words: pa.Array, offsets: list[int]) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), sep)

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The words behind the last full piece: where they start, and their texts.
        where: tuple | None = None
        held: list[str] = []
        size = 0
        for batch in batches:
            # The words of a split stand together: look only where path or block changes.
            paths = batch.column("path").dictionary_encode().indices.to_numpy()
            blocks = batch.column("block").to_numpy()
            change = np.flatnonzero((np.diff(paths) != 0) | (np.diff(blocks) != 0)) + 1
            made: list[pa.RecordBatch] = []

            def put(key: tuple, lids: pa.Array, lines: pa.Array) -> None:
                n = len(lines)
                made.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), lids, lines, pa.repeat(pa.scalar(key[2], pa.int64()), n)], schema=schema))

            for at, to in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if at == to:
                    continue
                own = (batch.column("path")[at].as_py(), int(blocks[at]), batch.column("file_size")[at].as_py())
                if where is not None and where[:3] != own:
                    put(where, pa.array([where[3]], pa.int64()), pa.array([sep.join(held)], pa.string()))
                    where, held, size = None, [], 0
                words, lids = batch.column("line").slice(at, to - at), batch.column("lid").slice(at, to - at)
                ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                # Each cut is behind the word that fills the piece.
                cuts, before = [], -size
                while (fills := int(np.searchsorted(ends, before + least))) < len(words):
                    cuts.append(fills + 1)
                    before = int(ends[fills])
                if cuts:
                    first = 0
                    if held:
                        text = sep.join([*held, joined(words, [0, cuts[0]])[0].as_py()])
                        put(own, pa.array([where[3]], pa.int64()), pa.array([text], pa.string()))
                        first = cuts.pop(0)
                    if cuts:
                        starts = [first, *cuts]
                        put(own, lids.take(pa.array(starts[:-1], pa.int64())), joined(words, starts))
                        first = cuts[-1]
                    where, held, size = None, [], 0
                    words, lids = words.slice(first), lids.slice(first)
                if len(words):
                    if where is None:
                        where = (*own, lids[0].as_py())
                    held.append(joined(words, [0, len(words)])[0].as_py())
                    size = int(ends[-1]) - before
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if where is not None:
            yield pa.RecordBatch.from_pylist([{**dict(zip(("path", "block", "file_size", "lid"), where)), "line": sep.join(held)}], schema=schema)

    return _records(spark, path, sep, over).mapInArrow(glue, "path string, block long, lid long, line string, file_size long")


#: How a large file is cut: a reader and the character that stands at every cut.
CUTS = {"lines": (read_lines, "\n"), "blanks": (read_pieces, " ")}


def _cut(spark: SparkSession, path: str, cut: str, piece: int) -> tuple[DataFrame, str]:
    reader, sep = CUTS[cut]
    return (reader(spark, path, piece) if cut == "blanks" else reader(spark, path)), sep


def _tokenised(lines: DataFrame, tokens: Column, *kept: str) -> DataFrame:
    """The tokens of every piece, made in the task that reads it: ``(path, block,
    lid, n, tokens)`` and the columns ``kept``, written once to the shared scratch
    folder.  The tokens are written as one text (``packed``) and stay so until they
    are put out: an array costs far more to write, to read and to pack later."""
    out = scratch_path(lines.sparkSession, f"large_file_lines/{uuid.uuid4().hex}")
    t = lines.select("path", "block", "lid", tokens.alias("tokens"), *kept)
    t = t.select("path", "block", "lid", F.size("tokens").alias("n"), packed("tokens").alias("tokens"), *kept)
    t.write.parquet(out)
    return lines.sparkSession.read.schema(t.schema).parquet(out)


def _plain_lines(lines: DataFrame, sep: str, *kept: str) -> DataFrame:
    """Every line tokenised as one inside a file."""
    inside = F.concat(F.lit(sep), F.col("line"), F.lit(sep))
    return _tokenised(lines, ptb_tokens(inside, final_period=F.lit(False)), *kept)


def _edge_lines(lines: DataFrame, sep: str) -> DataFrame:
    """The first, last and last non-blank line of every file, tokenised as what
    they are: ``(path, block, fixes)``, at most three lines of a file in all."""
    place = F.struct("block", "lid", "line")
    blank = F.col("line").rlike("^" + WS_CLASS + "*$")
    facts = lines.groupBy("path").agg(
        F.min(place).alias("_first"), F.max(place).alias("_last"), F.max(F.when(~blank, place)).alias("_final"),
        (F.sum(F.octet_length("line") + 1) == F.first("file_size")).alias("_ends"))
    edges = F.array_distinct(F.array_compact(F.array("_first", "_last", "_final")))
    e = facts.select("path", "_first", "_last", "_final", "_ends", F.explode(edges).alias("_e"))

    def same(name: str):
        return F.coalesce((F.col("_e.block") == F.col(f"{name}.block")) & (F.col("_e.lid") == F.col(f"{name}.lid")), F.lit(False))

    text = F.concat(F.when(same("_first"), F.lit("")).otherwise(F.lit(sep)), F.col("_e.line"),
                    F.when(same("_last") & ~F.col("_ends"), F.lit("")).otherwise(F.lit(sep)))
    t = e.select("path", F.col("_e.block").alias("block"), F.col("_e.lid").alias("lid"), text.alias("_x"), same("_final").alias("_f"))
    t = t.select("path", "block", "lid", ptb_tokens("_x", final_period=F.col("_f")).alias("tokens"))
    return t.groupBy("path", "block").agg(F.collect_list(F.struct("lid", "tokens")).alias("fixes"))


def _with_edges(plain: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Every piece with its number of tokens and these as one text, the edge pieces as
    what they are."""
    lines = plain.select("path", "block", "lid", "n", "tokens")
    if edges is None:
        return lines
    fix = F.get(F.filter("fixes", lambda x: x["lid"] == F.col("lid")), 0)
    fixed = lines.join(edges, ["path", "block"], "left").withColumn("_fix", fix["tokens"])
    either = lambda there, plain: F.when(F.col("_fix").isNotNull(), there).otherwise(F.col(plain)).alias(plain)
    return fixed.select("path", "block", "lid", either(F.size("_fix"), "n"), either(packed("_fix"), "tokens"))


def _plain_and_edges(spark: SparkSession, path: str, cut: str, piece: int) -> tuple[DataFrame, DataFrame]:
    """``_plain_lines`` and ``_edge_lines`` of files; what is dear to cut is cut
    once, the pieces are written beside their tokens."""
    lines, sep = _cut(spark, path, cut, piece)
    if cut == "blanks":
        plain = _plain_lines(lines, sep, "line", "file_size")
        return plain, _edge_lines(plain, sep)
    return _plain_lines(lines, sep), _edge_lines(lines, sep)


def large_file_lines(spark: SparkSession, path: str, cut: str = "lines", piece: int = PIECE) -> DataFrame:
    """Files too large for one cell, tokenised piece by piece in parallel.

    ``cut="lines"``: each line is tokenised as ``'\\n' + line + '\\n'``; with
    ``cut="blanks"`` each piece of ``read_pieces`` as ``' ' + piece + ' '``, so
    lines may be of any length.  There is nothing in front of a file's first
    piece, nor behind its last one unless the file ends with that character:
    every rule sees the same neighbours as in the whole text (no rule that
    changes tokens looks across a blank or a newline at what stands behind it);
    T7 (final period) is switched on only for the last non-blank piece.  All
    pieces are tokenised as inner ones where they are read; the at most three
    others of a file are found by an aggregate and put in by a join on
    (path, block), whose groups are no larger than a split.  Returns
    ``(path, block, lid, tokens)``, one row per piece.
    """
    whole = _with_edges(*_plain_and_edges(spark, path, cut, piece))
    return whole.select("path", "block", "lid", unpacked("tokens").alias("tokens"))


def large_file_tokens(spark: SparkSession, path: str, cut: str = "lines", piece: int = PIECE) -> DataFrame:
    """S4 as token rows ``(path, block, lid, pos, token)``; ``pos`` is the
    place in the piece (``file_token_table`` gives the place in the file)."""
    rows = large_file_lines(spark, path, cut, piece).select(
        "path", "block", "lid", F.posexplode_outer("tokens").alias("pos", "token"))
    return rows.where(F.col("token").isNotNull()).select(
        "path", "block", "lid", F.col("pos").cast("bigint").alias("pos"), "token")


def _runs(plain: DataFrame, edges: DataFrame | None, group: Column, name: str, as_text: bool = False) -> DataFrame:
    """``(name, off, n, tokens)``: pieces with the place of their first token in their
    group (a file, or the files of a part in the order of their names) and the
    number of their tokens.

    The tokens before a piece are those of its group's earlier splits (a running
    sum over one small row per split, from the counts alone) and those of
    earlier pieces in its split (a window over one split).  The edge pieces, the
    offsets and the window share one hash partitioning on (path, block): tokens
    move once, as one text a piece, and not at all where only ``n`` is asked for.
    ``as_text``: they stay ``packed``.
    """
    counts = plain.select("path", "block", "lid", "n")
    if edges is not None:
        fixed = edges.select("path", "block", F.explode("fixes").alias("_x")).select("path", "block", F.col("_x.lid").alias("lid"), F.size("_x.tokens").alias("_m"))
        counts = counts.join(fixed, ["path", "block", "lid"], "left").select("path", "block", F.coalesce("_m", "n").alias("n"))
    per_block = counts.groupBy("path", "block").agg(F.sum("n").alias("_n")).withColumn("_g", group)
    earlier = Window.partitionBy("_g").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(per_block.select("path", "block", "_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")))
    before = Window.partitionBy("path", "block").orderBy("lid").rowsBetween(Window.unboundedPreceding, -1)
    lines = _with_edges(plain, edges).join(offsets, ["path", "block"])
    off = F.col("_off") + F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = lines.select(F.col("_g").alias(name), off.cast("bigint").alias("off"), "n", "tokens")
    return placed if as_text else placed.select(name, "off", "n", unpacked("tokens").alias("tokens"))


def file_token_runs(spark: SparkSession, path: str, cut: str = "lines", piece: int = PIECE, method: str = "ptb",
                    as_text: bool = False) -> DataFrame:
    """S4 as ``(path, off, n, tokens)``: the tokens of a piece (``as_text``: ``packed``),
    their number and the place of the first one in its file."""
    if method == "ptb":
        plain, edges = _plain_and_edges(spark, path, cut, piece)
        edges = cut_lineage(edges)
    elif method == "whitespace" or (method == "ptb_lines" and cut == "lines"):
        # Every cut is white space, and every line is tokenised on its own.
        plain, edges = _tokenised(_cut(spark, path, cut, piece)[0], tokens("line", "ptb" if method == "ptb_lines" else method)), None
    else:
        raise ValueError(f"{method!r} cannot be made of files cut at {cut}")
    return _runs(plain, edges, F.col("path"), "path", as_text)


def file_token_table(spark: SparkSession, path: str, cut: str = "lines", piece: int = PIECE) -> DataFrame:
    """S4 as ``(path, pos, token)`` with ``pos`` the token's place in its file."""
    placed = file_token_runs(spark, path, cut, piece)
    rows = placed.select("path", "off", F.posexplode_outer("tokens").alias("pos", "token"))
    return rows.where(F.col("token").isNotNull()).select(
        "path", (F.col("off") + F.col("pos")).cast("bigint").alias("pos"), "token")


def read_token_part(spark: SparkSession, path: str) -> DataFrame:
    """A token part file (one token per line) back to ``(path, tokens)``.

    The marks ``...`` and ``--`` are spaced first (F5), as the reference does
    before comparing.
    """
    df = read_corpus(spark, path)
    return df.select("path", split_tokens(normalise_marks(F.col("text"))).alias("tokens"))


def read_token_parts(spark: SparkSession, folder: str, part_col: str = "batch_id") -> DataFrame:
    """S7 for a whole sink folder: ``(part, path, tokens)`` per part file."""
    with few_listing_tasks(spark):
        df = spark.read.text(folder, wholetext=True)
    df = df.select(
        F.col(part_col), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select(part_col, "path", split_tokens(normalise_marks(F.col("text"))).alias("tokens"))


#: Bytes of a part that is read as one text, at most.
WHOLE_PART = 4 << 20


def token_part_runs(spark: SparkSession, folder: str, part_col: str = "batch_id", piece: int = PIECE, as_text: bool = False) -> DataFrame:
    """S7 for parts of any size: ``(part, off, n, tokens)``, a part's tokens in pieces
    of lines (``as_text``: ``packed``) with the place of the first token in the part.  A
    small part is one piece; only larger ones are read line by line."""
    with few_listing_tasks(spark):
        whole = spark.read.text(folder, wholetext=True)
    size = F.col("_metadata.file_size")
    lines = whole.where(size <= WHOLE_PART).select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("lid"), F.col("value").alias("line"))
    if not whole.where(size > WHOLE_PART).select(size).isEmpty():
        lines = lines.unionByName(read_pieces(spark, folder, piece, "\n", WHOLE_PART).select("path", "block", "lid", "line"))
    part = F.regexp_extract("path", f"/{part_col}=([^/]+)/", 1).cast("bigint")
    return _runs(_tokenised(lines, split_tokens(normalise_marks(F.col("line")))), None, part, part_col, as_text)


def line_ordinals(lines: DataFrame) -> DataFrame:
    """0-based line number within its file, in (block, lid) order.

    A distributed running count (see ``ordering``), so a log or text file of
    any size never sits in one window partition.
    """
    one = lines.withColumn("_one", F.lit(1))
    return offsets_within(one, ["path"], ["block", "lid"], "_one", "line_no").drop("_one")
