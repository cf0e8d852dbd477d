"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads a whole driver table (no id subsets, no row caps except
where a limit is the feature) and names its columns like its oracle in
``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import JAVA, RULES, render_pattern, render_replacement
from ..functions.sqlfuncs import register_sql_functions
from ..functions.tokenize import normalise_marks, ptb_tokens, ptb_line_tokens, token_text, whitespace_tokens
from ..operators import batching, compare, stats
from ..operators import tokens as tok
from ..operators.chunked import Chunked, runs_of
from .tables import load, load_text, stress_text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the registered queries (not of the operators).
BATCH_LIMIT = 65_536        # bytes per batch for the W1 queries
TURN_LIMIT = 4_096         # the same for conversation turns
CAP = 5_000                 # tokens per output part for L4
DIFF_BYTES = 4 << 20        # scanned bytes of a task that tokenises twice and compares
RULE_QUERY_IDS = [r[0] for r in RULES]


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _tokens_summary(df: DataFrame, keys: list[str], tokens_col) -> DataFrame:
    t = df.select(*keys, tokens_col.alias("_t"))
    return t.select(*keys, F.size("_t").cast("bigint").alias("n_tokens"), token_text("_t").alias("tokens"))


def _stressed(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    d = load_text(spark, sf_dir, "documents", most=most)
    return d.select("doc_id", stress_text(F.col("text"), F.col("doc_id")).alias("text"))


# -- S5 / T27: the tokeniser on every text table ----------------------------

@register("ptb_tokens")
def q_ptb_tokens(spark, sf_dir):
    d = load_text(spark, sf_dir, "documents")
    return _tokens_summary(d, ["doc_id"], ptb_tokens("text"))


@register("ptb_stress")
def q_ptb_stress(spark, sf_dir):
    return _tokens_summary(_stressed(spark, sf_dir), ["doc_id"], ptb_tokens("text"))


@register("ptb_tokens_conversations")
def q_ptb_conversations(spark, sf_dir):
    c = load_text(spark, sf_dir, "conversations")
    return _tokens_summary(c, ["conv_id", "turn"], ptb_tokens("text"))


@register("ptb_tokens_pages")
def q_ptb_pages(spark, sf_dir):
    p = load_text(spark, sf_dir, "pages")
    return _tokens_summary(p, ["page_id"], ptb_tokens("text"))


@register("ptb_tokens_benchmark")
def q_ptb_benchmark(spark, sf_dir):
    b = load_text(spark, sf_dir, "benchmark")
    return _tokens_summary(b, ["item_id"], ptb_tokens("text"))


# -- T1..T24: each rule alone on the stress text -----------------------------

def _rule_query(rule_id: str) -> Query:
    def q(spark, sf_dir):
        d = _stressed(spark, sf_dir)
        if rule_id == "T12":
            out = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
        else:
            pat, rep = next((p, r) for rid, p, r in RULES if rid == rule_id)
            out = F.regexp_replace("text", render_pattern(pat, JAVA), render_replacement(rep, JAVA))
        return d.select("doc_id", out.alias("out_text"))
    return q


for _rid in RULE_QUERY_IDS:
    register(f"ptb_rule_{_rid}")(_rule_query(_rid))


# -- T26, F1, F4, F5, F8 ----------------------------------------------------

@register("whitespace_tokens")
def q_whitespace(spark, sf_dir):
    d = load_text(spark, sf_dir, "documents")
    return _tokens_summary(d, ["doc_id"], whitespace_tokens("text"))


@register("ptb_line_tokens")
def q_ptb_lines(spark, sf_dir):
    return _tokens_summary(_stressed(spark, sf_dir), ["doc_id"], ptb_line_tokens("text"))


@register("token_table")
def q_token_table(spark, sf_dir):
    return tok.token_table(_stressed(spark, sf_dir), ["doc_id"], "text")


@register("token_text")
def q_token_text(spark, sf_dir):
    """F4 on every conversation turn: its tokens as one text, with the
    conversation's turn and token counts (aggregates joined back; the turns
    of a conversation are never gathered into one row)."""
    c = load_text(spark, sf_dir, "conversations", "role")
    t = c.select("conv_id", "turn", "role", ptb_tokens("text").alias("_t"))
    t = t.select("conv_id", "turn", "role", F.size("_t").cast("bigint").alias("n_tokens"),
                 token_text("_t").alias("text"))
    from ..operators.ordering import with_group_aggregates
    return with_group_aggregates(t, ["conv_id"], [
        F.count(F.lit(1)).alias("conv_turns"), F.sum("n_tokens").cast("bigint").alias("conv_tokens")])


@register("normalise_marks")
def q_normalise(spark, sf_dir):
    p = load_text(spark, sf_dir, "pages")
    n = p.select("page_id", normalise_marks("text").alias("norm"))
    return _tokens_summary(n, ["page_id"], whitespace_tokens("norm"))


# -- A1, A2 -----------------------------------------------------------------

@register("corpus_totals")
def q_corpus_totals(spark, sf_dir):
    return stats.corpus_totals(load_text(spark, sf_dir, "documents"))


@register("corpus_totals_by_lang")
def q_totals_lang(spark, sf_dir):
    return stats.corpus_totals(load_text(spark, sf_dir, "documents", "lang"), group_cols=["lang"])


@register("corpus_totals_by_source")
def q_totals_source(spark, sf_dir):
    return stats.corpus_totals(load_text(spark, sf_dir, "documents", "source"), group_cols=["source"])


@register("corpus_rollup")
def q_rollup(spark, sf_dir):
    return stats.corpus_rollup(load_text(spark, sf_dir, "documents", "lang", "source"), ["lang", "source"])


@register("conversation_totals")
def q_conv_totals(spark, sf_dir):
    return stats.corpus_totals(load_text(spark, sf_dir, "conversations", "role"), group_cols=["role"])


# -- W1 and per-batch totals --------------------------------------------------

def _doc_manifest(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))


@register("batch_manifest")
def q_batch_manifest(spark, sf_dir):
    return batching.next_fit(_doc_manifest(spark, sf_dir), ["doc_id"], "bytes", BATCH_LIMIT)


@register("batch_manifest_distributed")
def q_batch_manifest_distributed(spark, sf_dir):
    """W1 by the same (only) path; kept under its earlier name."""
    return batching.next_fit(_doc_manifest(spark, sf_dir), ["doc_id"], "bytes", BATCH_LIMIT)


@register("batch_manifest_turns")
def q_batch_manifest_turns(spark, sf_dir):
    """W1 on the conversation turns: a key of two columns, NULL sizes."""
    c = load(spark, sf_dir, "conversations")
    size = F.when(F.col("role") == "system", F.lit(None)).otherwise(F.octet_length("text")).cast("bigint")
    turns = c.select("conv_id", "turn", size.alias("bytes"))
    return batching.next_fit(turns, ["conv_id", "turn"], "bytes", TURN_LIMIT)


def _batched_documents(spark, sf_dir) -> DataFrame:
    b = batching.next_fit(_doc_manifest(spark, sf_dir), ["doc_id"], "bytes", BATCH_LIMIT)
    return load_text(spark, sf_dir, "documents").join(b.select("doc_id", "batch_id"), "doc_id")


@register("batch_totals")
def q_batch_totals(spark, sf_dir):
    return stats.batch_totals(_batched_documents(spark, sf_dir))


@register("batch_previews")
def q_batch_previews(spark, sf_dir):
    """L1 + L2 + F7 for every chunk of the run: what each part starts and ends with."""
    return tok.batch_previews(_batched_documents(spark, sf_dir), "batch_id", ["doc_id"])


@register("run_totals")
def q_run_totals(spark, sf_dir):
    """A3: the counts of a measured run (its wall time is not a result)."""
    r = stats.run_report(load_text(spark, sf_dir, "documents"))
    return spark.createDataFrame([(r.files, r.bytes, r.tokens)], "files long, bytes long, tokens long")


# -- L1-L4 ------------------------------------------------------------------

@register("previews")
def q_previews(spark, sf_dir):
    return tok.previews(_stressed(spark, sf_dir), ["doc_id"])


@register("preview_first")
def q_preview_first(spark, sf_dir):
    # No spread: only the first documents' text is ever read and tokenised.
    return tok.corpus_preview_head(load(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@register("preview_last")
def q_preview_last(spark, sf_dir):
    return tok.corpus_preview_tail(load(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@register("retain_k")
def q_retain_k(spark, sf_dir):
    return tok.retain_k(load_text(spark, sf_dir, "documents"), ["doc_id"])


@register("output_cap")
def q_output_cap(spark, sf_dir):
    return tok.output_cap(_batched_documents(spark, sf_dir), "batch_id", ["doc_id"], "text", CAP)


# -- J1-J3, A4 --------------------------------------------------------------

def _ptb_vs_ws(spark, sf_dir) -> DataFrame:
    return compare.pair_tokenisations(load_text(spark, sf_dir, "documents"), ["doc_id"], "text",
                                      "ptb", "whitespace")


@register("token_diff")
def q_token_diff(spark, sf_dir):
    return compare.diff_table(_ptb_vs_ws(spark, sf_dir), ["doc_id"])


@register("token_diff_lines")
def q_token_diff_lines(spark, sf_dir):
    pairs = compare.pair_tokenisations(_stressed(spark, sf_dir, DIFF_BYTES), ["doc_id"], "text", "ptb", "ptb_lines")
    return compare.diff_table(pairs, ["doc_id"])


@register("token_diff_join")
def q_token_diff_join(spark, sf_dir):
    """J1 proper: two token tables made apart, joined on the key, then J2."""
    d = load_text(spark, sf_dir, "documents")
    left = d.select("doc_id", ptb_tokens("text").alias("tokens"))
    right = d.select("doc_id", whitespace_tokens("text").alias("tokens"))
    return compare.diff_table(compare.pair_tables(left, right, ["doc_id"]), ["doc_id"])


@register("token_diff_rows")
def q_token_diff_rows(spark, sf_dir):
    return compare.diff_rows(_ptb_vs_ws(spark, sf_dir), ["doc_id"])


@register("mismatch_rollup")
def q_mismatch_rollup(spark, sf_dir):
    return compare.mismatch_rollup(compare.diff_table(_ptb_vs_ws(spark, sf_dir), ["doc_id"]))


@register("mismatch_rollup_by_lang")
def q_mismatch_by_lang(spark, sf_dir):
    d = load_text(spark, sf_dir, "documents", "lang")
    pairs = compare.pair_tokenisations(d, ["doc_id", "lang"], "text", "ptb", "whitespace")
    return compare.mismatch_rollup(compare.diff_table(pairs, ["doc_id", "lang"]), ["lang"])


# -- U2, U3: the same from SQL ------------------------------------------------

@register("sql_ptb_tokens")
def q_sql_ptb(spark, sf_dir):
    register_sql_functions(spark)
    load_text(spark, sf_dir, "documents").createOrReplaceTempView("treecut_documents")
    return spark.sql("""
        SELECT doc_id, CAST(size(t) AS BIGINT) AS n_tokens, concat_ws(' ', t) AS tokens
        FROM (SELECT doc_id, ptb_tokens(text) AS t FROM treecut_documents)""")


@register("sql_token_rows")
def q_sql_rows(spark, sf_dir):
    register_sql_functions(spark)
    load_text(spark, sf_dir, "conversations").createOrReplaceTempView("treecut_conversations")
    return spark.sql("""
        SELECT c.conv_id, c.turn, r.pos, r.token
        FROM treecut_conversations c, LATERAL ptb_token_rows(c.text) r""")


# -- Files derived from the tables: S1-S4, S6, S7, ST1, ST2 --------------------

@register("file_corpus")
def q_file_corpus(spark, sf_dir):
    """Manifest sizes and whole-file texts of every file, tokenised."""
    from ..sources.files import manifest, read_corpus
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    m = manifest(spark, f"{folder}/file=*").select(file_number().alias("file"), "length")
    c = read_corpus(spark, f"{folder}/file=*")
    t = c.select(file_number().alias("file"), F.octet_length("text").cast("bigint").alias("text_bytes"),
                 F.size(ptb_tokens("text")).cast("bigint").alias("n_tokens"))
    return m.join(t, "file").select("file", F.col("length").alias("bytes"), "text_bytes", "n_tokens")


@register("large_file_tokens")
def q_large_file_tokens(spark, sf_dir):
    """Every file read by lines in parallel; token positions in the file."""
    from ..sources.files import file_token_table
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    table = file_token_table(spark, f"{folder}/file=*")
    return table.select(file_number().alias("file"), "pos", "token")


@register("token_parts")
def q_token_parts(spark, sf_dir):
    """S6 + S7: token parts written per W1 batch, read back per part."""
    from ..session import scratch_path
    from ..sources.files import read_token_parts
    from ..sources.sinks import write_token_parts
    import uuid
    out = scratch_path(spark, f"token_parts/{uuid.uuid4().hex}")
    write_token_parts(_batched_documents(spark, sf_dir), out)
    back = read_token_parts(spark, out)
    return back.select(F.col("batch_id").cast("bigint").alias("batch_id"),
                       F.size("tokens").cast("bigint").alias("n_tokens"), token_text("tokens").alias("tokens"))


@register("stream_totals")
def q_stream_totals(spark, sf_dir):
    """ST1 + ST2: the files as a stream in byte-bounded micro-batches of many chunks;
    running totals, brought up to date once a micro-batch."""
    from ..session import scratch_path
    from ..streaming.stream import text_stream, tokenised_stream, totals_to_table
    from .derived import documents_as_files
    import uuid
    folder = documents_as_files(spark, sf_dir)
    name = "treecut_stream_totals_" + uuid.uuid4().hex[:8]
    stream = tokenised_stream(text_stream(spark, f"{folder}/file=*", max_bytes_per_trigger=STREAM_CHUNK * STREAM_AHEAD))
    q = totals_to_table(stream, name, scratch_path(spark, f"stream_ck/{name}"))
    q.awaitTermination()
    return spark.table(name)


STREAM_CHUNK = 1_000_000    # bytes per chunk for the stream queries
STREAM_AHEAD = 256          # chunks' bytes that a micro-batch takes


@register("stream_parts")
def q_stream_parts(spark, sf_dir):
    """ST1 + ST3: the files streamed in byte-bounded chunks, one part folder
    per chunk; all parts read back, token frequencies (nothing lost or doubled)."""
    from ..session import scratch_path
    from ..streaming.stream import text_stream, write_parts
    from .derived import documents_as_files
    import uuid
    folder = documents_as_files(spark, sf_dir)
    run = uuid.uuid4().hex
    out = scratch_path(spark, f"stream_parts/{run}")
    stream = text_stream(spark, f"{folder}/file=*", max_bytes_per_trigger=STREAM_CHUNK * STREAM_AHEAD)
    write_parts(stream, out, scratch_path(spark, f"stream_ck/{run}"), chunk_bytes=STREAM_CHUNK).awaitTermination()
    back = spark.read.option("lineSep", "\n").text(out).where(F.col("value") != "")
    return back.groupBy(F.col("value").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def _streamed_parts(spark, sf_dir) -> str:
    from ..session import scratch_path
    from ..streaming.stream import text_stream, write_parts
    from .derived import documents_as_files
    import uuid
    folder, run = documents_as_files(spark, sf_dir), uuid.uuid4().hex
    out = scratch_path(spark, f"stream_parts/{run}")
    stream = text_stream(spark, f"{folder}/file=*", max_bytes_per_trigger=STREAM_CHUNK * STREAM_AHEAD)
    write_parts(stream, out, scratch_path(spark, f"stream_ck/{run}"), chunk_bytes=STREAM_CHUNK).awaitTermination()
    return out


@register("stream_part_tokens")
def q_stream_part_tokens(spark, sf_dir):
    """ST3: the parts of all chunks read back in order, each token with its file and
    its place there as the chunk manifests say: order is compared, not counts."""
    from ..streaming.stream import part_tokens
    from .derived import file_number
    return part_tokens(spark, _streamed_parts(spark, sf_dir)).select(file_number().alias("file"), "pos", "token")


@register("stream_manifest")
def q_stream_manifest(spark, sf_dir):
    """ST3: the files that the chunk manifests list, and whether the chunk of each
    keeps the byte limit (a file over the limit is a chunk of its own)."""
    from ..streaming.stream import chunk_manifest
    from .derived import file_number
    files = chunk_manifest(spark, _streamed_parts(spark, sf_dir))
    chunks = files.groupBy("chunk").agg(F.sum("bytes").alias("_b"), F.count("*").alias("_n"))
    kept = (F.col("_b") <= STREAM_CHUNK) | (F.col("_n") == 1)
    return files.join(chunks, "chunk").select(file_number().alias("file"), "bytes", F.col("tokens").alias("n_tokens"), kept.alias("within_limit"))


@register("file_lines")
def q_file_lines(spark, sf_dir):
    """Every line of every file with its 0-based number in the file
    (a distributed running count over (file, split, row) order)."""
    from ..sources.files import line_ordinals, read_lines
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    lines = line_ordinals(read_lines(spark, f"{folder}/file=*"))
    return lines.select(file_number().alias("file"), "line_no", "line")


@register("file_compare")
def q_file_compare(spark, sf_dir):
    """The comparison run on files: Treebank vs naive per-line tokens per file."""
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    d = compare.compare_files(spark, f"{folder}/file=*", "ptb", "ptb_lines")
    return d.select(file_number().alias("file"), "mismatched", "compared", "len_a", "len_b")


@register("mismatch_rollup_by_role")
def q_mismatch_by_role(spark, sf_dir):
    """A4 on a second table: Treebank vs whitespace per conversation turn, by role."""
    c = load_text(spark, sf_dir, "conversations", "role")
    pairs = compare.pair_tokenisations(c, ["conv_id", "turn", "role"], "text", "ptb", "whitespace")
    return compare.mismatch_rollup(compare.diff_table(pairs, ["conv_id", "turn", "role"]), ["role"])


@register("file_diff_rows")
def q_file_diff_rows(spark, sf_dir):
    """J3 on files: every mismatch of the comparison run with its context."""
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    rows = compare.diff_rows(compare.file_pairs(spark, f"{folder}/file=*"), ["path"])
    return rows.select(file_number().alias("file"), "seq", "i", "j", "kind", "cost", "a_context", "b_context")


@register("compare_parts")
def q_compare_parts(spark, sf_dir):
    """S7 + J1/J2: the whitespace tokens of every batch, written as parts and read
    back, against the Treebank tokens of the batch, chunk by chunk."""
    from ..session import scratch_path
    from ..sources.sinks import write_token_parts
    import uuid
    docs = _batched_documents(spark, sf_dir)
    out = scratch_path(spark, f"compare_parts/{uuid.uuid4().hex}")
    write_token_parts(docs, out, method="whitespace")
    return compare.compare_with_parts(docs, out).diff()


# -- S4, J1-J3 for texts of any size -------------------------------------------

LONG_PIECE = 1_000          # characters of a piece of a long line
SMALL_CHUNK = 50            # tokens of a chunk, so that documents have many


@register("long_line_tokens")
def q_long_line_tokens(spark, sf_dir):
    """S4 on files that are one line each: cut at blanks, put in order again."""
    from ..sources.files import file_token_table
    from .derived import documents_as_long_lines, file_number
    folder = documents_as_long_lines(spark, sf_dir)
    table = file_token_table(spark, f"{folder}/file=*", "blanks", LONG_PIECE)
    return table.select(file_number().alias("file"), "pos", "token")


def _chunked_ptb_vs_ws(spark, sf_dir) -> Chunked:
    pairs = _ptb_vs_ws(spark, sf_dir)
    return Chunked(runs_of(pairs, ["doc_id"], F.col("a")), runs_of(pairs, ["doc_id"], F.col("b")), ["doc_id"], SMALL_CHUNK)


@register("token_diff_chunks")
def q_token_diff_chunks(spark, sf_dir):
    """J2 with every document in chunks of 50 tokens, walked apart and linked."""
    return _chunked_ptb_vs_ws(spark, sf_dir).diff()


@register("token_diff_rows_chunks")
def q_token_diff_rows_chunks(spark, sf_dir):
    """J3 from the linked chunks: numbers by prefix sums, contexts across chunks."""
    return _chunked_ptb_vs_ws(spark, sf_dir).rows()


@register("large_file_compare")
def q_large_file_compare(spark, sf_dir):
    """S4 + J1 + J2: both tokenisations of every file made line by line and compared
    in chunks; no file and no list is ever a row."""
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    d = compare.compare_large_files(spark, f"{folder}/file=*", "ptb", "ptb_lines", size=SMALL_CHUNK).diff()
    return d.select(file_number().alias("file"), "mismatched", "compared", "len_a", "len_b")


@register("large_file_diff_rows")
def q_large_file_diff_rows(spark, sf_dir):
    """S4 + J1 + J3: the mismatches of the files, from chunks."""
    from .derived import documents_as_files, file_number
    folder = documents_as_files(spark, sf_dir)
    rows = compare.compare_large_files(spark, f"{folder}/file=*", "ptb", "ptb_lines", size=SMALL_CHUNK).rows()
    return rows.select(file_number().alias("file"), "seq", "i", "j", "kind", "cost", "a_context", "b_context")


# -- S8, F3, F9, W2, J4, J5: timing logs derived from the documents -------------

def _timings(spark, sf_dir) -> DataFrame:
    from ..operators.speedup import timing_lines
    from .derived import timing_logs
    return timing_lines(spark, f"{timing_logs(spark, sf_dir)}/lang=*")


@register("timing_lines")
def q_timing_lines(spark, sf_dir):
    from .derived import language
    return _timings(spark, sf_dir).select(language().alias("lang"), "k", "secs", "bytes", "tokens")


@register("run_matrix")
def q_run_matrix(spark, sf_dir):
    from ..operators.speedup import label_runs
    from .derived import language
    return label_runs(_timings(spark, sf_dir)).select(language().alias("lang"), "engine", "size_idx", "size_mb", "secs")


@register("speedup_report")
def q_speedup_report(spark, sf_dir):
    from ..operators.speedup import label_runs, speedup
    from .derived import language
    r = speedup(label_runs(_timings(spark, sf_dir)))
    return r.select(language().alias("lang"), "engine", "size_idx", "size_mb", "secs", "baseline_secs",
                    F.round("speedup", 6).alias("speedup"))
