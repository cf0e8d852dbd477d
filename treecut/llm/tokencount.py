"""Operator 9, token counts by a Viterbi pass that keeps no path.

The pieces and scores of a vocabulary file make a unigram model.  An
Aho-Corasick automaton gives all pieces that end at a character, the longest
first; the pass carries the best score and its number of pieces from character
to character.  Ties go as in the tokenizer (``Unigram`` of the tokenizers library,
with a ``Metaspace`` split): a later start replaces an earlier one only with a
strictly better score.  A character without a piece of its own costs the lowest
score less 10 and becomes its UTF-8 bytes.

Texts split at blanks into words, each counted once while it stays in the
worker's bounded cache.

Defined cases: a null or empty text has no tokens; a null key is carried along;
repeated rows are counted each; a text of any length needs memory for its longest
word; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, load, once_per_worker, scan

#: Words a worker keeps the counts of, and the longest of them.
CACHED_WORDS = 300_000
CACHED_LENGTH = 40
#: What an unknown character costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0
BLANK = "▁"


class Counter:
    """Counts the pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float, int]] = {}

    def word(self, text: str) -> tuple[int, float, int]:
        """Tokens, score and unknown characters of the best path."""
        if (found := self.known.get(text)) is not None:
            return found
        n = len(text)
        score, tokens, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        reached = [True] + [False] * n

        def step(start: int, end: int, cost: float, pieces: int, lost: int) -> None:
            total = cost + score[start]
            if not reached[end] or total > score[end]:
                reached[end], score[end], tokens[end], unknown[end] = True, total, tokens[start] + pieces, unknown[start] + lost

        def alone(end: int) -> None:
            """The character before ``end``, if no piece is just it."""
            c = text[end - 1]
            if c not in self.single:
                step(end - 1, end, self.unknown, len(c.encode("utf-8", "surrogatepass")), 1)

        done = 0  # characters whose lone step has been taken
        for last, (length, cost) in self.automaton.iter(text):
            while done < last:
                done += 1
                alone(done)
            step(last + 1 - length, last + 1, cost, 1, 0)
        while done < n:
            done += 1
            alone(done)
        found = tokens[n], score[n], unknown[n]
        if len(self.known) < CACHED_WORDS and n <= CACHED_LENGTH:
            self.known[text] = found
        return found

    def text(self, text: str) -> tuple[int, int, float, int]:
        """Words, tokens, score and unknown characters."""
        if not text:
            return 0, 0, 0.0, 0
        text = text.replace(" ", BLANK)
        words = text[text[0] == BLANK :].split(BLANK)
        tokens, score, unknown = zip(*(self.word(BLANK + w) for w in words))
        return len(words), sum(tokens), sum(score), sum(unknown)


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """All pieces of a vocabulary file with their scores, in the file's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_tokens(docs: DataFrame, model_file: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` and ``score`` of every row."""
    path = model_file or public_tokenizers.path("piece_bpe_32k.model")
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = dict(source.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_per_worker(("counter", path), lambda: Counter(pieces_of(path)))

        def rows() -> Iterator[tuple]:
            for doc_id, body in scan(batches, "doc_id", "_text"):
                words, tokens, score, unknown = counter.text(body or "")
                yield doc_id, words, tokens, unknown, score

        yield from emit(rows(), schema)

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long, score double")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(load(spark, sf_dir, "documents"))
