"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that occurs in a
stretch of text; dynamic programming over its end positions carries the best score and the
number of pieces of the best path, nothing else. Tie rule, as in the tokenizer: among paths
of equal score to a position the one whose last piece begins first (is longest) stays.

A piece can hold the word mark only at its front, so a best path never crosses from one
word into the next, and a text's count is the sum over its words, each with the spaces
before it. Words repeat, so each executor process remembers counts of recent words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import set_aside

MARK = "▁"
REMEMBERED = 500_000
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram:
    """Pieces with scores; characters no piece covers are spelled in bytes if ``byte_fallback``.

    ``unknown`` is the score of an uncovered character (least score less ten). A run of
    uncovered characters is one unknown piece without byte fallback.
    """

    pieces: dict[str, float]
    byte_fallback: bool = True

    @property
    def unknown(self) -> float:
        return min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY


def read_sentencepiece(path: str) -> Unigram:
    """The normal pieces of a SentencePiece model file, with their stored scores.

    Read on the driver; a vocabulary is a few megabytes at most.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if crossing := [i for i in usable if MARK in model.id_to_piece(i).lstrip(MARK)]:
        raise ValueError(f"{len(crossing)} pieces hold a word mark after a letter; words cannot be counted apart")
    return Unigram({model.id_to_piece(i): model.get_score(i) for i in usable}, any(model.is_byte(i) for i in range(model.get_piece_size())))


class Counter:
    """Counts pieces of texts; made once in each task."""

    def __init__(self, model: Unigram):
        self.model, self.unknown = model, model.unknown
        self.single = {p for p in model.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in model.pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if model.pieces:
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Pieces of the best path through ``word``."""
        n = len(word)
        if self.single.issuperset(word):
            # the automaton gives the pieces that end at a place longest first, which is
            # the order of their starts: the first of equal scores stays
            best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for last, (length, score) in self.automaton.iter(word):
                start = last + 1 - length
                total = best[start] + score
                if total > best[last + 1]:
                    best[last + 1], count[last + 1] = total, count[start] + 1
            return count[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if self.model.pieces:
            for last, found in self.automaton.iter(word):
                ends[last + 1].append(found)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        in_unknown = [False] * (n + 1)
        for end in range(1, n + 1):
            matches = ends[end]
            if word[end - 1] not in self.single:
                matches = [*matches, (1, None)]
            top = None
            for length, score in sorted(matches, key=lambda m: -m[0]):  # the earliest start first: it stays on ties
                start = end - length
                total = best[start] + (self.unknown if score is None else score)
                if top is None or total > top:
                    top, take, unknown = total, start, score is None
            best[end], in_unknown[end] = top, unknown
            if not unknown:
                count[end] = count[take] + 1
            elif self.model.byte_fallback:
                count[end] = count[take] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            else:
                count[end] = count[take] + (not in_unknown[take])
        return count[n]

    def words(self, text: str) -> Iterator[str]:
        """The text as words with the marks before them; trailing marks are a word of their own.

        Joined they are the tokenizer's normal form: a mark before the text and for each space.
        """
        marks = ""
        for word in text.split(" "):
            marks += MARK
            if word:
                yield marks + word
                marks = ""
        if marks:
            yield marks

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.model.byte_fallback:  # runs of unknown characters may go on over words
            return self.viterbi(MARK + text.replace(" ", MARK))
        parts, known, total = text.split(" "), self.known, 0
        if "" in parts:
            return sum(map(self._word, self.words(text)))
        for part in parts:
            n = known.get(part)
            if n is None:
                n = self.viterbi(MARK + part)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(part) < 64:
                    known[part] = n
            total += n
        return total

    def _word(self, word: str) -> int:
        plain = word[1:]
        if plain[:1] in ("", MARK):
            return self.viterbi(word)
        n = self.known.get(plain)
        return self.viterbi(word) if n is None else n


def count_tokens(docs: DataFrame, model: Unigram, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of the number of tokens of every whole text.

    The text is not normalised but for the word marks (one before it, one for each space).
    Null and empty texts have 0 tokens. Other columns and repeated rows stay as they are; a
    column called ``name`` is ``<name>_given`` in the result. An empty table gives an empty one.
    """
    docs = set_aside(docs, name, "__text")
    # the vocabulary file's size, as a plain dictionary: executors need no copy of this package
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Unigram(*sent.value))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            found = pa.array(np.array([counter.count(t.as_py()) for t in texts], np.int64))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), found], [*(batch.schema.names[i] for i in keep), name])

    schema = StructType([*docs.schema.fields]).add(name, LongType())
    return docs.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, schema)
