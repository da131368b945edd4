"""Token counts under a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character. The
best segmentation's score and its number of pieces are carried from character to character;
no pieces are kept and no path is traced back. Ties go as in the public unigram tokenizers:
of equal scores the piece that begins first wins, and a character that is no piece counts
as unknown at the lowest score less 10, written as its UTF-8 bytes.

No piece crosses from text into a blank, and some characters are in no longer piece at all,
so a text falls into parts that are counted separately; a task remembers common parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_text, per_text

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, float]
    lowest: float


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file; control, unknown and byte pieces match no text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(k): model.get_score(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return Vocabulary(scores, min(model.get_score(k) for k in range(model.get_piece_size())))


class Counter:
    """Best score and number of pieces of texts, exact while sums of scores are below 2**53 units."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = vocabulary.lowest - UNKNOWN_PENALTY
        if any(BLANK in p.lstrip(BLANK) for p in vocabulary.pieces):
            raise ValueError("a piece of the vocabulary crosses into a blank")
        self._lines_apart = not any("\n" in p for p in vocabulary.pieces)
        self._parts: dict[str, complex] = {}

    def part(self, text: str) -> complex:
        """Pieces and score of a part, as one number that adds up: pieces + score * 1j."""
        size = len(text)
        best, pieces = [0.0] * (size + 1), [0] * (size + 1)
        matched = self._automaton.iter(text)
        end, match = next(matched, (size, None))
        for at in range(size):
            score = count = None
            single = False
            while end == at:  # the longest first, so that the earliest start wins a tie
                length, worth = match
                if score is None or best[at + 1 - length] + worth > score:
                    score, count = best[at + 1 - length] + worth, pieces[at + 1 - length] + 1
                single = single or length == 1
                end, match = next(matched, (size, None))
            if not single and (score is None or best[at] + self._unknown > score):
                score, count = best[at] + self._unknown, pieces[at] + len(text[at].encode("utf-8", "surrogatepass"))
            best[at + 1], pieces[at + 1] = score, count
        return complex(pieces[size], best[size])

    def _known(self, part: str) -> complex:
        value = self._parts.get(part)
        if value is None:
            if len(self._parts) >= REMEMBERED:
                self._parts.clear()
            value = self._parts[part] = self.part(part)
        return value

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text, with a blank put before it as the tokenizer does."""
        if not text:
            return 0, 0.0
        text = BLANK + text.replace(" ", BLANK)
        total = 0j
        lines = text.split("\n") if self._lines_apart else [text]
        known, parts = self._known, self._parts
        for line in lines:
            first, *rest = line.split(BLANK)
            if first:
                total += parts.get(first) or known(first)
            blanks = BLANK
            for piece in rest:
                if piece:
                    total += parts.get(blanks + piece) or known(blanks + piece)
                    blanks = BLANK
                else:
                    blanks += BLANK
            if len(blanks) > 1:
                total += known(blanks[1:])
        if len(lines) > 1:
            total += (len(lines) - 1) * known("\n")
        return int(total.real), total.imag


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score, n_chars for every row of docs.

    model_path is a SentencePiece model file that every executor can read, whose pieces and
    scores serve as the unigram vocabulary; texts are taken as they are, as a file whose
    normaliser is the identity asks for. A null or empty text has 0 tokens and score 0. Other
    columns are ignored whatever their names; repeated rows stay repeated; an empty table
    gives none.
    """

    def make():
        counter = Counter(read_vocabulary(model_path))
        return lambda text: (*counter.count(text or ""), len(text or ""))

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("n_chars", pa.int64())])
    return per_text(id_text(docs, id_col, text_col), make, schema, "doc_id long, n_tokens long, score double, n_chars long")
