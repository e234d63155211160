"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming keeps, per
position, the best score, the piece count of that path and whether it ends in an unknown character. No segmentation
is kept. Tie rules are those of the ``Unigram`` model of the tokenizers library: of equal scores the path whose last
piece starts first wins; a character that is no piece on its own may be passed as unknown at the lowest score less 10;
runs of unknown characters are one unknown token, or one token per UTF-8 byte if the vocabulary has byte pieces.

No piece of the vocabulary may hold a word mark after another character (checked on load), so the best path of a text
is the best paths of its words side by side, and words are remembered, long ones not. A character that is in no piece splits
words too. The search keeps as many positions as the longest piece has characters, whatever the length of a word.

Null and empty texts have 0 tokens; ids, null or repeated, are passed through; other columns are ignored.
The whole text counts, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import REMEMBERED, need, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Lexicon:
    """Pieces and scores with their automaton; ``count`` is the number of tokens of a normalised word."""

    LIMIT = 250_000

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        bad = [p for p, _ in pieces if MARK in p.lstrip(MARK)]
        if bad:
            raise ValueError(f"pieces with an inner word mark: {bad[:3]}")
        self.scores = dict(pieces)
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.scores))
        #: what no piece holds ends a word; a space does too, as it becomes a mark
        known = {c for p in self.scores for c in p}
        self.breaks = re.compile("([^" + "".join(map(re.escape, sorted(known))) + "]+)")
        self.memo: dict[str, int] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> Lexicon:
        """Pieces and scores of a model file; control, unknown and byte pieces match no text."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return cls(plain, any(sp.is_byte(i) for i in range(n)))

    def _outside(self, c: str) -> int:
        return len(c.encode("utf-8", "replace")) if self.bytes else 1

    def count(self, word: str) -> int:
        """Viterbi over one word, all of whose characters are in some piece."""
        size = self.longest + 1  # positions that a piece can reach back to, in a ring
        best: list[float | None] = [None] * size
        pieces, in_unknown = [0] * size, [False] * size
        best[0] = 0.0
        matches = self.automaton.iter(word)
        last, found = next(matches, (-1, None))
        at = 0
        for end in range(1, len(word) + 1):
            before, at = at, at + 1 if at + 1 < size else 0
            top, n, single, unknown = None, 0, False, False
            while last == end - 1:  # longest first, so the earliest start wins ties
                length, score = found
                k = at - length if at >= length else at - length + size
                s = best[k]
                if s is not None and (top is None or s + score > top):
                    top, n = s + score, pieces[k] + 1
                single = single or length == 1
                last, found = next(matches, (-1, None))
            s = best[before]
            if not single and s is not None and (top is None or s + self.unknown > top):
                top, unknown = s + self.unknown, True
                n = pieces[before] + (self._outside(word[end - 1]) if self.bytes else int(not in_unknown[before]))
            best[at], pieces[at], in_unknown[at] = top, n, unknown
        return pieces[at]

    def tokens(self, text: str) -> int:
        """Tokens of a whole text: a leading word mark, spaces as word marks."""
        if not text:
            return 0
        memo, total, marks = self.memo, 0, 1
        for part in text.replace(MARK, " ").split(" "):
            if not part:  # a run of spaces stays together: pieces may be runs of marks
                marks += 1
                continue
            key = part if marks == 1 else MARK * (marks - 1) + part
            n = memo.get(key)
            if n is None:
                n = self._part(MARK + key)
                if len(key) <= REMEMBERED:
                    if len(memo) >= self.LIMIT:
                        memo.clear()
                    memo[key] = n
            total, marks = total + n, 1
        return total + (self._part(MARK * (marks - 1)) if marks > 1 else 0)

    def _part(self, part: str) -> int:
        if not self.bytes:  # a run of unknown characters is one token, so it stays whole
            return self.count(part)
        return sum(self._outside(x) if k % 2 else self.count(x) for k, x in enumerate(self.breaks.split(part)) if x)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens (long) and n_chars_seen (long, code points of the text)."""
    source = need(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon.from_sentencepiece(model_path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lexicon.tokens(t or "") for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())],
                [id_col, "n_tokens", "n_chars_seen"],
            )

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(scan, f"`{id_col}` {kind}, n_tokens long, n_chars_seen long")
