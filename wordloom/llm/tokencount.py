"""3: token counts by a count-only Viterbi over a unigram vocabulary.

The vocabulary is the pieces of a public SentencePiece model (its path is a parameter), with the
log-probabilities of Zipf's law over their ranks, in steps of 1/1024 so that sums are exact. An
Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming over the
characters carries the best score and its number of pieces, by the tie rules of the Unigram model of
the tokenizers library: starts ascending, then lengths ascending, and only a strictly better score
replaces what is there; a character without a piece of its own gets the least score less 10, and
counts as its UTF-8 bytes where the vocabulary has all byte pieces, else a run of such counts once.

Texts are taken as that library's Metaspace does: a word-start mark stands before the text and for
each space. When no piece has the mark after another character, the best path breaks before every
mark that follows one, so words are counted on their own and remembered; else the text is one word.

Nulls and edges: a null text has a null count, an empty text 0. Repeated rows have a row each. Very
long words are linear in their length. Other columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, slices

MARK = "▁"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
_CACHE = 100_000


def load_vocabulary(path: str = TOKENIZER) -> tuple[list[tuple[str, float]], int, bool]:
    """Pieces with scores, the unknown piece's id, and whether unknown characters become bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = sum(1 / (r + 1) for r in range(n))
    # control, unknown and byte pieces are no matches in a text: their score is that of the last rank
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(n)]
    rank = 0
    out = []
    for i in range(n):
        rank += plain[i]
        score = -math.log((rank if plain[i] else n) * total)
        out.append((model.id_to_piece(i), round(score * 1024) / 1024))
    return out, model.unk_id(), all(f"<0x{b:02X}>" in {p for p, _ in out} for b in range(256))


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unk_id: int, byte_fallback: bool) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece and i != unk_id:  # the library looks the unknown piece up like any other
                self.automaton.add_word(piece, (len(piece), score))
        if unk_id is not None and vocabulary[unk_id][0]:
            self.automaton.add_word(vocabulary[unk_id][0], (len(vocabulary[unk_id][0]), vocabulary[unk_id][1]))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.bytes = byte_fallback
        by_word = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$").findall if by_word else lambda t: [t]
        self.seen: dict[str, int] = {}

    def _viterbi(self, word: str) -> int:
        n = len(word)
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(word):
            by_start[end - length + 1].append((length, score))
        best, count, run = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        for s in range(n):
            here, pieces, single = best[s], count[s], False
            # matches come by ascending end, so a start's are ascending in length
            for length, score in by_start[s]:
                single |= length == 1
                if here + score > best[s + length]:
                    best[s + length], count[s + length], run[s + length] = here + score, pieces + 1, False
            if not single and here + self.unknown > best[s + 1]:
                more = len(word[s].encode("utf-8", "surrogatepass")) if self.bytes else not run[s]
                best[s + 1], count[s + 1], run[s + 1] = here + self.unknown, pieces + more, True
        return count[n]

    def word(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            found = self.seen[word] = self._viterbi(word)
        return found

    def count(self, text: str | None) -> int | None:
        if text is None:
            return None
        if not text:
            return 0
        words = self.words(MARK + text.replace(" ", MARK))
        seen = self.seen
        try:
            return sum([seen[w] for w in words])
        except KeyError:
            return sum([self.word(w) for w in words])


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens): a row for each row of docs. The vocabulary file is read by each worker's
    driver-side copy: its size is fixed, so it is broadcast."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(*shared.value)
        for b in slices(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array([counter.count(t) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
