"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search."""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.llm.text import as_bytes, own_names
from tracksmith.session import bounded_batches

MARK = "▁"
#: An unknown character scores so much less than the worst piece (fixed value of the format).
UNKNOWN_PENALTY = 10.0
#: Best segmentations of word-like parts that a task keeps.
CACHE = 60_000


class Pieces:
    """The pieces and scores of a SentencePiece model file, and best segmentations under them.

    encode() finds the segmentation with the greatest sum of piece scores (for a file of merge ranks this is not the library's
    merge order, but decodes to the same text); an unknown
    character is spelled in byte pieces if the model has them, else it is the unknown piece. Of equally good segmentations
    the one whose last piece is longest is taken, at every position.
    """

    def __init__(self, model_file: str) -> None:
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.automaton, scores = ahocorasick.Automaton(), []
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.single = set()
        for i, piece in enumerate(self.names):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)):
                scores.append(sp.get_score(i))
                self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = sp.unk_id()
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # a text can be cut before a run of marks unless a piece holds a mark behind another character
        self.cut_runs = not any(MARK in p.lstrip(MARK) for p in self.names)
        self.spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else " ⁇ ".encode() if i == self.unknown else b"" if sp.is_control(i) else as_bytes(p.replace(MARK, " ")) for i, p in enumerate(self.names)]
        self.part = lru_cache(CACHE)(self._viterbi)

    def _viterbi(self, text: str) -> tuple[int, ...]:
        """Best ids of a normalised text, in one pass.

        At every end position the automaton follows its output links from the longest piece that ends there to the shortest;
        each relaxes the position's best score, so at equal scores the longest piece stays.
        """
        n = len(text)
        known = self.single.issuperset(text)
        best, back = [0.0] + [-math.inf] * n, [(1, -1)] * (n + 1)
        filled = 0
        for last, (size, score, i) in self.automaton.iter(text):
            end = last + 1
            if not known and filled < last:
                filled = self._spell_unknown(text, best, back, filled, last)
            score += best[end - size]
            if score > best[end]:
                best[end] = score
                back[end] = (size, i)
        if not known:
            self._spell_unknown(text, best, back, filled, n)
        ids: list[int] = []
        at = n
        while at:
            size, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(as_bytes(text[at - 1]))]
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknown characters are one unknown piece
                ids.append(self.unknown)
            at -= size
        return tuple(reversed(ids))

    def _spell_unknown(self, text: str, best: list[float], back: list[tuple[int, int]], done: int, to: int) -> int:
        """Relax positions done + 1 to to, where a character that is no piece ends, with that character as unknown."""
        for end in range(done + 1, to + 1):
            if text[end - 1] not in self.single and best[end - 1] + self.unknown_score > best[end]:
                best[end] = best[end - 1] + self.unknown_score
                back[end] = (1, -1)
        return to

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return []
        text = self.sp.normalize(text)
        if not self.cut_runs:
            return list(self._viterbi(text))
        out: list[int] = []
        for part in _parts(text):
            out += self.part(part) if len(part) <= 64 else self._viterbi(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are joined to UTF-8, marks become spaces, the mark in front is dropped."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _parts(text: str) -> list[str]:
    """Cut before each run of marks: only pieces made of marks alone hold a mark behind their first character."""
    bits = text.split(MARK)
    out, marks = ([bits[0]] if bits[0] else []), 0
    for bit in bits[1:]:
        marks += 1
        if bit:
            out.append(MARK * marks + bit)
            marks = 0
    return out + ([MARK * marks] if marks else [])


@lru_cache(2)
def pieces(model_file: str) -> Pieces:
    """One automaton for each Python worker and model."""
    return Pieces(model_file)


def encode_decode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` (array of int), ``n_pieces``, ``decoded`` (the text read back from the ids) and ``exact``.

    exact: decoded equals the text itself (a model that changes white space or characters gives false there).
    Null and empty texts: no ids, decoded empty, exact. model_file is a path that the executors can read. Other columns of
    docs stay, but those four names are replaced.
    """
    bounded_batches(docs.sparkSession, 512)

    @F.pandas_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pd.Series) -> pd.DataFrame:
        model = pieces(model_file)
        ids, decoded = [], []
        for t in texts:
            found = model.encode(t)
            ids.append(np.array(found, np.int32))
            decoded.append(model.decode(found))
        return pd.DataFrame({"ids": ids, "decoded": decoded})

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_pieces", "decoded", "exact")]
    c = own_names(docs, "coded")["coded"]
    whole = own_names(docs, "whole")["whole"]
    coded = docs.select(*own, F.col(f"`{text}`").alias(whole), both(F.col(f"`{text}`")).alias(c))
    return coded.select(*own, F.col(f"{c}.ids").alias("ids"), F.size(f"{c}.ids").cast("long").alias("n_pieces"), F.col(f"{c}.decoded").alias("decoded"), (F.col(f"{c}.decoded") == F.coalesce(F.col(whole), F.lit(""))).alias("exact"))
