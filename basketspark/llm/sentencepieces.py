"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi search.

The automaton over all pieces reads a text once. At every position it names, along its
output links, the pieces that end there; each relaxes the best score of the position by the
best score at its start plus its own. The back pointers give the pieces of the best sum. A
character that is no piece by itself may also be read as its UTF-8 bytes (at a score below
all pieces); the byte pieces stand for it in the result. Of equal sums the one with the
longer last piece wins.

Spaces become the mark U+2581, with one in front of the text. Where no piece of a model goes
on after a word into a mark, or holds a line feed, the search never reaches across these
places; then it's run for each word met for the first time, and the ids of words seen before
are remembered, but for very long ones. With other models it's run over whole texts.

Defined results: null and empty texts have no ids; a text with U+2581 itself decodes to
spaces; everything else comes back exactly; repeated rows are encoded one by one; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_or_nobody, null_again, small_batches

MARK = "▁"
WORD = re.compile("\n|▁*[^▁\n]+|▁+")
#: So many words are remembered, of so many characters.
REMEMBERED, LONGEST = 400_000, 64
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


class Pieces(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes, encoded when first asked for."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.byte = [0] * 256
        self.text: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.text.append(piece.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"")
            if kind in (NORMAL, USER):
                self.automaton.add_word(piece, (i, score, len(piece)))
        self.automaton.make_automaton()
        used = [p for p in pieces if p[2] in (NORMAL, USER)]
        self.whole = any(re.search("[^▁]▁|\n", p[0]) for p in used)
        self.single = {p[0] for p in used if len(p[0]) == 1}
        self.unknown = min(p[1] for p in used) - 10

    def viterbi(self, word: str) -> list[int]:
        n = len(word)
        best, length, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        found = iter(self.automaton.iter(word))
        hit = next(found, None)
        for end in range(n):
            if word[end] not in self.single:
                best[end + 1], length[end + 1] = best[end] + self.unknown, 1
            while hit is not None and hit[0] == end:
                i, score, size = hit[1]
                score += best[end + 1 - size]
                if score > best[end + 1] or (score == best[end + 1] and size > length[end + 1]):
                    best[end + 1], length[end + 1], piece[end + 1] = score, size, i
                hit = next(found, None)
        parts, at = [], n
        while at:
            parts.append([piece[at]] if piece[at] >= 0 else [self.byte[b] for b in word[at - 1].encode("utf-8", "surrogatepass")])
            at -= length[at]
        return [i for part in reversed(parts) for i in part]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = array("I", self.viterbi(word)).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        return array("I", self.viterbi(marked)).tobytes() if self.whole else b"".join(map(self.__getitem__, WORD.findall(marked)))

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.text.__getitem__, array("I", ids)))
        return data.decode("utf-8", "surrogatepass").removeprefix(" ")


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return Pieces([(p.piece, p.score, p.type) for p in model.pieces])


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of its text, as packed little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces(model)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].array, "ids": [known.encode(t) if t else b"" for t in f["text"]]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(id_or_nobody("doc_id"), "text")
    return null_again(rows.mapInPandas(run, "doc_id long, ids binary"), "doc_id")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces(model)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].array, "text": [known.decode(bytes(x)) for x in f["ids"]]})

    return null_again(encoded.select(id_or_nobody("doc_id"), "ids").mapInPandas(run, "doc_id long, text string"), "doc_id")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_bytes_as_pieces, decoded_sha256, restored of every row: encoded, then decoded, in one pass."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces(model)
        bytes_ = set(known.byte)
        for f in frames:
            rows = []
            for text in f["text"]:
                ids = known.encode(text) if text else b""
                back = known.decode(ids)
                data = back.encode("utf-8", "surrogatepass")
                spelled = sum(map(bytes_.__contains__, array("I", ids)))
                rows.append((len(ids) // 4, zlib.crc32(ids), spelled, hashlib.sha256(data).hexdigest(), back == (text or "").replace(MARK, " ")))
            out = pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "n_bytes_as_pieces", "decoded_sha256", "restored"])
            out.insert(0, "doc_id", f["doc_id"].array)
            yield out

    schema = "doc_id long, n_ids long, ids_crc32 long, n_bytes_as_pieces long, decoded_sha256 string, restored boolean"
    return null_again(docs.select(id_or_nobody("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema), "doc_id")
