"""Token counts under a unigram model, with forward scores shared along a trie.

The distinct pre-tokens of a batch, in sorted order, are the paths of a trie: neighbours
share their common prefix. The forward scores (best log-probability of each prefix, and
its number of tokens) live on a stack, are kept for the shared prefix, and are computed
only for the characters behind it. The terminal's count is stored for its pre-token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

MARK = "▁"


@dataclass(frozen=True)
class UnigramVocabulary:
    """Log-probabilities of pieces. Other characters cost one token for each UTF-8 byte."""

    pieces: dict[str, float]
    byte: float
    #: Every ending of a piece, with the piece's log-probability where the ending is a piece.
    endings: dict[str, float | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for piece in self.pieces:
            for k in range(len(piece)):
                self.endings[piece[k:]] = self.pieces.get(piece[k:])

    @classmethod
    def load(cls, path: str) -> UnigramVocabulary:
        """Pieces of a sentencepiece file.

        The file's pieces have ranks rather than probabilities; they count as
        probabilities by Zipf's law, rank r having log-probability -log(r + 2) less a
        constant for all. Byte pieces get that of the last rank.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [
            (-model.get_score(k), model.id_to_piece(k))
            for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)) and model.get_score(k) > -1e8
        ]
        total = math.log(sum(1 / (r + 2) for r in range(len(ranked))))
        pieces = {piece: -math.log(r + 2) - total for r, (_, piece) in enumerate(sorted(ranked))}
        return cls(pieces, -math.log(len(ranked) + 2) - total)


def trie_counts(pretokens: list[str], vocabulary: UnigramVocabulary) -> dict[str, int]:
    """Tokens of the best segmentation of each pre-token; of equal scores the fewer tokens."""
    endings, byte = vocabulary.endings, vocabulary.byte
    score, tokens = [0.0], [0]
    before, out = "", {}
    for word in sorted(set(pretokens)):
        text = MARK + word
        shared, most = 0, min(len(before), len(text))
        while shared < most and before[shared] == text[shared]:
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            width = len(text[end - 1].encode())
            best, count = score[end - 1] + byte * width, tokens[end - 1] + width
            for start in range(end - 1, -1, -1):
                own = endings.get(text[start:end], 0.0)
                if own == 0.0:
                    break
                if own is not None:
                    own += score[start]
                    if own > best or own == best and tokens[start] + 1 < count:
                        best, count = own, tokens[start] + 1
            score.append(best)
            tokens.append(count)
        out[word] = tokens[-1]
        before = text
    return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", remembered: int = 1_000_000) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row.

    Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, each with a word mark
    in front. Null and empty texts have none. A task remembers counts of up to
    ``remembered`` pre-tokens between batches. Repeated rows are counted each.
    """
    loaded = UnigramVocabulary.load(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = [[w.decode() for w in (t.as_py() or "").encode().split()] for t in part.column(1)]
                new = set().union(*words) - known.keys()
                if len(known) + len(new) > remembered:
                    known.clear()
                    new = set().union(*words)
                known.update(trie_counts(list(new), loaded))
                counts = [sum(map(known.__getitem__, own)) for own in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    taken = columns(docs, doc_id, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return taken.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
