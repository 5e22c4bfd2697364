"""Byte-pair encoding by content-defined chunks that documents share.

A rolling hash over the bytes cuts texts into chunks at places that depend on the content
alone, so documents with the same passages get the same chunks. A task encodes each
distinct chunk once. Tokens at a chunk's ends depend on its neighbours: at each join the
stretch around it is encoded again, growing outwards on both sides until it begins and
ends at a token boundary of its chunks that no pre-token can cross. There both encodings
agree, and the result is the encoding of the whole text, exactly.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, columns, released, small_batches

#: Letters and digits of ASCII. A single space between two of them always starts a pre-token.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Spaces beside white space, other white space, and a lead byte of white space beyond ASCII.
LOOSE = (b"  ", b" \n", b"\n ", b" \t", b"\t ", b" \r", b"\r ", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2")
BEYOND_LATIN = bytes(range(0xC9, 256))


@dataclass(frozen=True)
class BpeSettings:
    #: Tokenizer file, and the same vocabulary as ranks; without ranks the file alone is used.
    tokenizer: str
    ranks: str | None = None
    window: int = 16
    #: Mean bytes of a chunk, a power of two.
    chunk: int = 1024
    #: Bytes of memory for remembered chunks, and number of words, whose encoding a task remembers.
    remembered: int = 24_000_000
    words: int = 400_000
    seed: int = 3


#: Bytes that a dictionary entry of two byte strings takes besides their content.
ENTRY = 170


class ChunkEncoder:
    """Encodes and decodes texts in one task, remembering chunks.

    Ids are held as bytes, four for each, so that what is remembered has a known size.
    """

    def __init__(self, settings: BpeSettings) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.settings = settings
        self.whole = Tokenizer.from_file(settings.tokenizer)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = {t.content: k for k, t in self.whole.get_added_tokens_decoder().items()}
        self.fast = None
        if settings.ranks:
            self.fast = self._ranked(settings.ranks)
        self.bytes_of = self._token_bytes()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.hasher = SpanHasher(settings.seed)
        self.known: dict[bytes, bytes] = {}
        self.word: dict[bytes, bytes] = {}
        self.size = 0
        self.encoded = self.reused = 0

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _token_bytes(self) -> list[bytes]:
        """Bytes of each token: the vocabulary writes each byte as one printable character."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        out = [b""] * (max(self.whole.get_vocab().values(), default=-1) + 1)
        for token, k in self.whole.get_vocab().items():
            out[k] = token.encode() if token in self.added else bytes(byte[c] for c in token)
        return out

    def plain(self, data: bytes) -> bytes:
        """Ids of bytes that hold no added token.

        Beyond the Latin ranges the two libraries may class characters by different
        editions of Unicode; such data goes to the tokenizer file's own library.
        """
        if self.fast and (data.isascii() or len(data.translate(None, BEYOND_LATIN)) == len(data)):
            for x in LOOSE:
                if x in data:
                    return packed_ids(self.fast.encode_ordinary(data.decode()))
            return self.spaced(data)
        return packed_ids(self.whole.encode(data.decode(), add_special_tokens=False).ids)

    def spaced(self, data: bytes) -> bytes:
        """Ids of bytes in which every space starts a pre-token: word by word, words remembered."""
        first, *words = data.split(b" ")
        known = self.word
        out = [packed_ids(self.fast.encode_ordinary(first.decode()))] if first else []
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) >= self.settings.words:
                    known.clear()
                ids = packed_ids(self.fast.encode_ordinary(" " + w.decode()))
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def chunk(self, data: bytes) -> np.ndarray:
        """Ids of a chunk."""
        found = self.known.get(data)
        if found is None:
            found = self.plain(data)
            size = len(data) + len(found) + ENTRY
            if self.size + size > self.settings.remembered:
                self.known.clear()
                self.size = 0
            self.known[data] = found
            self.size += size
            self.encoded += len(data)
        else:
            self.reused += len(data)
        return np.frombuffer(found, "<u4")

    def cuts(self, data: bytes) -> tuple[list[int], np.ndarray]:
        """Chunk bounds from the rolling hash, and the places where a pre-token surely starts."""
        raw = np.frombuffer(data, np.uint8)
        w = self.settings.window
        prefix = self.hasher.prefix(raw)
        at = np.arange(max(0, len(raw) - w))
        rolling = self.hasher.spans(prefix, at, at + w)
        places = at[(rolling & np.uint64(self.settings.chunk - 1)) == 0] + w
        places = places[(raw[places] & 0xC0) != 0x80]
        safe = np.flatnonzero((raw[1:-1] == 32) & PLAIN[raw[:-2]] & PLAIN[raw[2:]]) + 1
        return [0, *places.tolist(), len(raw)], safe

    def piece(self, data: bytes) -> bytes:
        """Ids of a stretch between added tokens, from chunks with repaired joins."""
        if not data:
            return b""
        bounds, safe = self.cuts(data)
        low = np.searchsorted(safe, np.array(bounds[:-1]) + 1).tolist()
        high = (np.searchsorted(safe, bounds[1:]) - 1).tolist()
        out = []
        done = 0  # bytes whose tokens are final; then comes an open stretch up to the next agreement
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            ids = self.chunk(data[a:b])
            if low[k] > high[k]:
                continue  # no agreement within this chunk: the open stretch grows over it
            ends = self.length_of[ids].cumsum()
            left, right = int(safe[low[k]]) - a, int(safe[high[k]]) - a
            i, j = np.searchsorted(ends, (left, right)).tolist()
            if done == a == 0:
                left, i = 0, -1
            elif ends[i] != left:
                continue
            if ends[j] != right:
                continue
            if done < a + left:
                out.append(self.plain(data[done : a + left]))
            out.append(ids[i + 1 : j + 1].tobytes())
            done = a + right
        if done < len(data):
            out.append(self.plain(data[done:]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each; added tokens in it are split off first, leftmost first."""
        out = []
        at = 0
        while True:
            found = [(k, -len(t), t) for t in self.added if (k := text.find(t, at)) >= 0]
            if not found:
                return b"".join([*out, self.piece(text[at:].encode())])
            k, _, token = min(found)
            out += [self.piece(text[at:k].encode()), packed_ids([self.added[token]])]
            at = k + len(token)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def coded(docs: DataFrame, settings: BpeSettings, doc_id: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """Encoding of every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``full`` also ``ids`` (array) and ``decoded``. A null text is empty: no tokens.
    Repeated rows are coded each; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(settings)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [encoder.packed(t.as_py() or "") for t in part.column(1)]
                decoded = [encoder.decode(x) for x in ids] if full else map(encoder.decode, ids)
                arrays = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if full:
                    arrays += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    taken = columns(small_batches(docs), doc_id, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return taken.mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)
