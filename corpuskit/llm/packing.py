"""Packing by power-of-two decomposition.

Every document's token ids, closed by an end id, are cut into pieces of
``seq_len`` tokens and then into the binary digits of what is left, largest
first.  Each piece is a sequence of its own: no sequence holds two documents and
none needs padding, since all lengths are powers of two.  Sequences of the same
length share a bucket, from which batches of one shape are drawn.

A text is cut before each single space that a non-space follows.  The
tokenizer's own pre-split has a border there in every case, so the ids of such a
unit do not depend on its neighbours: each worker encodes a unit once and
remembers it, in a memory of bounded size.

Defined results: a null or empty text is the end id alone (one piece of length
1); a repeated row is packed again, as a document of its own, under the same
``doc_id``; a null ``doc_id`` is kept; an empty table gives no pieces.  Further
columns of ``docs`` are not read.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"

#: The byte-level tokenizer's pre-split pattern (fixed value of the public vocabulary).
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class UnitEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit values, through remembered units.

    Maps what follows a cut's space to the ids of the space and it; a missing
    entry is encoded on first use, and all are forgotten at ``most_units``.
    """

    def __init__(self, path: str, most_units: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_split = regex.compile(PRE_SPLIT).findall
        self.uneven = re.compile(r" (?:\s|$)").search
        self.cut = re.compile(r" (?=\S)").split
        self.bytes_to_chars = str.maketrans({chr(b): c for b, c in _printable_bytes().items()})
        self.most_units, self.words = most_units, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most_units:
            self.clear()
            self.words.clear()
        ids = self[unit] = self.direct(" " + unit)
        return ids

    def direct(self, text: str) -> bytes:
        return b"".join(map(self._word, self.pre_split(text)))

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            mapped = word.encode().decode("latin-1").translate(self.bytes_to_chars)
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # an added token may stand inside a unit
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *units = self.cut(text) if self.uneven(text) else text.split(" ")
        return self.direct(first) + b"".join(map(self.__getitem__, units))


def _printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it is printable, else as the next free character from 256."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_lengths(n: int, seq_len: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then the binary digits of the rest."""
    rest = n % seq_len
    return [seq_len] * (n // seq_len) + [1 << k for k in range(seq_len.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 0, most_units: int = 600_000) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset)`` of ``docs(doc_id, text)``.

    ``ids`` holds little-endian unsigned 32-bit ids; ``bucket`` is log2 of the
    length.  ``sequence_id`` has the bucket in its top bits, so ids of a bucket
    are neighbours.  One narrow pass without a shuffle.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        encode = UnitEncoder(tokenizer, most_units).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounded output batches
                part = batch.slice(at, 512)
                rows: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, seq_len):
                        for col, v in zip(rows, (doc_id, start, length, n, ids[4 * start:4 * (start + length)])):
                            col.append(v)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    out = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)
    bucket = F.round(F.log2("length")).cast("int")
    return out.withColumn("bucket", bucket).withColumn("sequence_id", F.shiftleft(bucket.cast("bigint"), 58) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per piece length, so that a reader draws batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)
