"""Encoding of whole texts by a byte-level BPE vocabulary, with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token is never merged, so the text is certain to be
cut there. Because no token of these vocabularies runs over a space that follows a non-space, the cuts include every
word start. Fragments between certain cuts are encoded independently (each distinct one once a worker) and their ids
are concatenated, which gives exactly the ids of the whole text.

Null and empty texts have no tokens: their ids are the empty list.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from windrow.session import widened

#: Where the public vocabulary lies by default; every operator takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which the public vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments up to this many characters are kept, at most so many a worker.
KEPT_CHARS, KEPT = 48, 200_000


class FragmentEncoder:
    """Encodes texts by the vocabulary in ``rank_file``, the content of a rank file."""

    def __init__(self, rank_file: bytes) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self._bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pretokens = regex.compile(PATTERN)
        inside = np.zeros((256, 256), bool)
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for token, rank in ranks.items():
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
            lengths[rank] = len(b)
        #: certain[a, b]: the bytes a, b are neighbours inside no token.
        self.certain = ~inside
        #: Bytes of each token.
        self.token_bytes = lengths
        # White space at which a non-space is always left: all pairs with it are certain, but for bytes that end
        # both letters and no-break spaces; there the pattern itself cuts, since the left side is no white space.
        visible = [b for b in range(0x21, 0x100) if b not in (0x7F, 0xA0)]
        opening = [w for w in b" \n\t\r" if self.certain[visible, w].all()]
        spaces = "".join(map(re.escape, map(chr, opening)))
        self._fragments = re.compile(rf"\s*\S+(?:(?![{spaces}])\s\S*)*|\s+" if opening else r"(?s).+").findall
        self._kept: dict[str, list[int]] = {}

    def _encode_fragment(self, fragment: str) -> list[int]:
        if len(fragment) <= KEPT_CHARS:
            ids = self._bpe.encode_ordinary(fragment)
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[fragment] = ids
            return ids
        ids = []
        for piece in self._pretokens.findall(fragment):
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) <= KEPT_CHARS:
                ids += self._bpe._encode_single_piece(raw)
                continue
            b = np.frombuffer(raw, np.uint8)
            cuts = [0, *(np.flatnonzero(self.certain[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
            for i, k in zip(cuts, cuts[1:]):
                ids += self._bpe._encode_single_piece(raw[i:k])
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept, ids = self._kept, []
        for fragment in self._fragments(text):
            ids += kept.get(fragment) or self._encode_fragment(fragment)
        return ids

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=4)
def encoder_for(rank_file: bytes) -> FragmentEncoder:
    """One encoder a worker and vocabulary."""
    return FragmentEncoder(rank_file)


def shared_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file as a broadcast variable: it has a fixed size, under 2 MB, that no data changes."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > 16 << 20:
        raise ValueError(f"{path} is no vocabulary file: {len(content)} bytes")
    return spark.sparkContext.broadcast(content)


def encode_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of every row of ``df``, without special tokens.

    One pass, no shuffle. Null and empty texts give the empty list; repeated rows are encoded each; columns beside
    the two named ones aren't read; an empty table gives an empty result.
    """
    shared = shared_vocabulary(df.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(shared.value)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                flat.extend(enc.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return widened(df.select(id_column, text_column)).mapInArrow(encode, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY, as_column: str = "n_tokens") -> DataFrame:
    """``df`` with ``text_column`` replaced by its number of tokens, ``as_column``. Null and empty texts have 0."""
    shared = shared_vocabulary(df.sparkSession, vocabulary)
    rest = [f for f in df.schema.fields if f.name != text_column]
    if as_column in {f.name for f in rest}:
        raise ValueError(f"{as_column} is a column already; name another")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(shared.value)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*batch.schema.names[1:], as_column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return widened(df.select(text_column, *[f.name for f in rest])).mapInArrow(counted, f"{schema}, `{as_column}` bigint")
