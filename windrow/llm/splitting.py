"""Splitting of oversized texts at natural boundaries, with an overlap between consecutive pieces.

Sizes are tokens of a public vocabulary. The tokens of a text have byte offsets (prefix sums of their lengths); its
boundaries of each level are sorted arrays of token indexes. A piece ends at the last boundary under the limit of the
highest level that fills at least ``fill`` of it, found by binary search, else by a hard cut between two characters;
the next piece starts ``overlap`` tokens before that end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from windrow.llm.encoding import VOCABULARY, FragmentEncoder, encoder_for, shared_vocabulary
from windrow.session import widened

LIMIT, OVERLAP, FILL = 256, 32, 0.5

#: Boundary levels in order of preference; each pattern matches at a boundary's place.
LEVELS = (
    ("paragraph", re.compile(r"(?<=\S)(?=[^\S\n]*\n[^\S\n]*\n)|(?<=\S)(?=\n#)")),
    ("line", re.compile(r"(?<=\S)(?=[^\S\n]*\n)")),
    ("sentence", re.compile(r"(?<=[.!?…][\"'”’»)\]])(?=\s)|(?<=[.!?…])(?=\s)|(?<=[。！？])(?=[^\s」』”）])")),
    ("word", re.compile(r"(?<=\S)(?=\s)")),
)


def pieces_of(encoder: FragmentEncoder, text: str, limit: int, overlap: int, fill: float = FILL) -> Iterator[tuple[int, int, int, int, str]]:
    """(first char, end char, tokens, tokens shared with the piece before, boundary at the end) of each piece."""
    ids = encoder.encode(text)
    n = len(ids)
    if n <= limit:
        if n:
            yield 0, len(text), n, 0, "end"
        return
    byte_ends = np.cumsum(encoder.token_bytes[ids])
    starts = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(starts)])
    # chars[k]: characters before token k, or -1 where token k begins within a character
    at = np.concatenate([[0], byte_ends])
    whole = np.concatenate([starts, [True]])[at]
    chars = np.where(whole, chars_before[at], -1)
    token_at = np.full(len(text) + 1, -1, np.int64)
    token_at[chars[whole]] = np.flatnonzero(whole)
    found: list[list[int]] = []  # boundaries of a level, made when it is first asked for

    def ends_of(level: int) -> list[int]:
        if level == len(found):
            k = token_at[[m.start() for m in LEVELS[level][1].finditer(text)]]
            found.append(np.sort(k[k >= 0]).tolist())
        return found[level]

    start, shared = 0, 0
    while True:
        if n - start <= limit:
            yield int(chars[start]), len(text), n - start, shared, "end"
            return
        end, kind = 0, "hard"
        for level, (name, _) in enumerate(LEVELS):
            ends = ends_of(level)
            i = bisect_right(ends, start + limit) - 1
            if i >= 0 and ends[i] >= start + max(fill * limit, overlap + 1):
                end, kind = ends[i], name
                break
        if not end:
            end = start + limit
            while end > start + overlap + 1 and chars[end] < 0:
                end -= 1
        yield int(chars[start]), int(chars[end]), end - start, shared, kind
        back = end - overlap
        # not within a character, nor at an apostrophe, which a text's start would read otherwise
        while back > start + 1 and (chars[back] < 0 or text[chars[back] : chars[back] + 1] == "'"):
            back -= 1
        if chars[back] < 0:
            back = end
        start, shared = back, end - back


def split_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every text of ``df``.

    Columns: ``id_column``, piece_index, n_pieces, start_char, end_char (code points), n_tokens, overlap_tokens (shared
    with the piece before), boundary (paragraph, line, sentence, word, hard, or end for a last piece), piece. A text within
    the limit is one piece; null and empty texts have none; repeated rows are split each. The overlap is exact but
    where a token boundary lies within a character; there it is longer by the few tokens of that character.
    """
    if not 0 <= overlap < fill * limit or limit < 8:
        raise ValueError("limit must be 8 or more and overlap less than fill * limit")
    shared_file = shared_vocabulary(df.sparkSession, vocabulary)
    id_kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "piece_index", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary", "piece"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared_file.value)
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            size = 0
            for r, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                got = list(pieces_of(encoder, text, limit, overlap, fill))
                for i, (a, b, n, o, kind) in enumerate(got):
                    rows.append((i, len(got), a, b, n, o, kind, text[a:b]))
                    take.append(r)
                size += len(text)
                if size > 8 << 20:  # texts of any length; batches out stay small
                    yield out(batch, take, rows)
                    rows, take, size = [], [], 0
            yield out(batch, take, rows)

    def out(batch: pa.RecordBatch, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 8
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return widened(df.select(id_column, text_column)).mapInArrow(split, f"`{id_column}` {id_kind}, piece_index int, n_pieces int, start_char bigint, end_char bigint, n_tokens int, overlap_tokens int, boundary string, piece string")
