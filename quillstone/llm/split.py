"""Split oversized texts at natural boundaries.

Every position between two characters has a boundary strength. The cut after a piece is the strongest
position in the window of permissible piece lengths (ties: the rightmost), found with a sparse table for
range maxima. The next piece starts ``overlap`` characters before the cut.

Defined cases: a null text gives one piece of null text and length 0; an empty text one empty piece; a text of at most
``max_chars`` one whole piece; repeated rows give repeated pieces. Lengths count Unicode code points. Where
a window has no natural boundary the cut falls on its last position that parts no CRLF and no combining mark. Only the
columns in ``keep`` are carried; one named like an output comes out with ``_in`` appended. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.session import spared

#: Strengths, in rising order: inside a grapheme, inside a word, after white space, after a clause, after a sentence, after a line, after a paragraph.
GRAPHEME, INSIDE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
SENTENCE_MARKS, CLAUSE_MARKS, CLOSERS = ".!?…؟۔。！？", ",;:،؛—–", "\"'”’»)]"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], dtype=np.uint32))


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of the cut before each position 0..len(text)."""
    codes = _codes(text)
    n = len(codes)
    out = np.full(n + 1, INSIDE, dtype=np.int8)
    if n == 0:
        return out
    space = _among(codes, " \t  　​")
    newline = _among(codes, "\n\r  \x0b\x0c\x85")
    blank = space | newline
    out[1:][blank] = SPACE
    index = np.arange(n)
    # The last visible character at or before each position, closing quotes and brackets skipped.
    solid = np.where(blank | _among(codes, CLOSERS), -1, index)
    last = np.maximum.accumulate(solid)
    mark = codes[np.maximum(last, 0)]
    seen = last >= 0
    # A mark counts only where white space follows it, and the cut is after that white space.
    out[1:][blank & seen & _among(mark, CLAUSE_MARKS)] = CLAUSE
    out[1:][blank & seen & _among(mark, SENTENCE_MARKS)] = SENTENCE
    out[1:][newline] = LINE
    # A paragraph ends where at least two line breaks lie in one run of white space; CRLF is one break.
    crlf = np.zeros(n, dtype=bool)
    crlf[1:] = (codes[1:] == 10) & (codes[:-1] == 13)
    breaks = np.cumsum(newline & ~crlf)
    ink = np.maximum.accumulate(np.where(blank, -1, index))
    since = breaks - np.where(ink >= 0, breaks[np.maximum(ink, 0)], 0)
    out[1:][newline & (since >= 2)] = PARAGRAPH
    # White space belongs to the piece it closes: a cut before white space is no better than one inside a word.
    out[:-1][blank] = np.minimum(out[:-1][blank], INSIDE)
    out[:-1][crlf] = GRAPHEME
    combining = ((codes >= 0x300) & (codes <= 0x36F)) | ((codes >= 0x64B) & (codes <= 0x65F)) | ((codes >= 0xFE00) & (codes <= 0xFE0F)) | (codes == 0x200D)
    out[:-1][combining] = GRAPHEME
    out[0] = out[n] = PARAGRAPH
    return out


class RangeMaximum:
    """Sparse table over keys (strength, position): the largest key of a window is its strongest, rightmost cut."""

    def __init__(self, strengths: np.ndarray, longest: int) -> None:
        keys = strengths.astype(np.int64) * len(strengths) + np.arange(len(strengths))
        self.n, self.levels = len(strengths), [keys]
        width = 1
        while 2 * width <= min(longest, self.n):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def argmax(self, first: int, last: int) -> int:
        """Position of the maximum in first..last, both included."""
        level = (last - first + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[first], row[last - (1 << level) + 1]) % self.n)


def cuts(text: str, max_chars: int, overlap: int, min_chars: int) -> list[tuple[int, int]]:
    """Start and end of each piece."""
    n = len(text)
    if n <= max_chars:
        return [(0, n)]
    table = RangeMaximum(boundary_strengths(text), max_chars - min_chars + 1)
    out, start = [], 0
    while n - start > max_chars:
        end = table.argmax(start + min_chars, start + max_chars)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def split_oversized(df: DataFrame, text: str, keep: Sequence[str], max_chars: int = 4000, overlap: int = 800, min_chars: int | None = None) -> DataFrame:
    """``keep`` columns with piece_index (from 0), piece_start, piece_end, piece_count and piece_text.

    Texts within the limit never leave the JVM; only oversized ones go to Python, whole, in Arrow batches.
    ``min_chars`` is the shortest piece but the last; it must exceed ``overlap`` so that every piece advances.
    """
    low = min_chars if min_chars is not None else max(overlap + 1, max_chars // 2)
    if not 0 <= overlap < low <= max_chars:
        raise ValueError("0 <= overlap < min_chars <= max_chars is needed")
    made = ["piece_index", "piece_start", "piece_end", "piece_count", "piece_text"]
    named = spared(df.select(*[F.col(f"`{c}`") for c in keep]), made)
    kept = [F.col(f"`{c}`").alias(named[c]) for c in keep]
    length = F.length(F.col(f"`{text}`"))
    small = df.where(F.coalesce(length, F.lit(0)) <= max_chars).select(
        *kept, F.lit(0).alias("piece_index"), F.lit(0).alias("piece_start"), F.coalesce(length, F.lit(0)).alias("piece_end"), F.lit(1).alias("piece_count"), F.col(f"`{text}`").alias("piece_text"),
    )
    # Whole numbers cross to Python as text: a null among them would turn them into floats there.
    whole = {named[c]: df.schema[c].dataType for c in keep if isinstance(df.schema[c].dataType, T.IntegralType)}
    schema = T.StructType([T.StructField(named[c], T.StringType() if named[c] in whole else df.schema[c].dataType) for c in keep] + [T.StructField(c, T.IntegerType()) for c in made[:4]] + [T.StructField("piece_text", T.StringType())])
    names = list(named.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["__text"].tolist()
            spans = [cuts(t, max_chars, overlap, low) for t in texts]
            rows = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
            out = batch[[f"k{i}" for i in range(len(names))]].iloc[rows].reset_index(drop=True)
            out.columns = names
            out["piece_index"] = np.concatenate([np.arange(len(s)) for s in spans]).astype("int32") if spans else []
            out["piece_start"] = [a for s in spans for a, _ in s]
            out["piece_end"] = [b for s in spans for _, b in s]
            out["piece_count"] = [len(s) for s in spans for _ in s]
            out["piece_text"] = [t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s]
            yield out

    large = df.where(length > max_chars).select(*[(F.col(f"`{c}`").cast("string") if named[c] in whole else F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("__text"))
    return small.unionByName(large.mapInPandas(run, schema).withColumns({c: F.col(f"`{c}`").cast(t) for c, t in whole.items()}))
