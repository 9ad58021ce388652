"""Texts cut off before their end.

1. Near copies: min-hash banding over runs of five words (``BANDS`` x ``ROWS``). Each text is paired with the longest text
   of each of its buckets first, which settles most, and what that leaves open with all other longer texts of its buckets, in blocks.
2. Verified pairs (at least ``CONTAINED`` of the shorter's runs are in the longer) are aligned at the shorter's
   end. Where the longer goes on inside a word or a sentence, the shorter was cut there.
3. All other texts are scored by how they close. The terminality of a word with a full stop is how often it closes a text out of how often it is written, over all
   texts. A text that closes with a sentence mark is complete unless its last word's terminality is far below the usual one though the word is written often
   (an abbreviation, a day of the month). A text that closes without one is complete if its last paragraph, whole, is of a shape
   (numbers and names replaced) that closes many texts, and stands after a complete sentence: a reference, a signature,
   a table. Marks such as an ellipsis or "read more" count as put after a cut.

Statistics cover all texts. Defined cases: null and blank texts are not cut; texts of fewer than five words have no
near copies and are scored by their closing alone; equal texts share one verdict (one of them is processed); very long texts are processed whole; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.hashing import mix, shingle_hashes
from quillstone.operators.pairs import looked_up, pairs_within
from quillstone.session import cut, fence

BANDS, ROWS, SHINGLE, CONTAINED = 16, 3, 5, 0.8
SHARE, LEAST, RARELY, OFTEN, CLOSING = 0.0002, 3, 0.1, 20, 300
# Marks that sources put after a cut, and marks that end a sentence.
CUT_MARKS = r"(?i)\s*(?:…|\.\.\.|\[\s*(?:\.\.\.|…|truncated|cut)\s*\]|\(\s*(?:more|continued|cont\.?|truncated)\s*\)|(?:read|view|see) more|continue reading|»|>>|→)(?:\s*(?:…|\.\.\.|\[\s*(?:\.\.\.|…)\s*\]|\(\s*more\s*\)|(?:read|view|see) more))*\s*$"
SENTENCE_END = r"[.!?؟۔。！？][\"'”’»)\]]*$"


def bands(texts: list[str]) -> list[np.ndarray | None]:
    """BANDS keys for each text, none for texts of fewer than SHINGLE words."""
    runs, owner = shingle_hashes(texts, SHINGLE)
    out: list[np.ndarray | None] = [None] * len(texts)
    if not len(runs):
        return out
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    factors = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        keys = np.zeros((len(first), BANDS), dtype=np.uint64)
        for k, f in enumerate(factors):
            least = np.minimum.reduceat((runs * f) >> np.uint64(16), first)
            keys[:, k // ROWS] = keys[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + mix(least)
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    for i, row in zip(owner[first], keys.view(np.int64), strict=True):
        out[i] = row
    return out


def ends_early(a: str, b: str) -> bool:
    """Whether ``b``, a longer near copy, goes on inside a word or sentence where ``a`` ends."""
    a = re.sub(CUT_MARKS, "", a.rstrip()).rstrip().rstrip("�")
    last = re.search(r"\S*$", a).group()
    body = a[: len(a) - len(last)]
    if len(body) < 30 or body[-30:] not in b:  # the shorter anchor ends the longer one
        return False
    shingles = [set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) for w in (re.findall(r"[^\W_]+", t.lower()) for t in (a, b))]
    if not shingles[0] or len(shingles[0] & shingles[1]) < CONTAINED * len(shingles[0]):
        return False
    for width in (60, 30):
        anchor = body[-width:]
        at = b.rfind(anchor) if len(anchor) == width else -1
        if at >= 0:
            on = b[at + width :]
            if not on.startswith(last):
                return False
            rest = on[len(last) :]
            if not rest.strip():
                return False
            if last and last[-1].isalnum() and rest[0].isalnum():
                return True
            if rest[0] in "\r\n" or re.match(r"\s*[\r\n]", rest):
                return False
            return not re.search(SENTENCE_END, last) or rest.lstrip()[:1].islower()
    return False


def _closing(text: Column) -> dict[str, Column]:
    """The text without white space at its end, its last CLOSING characters, which hold any mark, and its length."""
    trimmed = F.regexp_replace(text, r"[\s ]+$", "")
    return {"trimmed": trimmed, "tail": F.substr(trimmed, F.greatest(F.length(trimmed) - (CLOSING - 1), F.lit(1))), "n": F.length(trimmed)}


def paragraph_shape(paragraph: Column) -> Column:
    """The paragraph with addresses, numbers and capitalised words replaced."""
    shape = F.regexp_replace(paragraph, r"https?://\S+", "URL")
    shape = F.regexp_replace(shape, r"\d+", "9")
    shape = F.regexp_replace(shape, r"(?<![\p{L}\p{N}])\p{Lu}(?:[\p{L}\p{N}'’-]*[\p{Ll}\p{N}][\p{L}\p{N}'’-]*)?(?![\p{L}\p{N}])|(?<=[ ,])\p{Lu}{2,}(?![\p{L}\p{N}])|^\p{Lu}{5,}(?=[ ,])", "X")
    shape = F.regexp_replace(shape, r"X(?: X)+", "X")
    # A run of names is one shape: signatures come as given name, family name, place in either order.
    return F.regexp_replace(shape, r"X(?:, X)+", "X, X")


def closings(documents: DataFrame, text: str, hash_: Column) -> DataFrame:
    """Rows (h, n, mark, sentence, word, shape, after): one for each distinct text."""
    col = F.col(f"`{text}`")
    rows = documents.where(col.isNotNull()).select(hash_.alias("h"), *[c.alias(k) for k, c in _closing(col).items()])
    rows = fence(rows.where("n > 0"))
    tail = F.col("tail")
    # Only texts that close without a sentence mark need their last paragraph, whole; it starts after the last blank line.
    parted = F.regexp_replace("trimmed", r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*", "\u0001")
    rows = fence(rows.withColumns({"sentence": tail.rlike(SENTENCE_END), "parted": F.when(~tail.rlike(SENTENCE_END), parted)}))
    rows = fence(rows.withColumn("paragraph", F.substring_index("parted", "\u0001", -1)))
    before = F.regexp_replace(F.substr("parted", F.lit(1), F.length("parted") - F.length("paragraph")), r"[\s\u0001]+$", "")
    return rows.select(
        "h", "n", tail.rlike(CUT_MARKS).alias("mark"), "sentence", F.nullif(F.regexp_extract(tail, r"(?:^|[^\p{L}\p{N}])([\p{L}\p{N}]+\.)$", 1), F.lit("")).alias("word"),
        F.when(~F.col("sentence") & (F.length("paragraph") < F.length("parted")), paragraph_shape(F.col("paragraph"))).alias("shape"), F.coalesce(before.rlike(SENTENCE_END), F.lit(False)).alias("after"),
    )


def truncated(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, cut, how): every row, whether its text was cut, and what shows it (copy, mark, closing)."""
    col = F.col(f"`{text}`")
    hash_ = F.xxhash64(col, F.length(col), F.reverse(col))
    keyed = documents.select(F.col(f"`{key}`").alias("key"), F.when(col.isNotNull(), hash_).alias("h"))
    close = cut(closings(documents, text, hash_).dropDuplicates(["h"]))
    total = close.count()
    # Words before a full stop: how often they close a text, out of how often they are written.
    written = documents.where(col.isNotNull()).select(F.explode(F.regexp_extract_all(col, F.lit(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]+\.)(?=\s|$)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("all"))
    finals = close.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("closed"))
    rates = cut(written.join(finals, F.col("w") == F.col("word")).select("w", "all", "closed"))
    usual = rates.agg(F.sum("closed") / F.sum("all")).first()[0] or 0.0
    never = rates.where((F.col("all") >= OFTEN) & (F.col("closed") / F.col("all") < RARELY * usual)).select("w", F.lit(True).alias("never"))
    shapes = close.where("shape is not null and after and not shape rlike '^[X9 ]+$'").groupBy("shape").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= max(LEAST, SHARE * total)).select(F.col("shape").alias("s"), F.lit(True).alias("usual"))
    scored = close.join(never, F.col("word") == F.col("w"), "left").join(shapes, F.col("shape") == F.col("s"), "left")
    inside = F.when(F.col("sentence"), F.coalesce("never", F.lit(False))).otherwise(~(F.coalesce("usual", F.lit(False)) & F.col("after")))
    verdict = scored.select("h", F.when(F.col("mark"), F.lit("mark")).when(inside, F.lit("closing")).alias("how"))

    copies = early_copies(documents, text, hash_)
    verdict = verdict.join(copies.select("h", F.lit(True).alias("copy")), "h", "left").select("h", F.when(F.col("copy"), F.lit("copy")).otherwise(F.col("how")).alias("how"))
    return looked_up(keyed, "h", "key", verdict.where("how is not null")).select("key", F.col("how").isNotNull().alias("cut"), "how")


def early_copies(documents: DataFrame, text: str, hash_: Column) -> DataFrame:
    """Hashes of the texts that end early beside a longer near copy."""
    texts = documents.where(F.col(f"`{text}`").isNotNull()).select(hash_.alias("h"), F.col(f"`{text}`").alias("t"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch.drop_duplicates("h")
            keys = bands(kept["t"].tolist())
            out = pd.DataFrame({"h": kept["h"], "n": kept["t"].str.len().astype("int32"), "bands": keys})
            yield out[out["bands"].notna()]

    # Equal texts are reduced before the shuffle, so a text that fills a third of the rows weighs as one in its buckets.
    signed = texts.mapInPandas(sign, "h long, n int, bands array<long>").dropDuplicates(["h"])
    signed = cut(signed.select("h", "n", F.explode("bands").alias("band")))
    longest = signed.groupBy("band").agg(F.max(F.struct("n", "h")).alias("top"), F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("band", F.col("top.n").alias("m"), F.col("top.h").alias("b"))
    members = cut(looked_up(signed, "band", "h", longest).where("b is not null"))
    pairs = cut(members.where("h <> b and n < m").select(F.col("h").alias("a"), "b").distinct())
    wanted = members.select(F.col("h").alias("w")).distinct()
    kept = cut(texts.join(wanted, F.col("h") == F.col("w"), "left_semi").dropDuplicates(["h"]))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            early = [ends_early(a, b) for a, b in zip(batch["ta"], batch["tb"], strict=True)]
            yield pd.DataFrame({"h": batch["a"][early]})

    def early(some: DataFrame) -> DataFrame:
        both = some.join(kept.select(F.col("h").alias("a"), F.col("t").alias("ta")), "a").join(kept.select(F.col("h").alias("b"), F.col("t").alias("tb")), "b")
        return both.select("a", "ta", "tb").mapInPandas(align, "h long").distinct()

    found = cut(early(pairs))
    rows = members.select("band", "h", "n").join(found.select("h", F.lit(True).alias("settled")), "h", "left")
    others = pairs_within(rows, "band", "h", (F.col("a_n") < F.col("b_n")) & F.col("a_settled").isNull()).select(F.col("a_h").alias("a"), F.col("b_h").alias("b")).distinct()
    return found.unionByName(early(others.join(pairs, ["a", "b"], "left_anti")))
