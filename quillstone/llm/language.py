"""Language of each text and of each of its segments, with a confidence.

The model is one unigram distribution over the pieces of a fixed public vocabulary for each language. The
probability of a word is the sum over all of its segmentations into pieces, computed by a forward pass over the word's lattice;
pieces never cross white space, so a text's score is the sum over its words. Training is expectation-maximisation
on the same lattice over labelled texts, then once more with the labels the first model corrects.

A word of a language is one of the words learned of it, or, as often as new texts bring unseen words, spelt from pieces.
One more distribution, ``OTHER``, is fitted on capitalised words inside sentences and has no learned words: names, and words made like them, are no language.

A text is cut into sentences and lines; a hidden chain over them with a small chance of switching gives each one a
posterior for every language and for ``OTHER``. Neighbours of one kind form a segment. A segment is attested if its posterior is at least ``SURE``, one of its sentences closes
with a sentence mark, and of its words that are no names at least half as many are learned words of the language as in any new text of it. A language counts as
written in a text if it is the text's main one or one of its segments is attested: page headers, lists of names and made-up words are no mixture. Capitalised words inside a sentence weigh little, and one word can favour a
language only so far, so that names do not turn a text into another language.

``TRAIN_TEXTS`` bounds the labelled texts the model is fitted on, ``TRAIN_CHARS`` the length of each (longer ones are not picked); scoring covers all texts, whole. Defined cases:
null, empty and letterless texts get no segments and a null language, texts of names alone a null language; a run of letters above 64 characters is scored in
blocks of 64; ties go to the first language in the list; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANGUAGES = ("en", "fr", "es", "de", "bs", "tr", "sw", "ar")
# Usual codes and names.
NAMES = {
    "en": "en eng english anglais englisch inglés", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano", "de": "de deu ger german deutsch",
    "bs": "bs bos bosnian bosanski hr hrv sr srp hbs sh", "tr": "tr tur turkish türkçe turkce", "sw": "sw swa swh swahili kiswahili", "ar": "ar ara arb arabic العربية",
}
TRAIN_TEXTS, ROUNDS, BACKOFF, STAY, WORD_LIMIT, NAME_WEIGHT = 4_000, 3, 200.0, 0.97, 4.0, 0.25
UNKNOWN, BLOCK, TRAIN_CHARS = 1e-7, 64, 20_000
SCALE, PARTS, FORMS = 1000.0, 50_000, 400_000
OTHER, SURE, LEARNED, UNSEEN, COMMON = "und", 0.95, 0.5, 0.02, 0.01
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLOSED = re.compile("[.!?؟۔…][\"'”’»)\\]]*\\s*$")
SENTENCE = re.compile(r"[^\r\n]+?(?:[.!?؟۔…]+[\"'”’»)\]]*(?=\s)|(?=[\r\n])|$)")


def label_language(label: Column) -> Column:
    """The language a label names in any usual code or name; null where it names none of them."""
    head = F.lower(F.regexp_replace(F.regexp_replace(label, r"^\s+|\s+$", ""), r"[-_ (].*$", ""))
    return F.try_element_at(F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)]), head)


def public_pieces(path: str | None = None) -> dict[str, int]:
    """Lower-case pieces of the public vocabulary, numbered."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: i for i, p in enumerate(p for p in pieces if p == p.lower())}


class Lattice:
    """Sums over all segmentations of words into pieces, for many words and all languages at once.

    Words of one length are taken together: a table has the piece, if any, of each word at each span, and the sums run over the positions.
    """

    def __init__(self, pieces: dict[str, int], words: list[str]) -> None:
        self.words, self.size = words, len(pieces)
        get, longest = pieces.get, max(map(len, pieces))
        unknown, nothing = self.size, self.size + 1
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        self.groups = []
        for n, rows in by_length.items():
            mine = [words[i] for i in rows]
            spans = []
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    ids = np.array([get(w[i:j], nothing) for w in mine], dtype=np.int32)
                    if j == i + 1:
                        ids[ids == nothing] = unknown
                    some = np.flatnonzero(ids != nothing)
                    if len(some):
                        spans.append((i, j, some, ids[some]))
            self.groups.append((n, np.array(rows), spans))

    def _grown(self, p: np.ndarray) -> np.ndarray:
        return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN)])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word by language (words x languages)."""
        p, out = self._grown(p), np.zeros((len(self.words), p.shape[1]))
        for n, rows, spans in self.groups:
            alpha = self._alpha(n, len(rows), spans, p)
            out[rows] = np.log(alpha[n]) - n * np.log(SCALE)
        return out

    @staticmethod
    def _alpha(n: int, rows: int, spans: list, p: np.ndarray) -> np.ndarray:
        # Each character is worth SCALE more, so that neither rare nor frequent pieces leave the range of numbers.
        alpha = np.zeros((n + 1, rows, p.shape[1]))
        alpha[0] = 1.0
        for i, j, some, ids in spans:
            alpha[j, some] += alpha[i, some] * p[ids] * SCALE ** (j - i)
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, where each word is seen ``counts`` times (words x languages)."""
        p, out = self._grown(p), np.zeros((self.size + 1, p.shape[1]))
        for n, rows, spans in self.groups:
            alpha = self._alpha(n, len(rows), spans, p)
            beta = np.zeros_like(alpha)
            beta[n] = counts[rows] / alpha[n]
            pieces, uses = [], []
            for i, j, some, ids in sorted(spans, key=lambda x: -x[0]):
                onward = p[ids] * SCALE ** (j - i) * beta[j, some]
                beta[i, some] += onward
                pieces.append(ids), uses.append(alpha[i, some] * onward)
            pieces, uses = np.concatenate(pieces), np.concatenate(uses)
            order = np.argsort(pieces, kind="stable")
            pieces = pieces[order]
            first = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1]))
            out[pieces[first]] += np.add.reduceat(uses[order], first, axis=0)
        return out[:-1]


def em(lattice: Lattice, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by language from word counts (words x languages)."""
    p = np.full((lattice.size, counts.shape[1]), 1.0 / lattice.size)
    for _ in range(rounds):
        expected = lattice.expected(p, counts)
        pooled = expected.sum(axis=1, keepdims=True) + 0.01
        p = expected + BACKOFF * pooled / pooled.sum()
        p = p / p.sum(axis=0, keepdims=True)
    return p


def spelt(words: list[str], pieces: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Log probability of each word from its pieces (words x languages). Long runs of letters are taken in blocks."""
    parts, owner = [], []
    for i, w in enumerate(words):
        for at in range(0, len(w), BLOCK):
            parts.append(("▁" if at == 0 else "") + w[at : at + BLOCK])
            owner.append(i)
    total = np.zeros((len(words), p.shape[1]))
    for a in range(0, len(parts), PARTS):
        np.add.at(total, owner[a : a + PARTS], Lattice(pieces, parts[a : a + PARTS]).forward(p))
    return total


def bounded(scores: np.ndarray) -> np.ndarray:
    """Scores relative to the best, no lower than WORD_LIMIT under it."""
    return np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_LIMIT)


@dataclass
class Model:
    """Piece probabilities (pieces x languages), chance of an unseen word by language, and learned words with their chances (words x languages)."""

    p: np.ndarray
    unseen: np.ndarray
    words: dict[str, int]
    chances: np.ndarray

    @property
    def shape(self) -> tuple[int, ...]:
        return self.p.shape

    def scores(self, words: list[str], pieces: dict[str, int]) -> np.ndarray:
        out = spelt(words, pieces, self.p) + np.log(self.unseen)
        at = np.array([self.words.get(w, -1) for w in words], dtype=np.int64)
        known = np.flatnonzero(at >= 0)
        with np.errstate(divide="ignore"):
            out[known] = np.logaddexp(out[known], np.log(self.chances[at[known]]))
        return bounded(out)

    def learned(self, words: list[str]) -> np.ndarray:
        """Which words are learned words of which language (words x languages)."""
        known = np.vstack([self.chances > 0, np.zeros((1, self.p.shape[1]), dtype=bool)])
        return known[np.array([self.words.get(w, -1) for w in words], dtype=np.int64)]


class Numbers(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores of the words met so far, and weights by how they are written."""

    def __init__(self, pieces: dict[str, int], model: Model) -> None:
        self.pieces, self.model = pieces, model
        self.forms, self.scores, self.capital = Numbers(), np.zeros((0, model.shape[1])), np.zeros(0, dtype=bool)
        self.learned = np.zeros((0, model.shape[1]), dtype=bool)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the words (words x languages), which are learned in which language, and which are capitalised."""
        if len(self.forms) > FORMS:  # bounds the worker's memory; a forgotten word is scored again
            self.__init__(self.pieces, self.model)
        ids = np.fromiter(map(self.forms.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(self.forms)[len(self.scores) :]
        if new:
            self.scores = np.vstack([self.scores, self.model.scores([w.lower() for w in new], self.pieces)])
            self.learned = np.vstack([self.learned, self.model.learned([w.lower() for w in new])])
            self.capital = np.append(self.capital, [_named(w) for w in new])
        return self.scores[ids], self.learned[ids], self.capital[ids]


def sentences(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in SENTENCE.finditer(text) if m.group().strip()]


def chain(emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Posterior of each sentence (sentences x languages) under a chain that rarely switches; ``sizes`` are sentences by text."""
    width = emit.shape[1]
    stay, move = STAY, (1 - STAY) / (width - 1)

    def step(row: np.ndarray) -> np.ndarray:
        top = row.max(axis=1, keepdims=True)
        every = np.exp(row - top)
        return top + np.log(every * (stay - move) + every.sum(axis=1, keepdims=True) * move)

    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = begins[order], sizes[order]
    left, right = np.zeros_like(emit), np.zeros_like(emit)
    for i in range(1, int(lengths[0]) if len(lengths) else 0):  # all texts with a sentence at this place at once
        at = begins[: np.searchsorted(-lengths, -i, side="left")] + i
        left[at] = step(left[at - 1] + emit[at - 1])
        back = (begins + lengths)[: len(at)] - 1 - i
        right[back] = step(right[back + 1] + emit[back + 1])
    joint = left + emit + right
    joint = np.exp(joint - joint.max(axis=1, keepdims=True))
    return joint / joint.sum(axis=1, keepdims=True)


def _named(word: str) -> bool:
    return not word.islower() and word[0] != word[0].lower()


def worded(texts: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, and of each sentence with words: how many it has, its text and its span."""
    words, counts, spans, owner = [], [], [], []
    for i, text in enumerate(texts):
        if isinstance(text, str):
            for a, b in sentences(text):
                found = WORD.findall(text, a, b)
                if found:
                    words += found
                    counts.append(len(found)), spans.append((a, b)), owner.append(i)
    return words, np.array(counts, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(spans, dtype=np.int64).reshape(-1, 2)


def segments(texts: list, scorer: Scorer) -> list[list[tuple[int, int, int, float, int, bool]]]:
    """For each text its runs of one language: start, end, language number, confidence, words, attested."""
    words, counts, owner, spans = worded(texts)
    out: list[list] = [[] for _ in texts]
    if not len(spans):
        return out
    scores, learned, capital = scorer(words)
    first = np.cumsum(counts) - counts
    capital[first] = False
    weight = np.where(capital, NAME_WEIGHT, 1.0)
    emit = np.add.reduceat(scores * weight[:, None], first, axis=0)
    post = chain(emit, np.bincount(owner, minlength=len(texts))[np.unique(owner)])
    best = post.argmax(axis=1)
    begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])))
    end = np.append(begin[1:], len(owner)) - 1
    size = np.add.reduceat(counts, begin)
    sure = np.add.reduceat(post[np.arange(len(best)), best] * counts, begin) / size
    plain = np.add.reduceat(np.add.reduceat((~capital).astype(np.int64), first), begin)
    own = np.add.reduceat(np.add.reduceat((learned & ~capital[:, None]).astype(np.int64), first, axis=0), begin, axis=0)[np.arange(len(begin)), best[begin]]
    closed = np.array([CLOSED.search(texts[i], a, b) is not None for i, (a, b) in zip(owner.tolist(), spans.tolist(), strict=True)])
    attested = (sure >= SURE) & np.logical_or.reduceat(closed, begin) & (own >= LEARNED * (1 - scorer.model.unseen)[best[begin]] * plain)
    rows = zip(owner[begin].tolist(), spans[begin, 0].tolist(), spans[end, 1].tolist(), best[begin].tolist(), sure.tolist(), size.tolist(), attested.tolist(), strict=True)
    for i, *row in rows:
        out[i].append(tuple(row))
    return out


def train(labelled: DataFrame, text: str, language: str, languages: tuple[str, ...] = LANGUAGES, vocabulary: str | None = None, max_texts: int = TRAIN_TEXTS) -> Model:
    """Fit the model on at most ``max_texts`` different labelled texts, as many of each language, chosen by hash.

    The sample is bounded, so it is fitted in one task; what comes back is one row for each piece of the vocabulary and for each word the sample has in two texts of a language.
    """
    number = {code: i for i, code in enumerate(languages)}
    sample = labelled.where(F.col(language).isin(list(languages)) & (F.length(F.col(text)) <= TRAIN_CHARS)).select(F.col(text).alias("t"), F.col(language).alias("l")).distinct()
    turn = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    sample = sample.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max(1, max_texts // len(languages))).select("t", "l", F.lit(1).alias("one"))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["l", "t"], ignore_index=True)
        pieces, numbers, width = public_pieces(vocabulary), Numbers(), len(languages) + 1
        surface, sizes, owner, _ = worded(batch["t"].tolist())
        flat, owner = np.array([numbers[w.lower()] for w in surface], dtype=np.int64), np.repeat(owner, sizes)
        inside = np.ones(len(surface), dtype=bool)
        inside[np.cumsum(sizes) - sizes] = False
        named = inside & np.array([_named(w) for w in surface], dtype=bool)
        labels = batch["l"].map(number).to_numpy().copy()
        words, long = list(numbers), np.bincount(owner, minlength=len(batch))
        kept = np.flatnonzero(np.bincount(flat, minlength=len(words)) >= 2)
        lattice = Lattice(pieces, ["▁" + words[i][:BLOCK] for i in kept])
        model = np.full((len(pieces), width), 1.0 / len(pieces))
        # Plain words by text, each once; a word is learned if it is in enough texts of a language, so that lists of made-up words teach nothing.
        seen = np.unique(np.stack([flat[~named], owner[~named]]), axis=1) if len(flat) else np.zeros((2, 0), dtype=np.int64)
        for _ in range(2):
            texts = np.bincount(seen[0] * width + labels[seen[1]], minlength=len(words) * width).reshape(-1, width).astype(np.float64)
            enough = texts >= np.maximum(2, np.ceil(COMMON * np.bincount(labels, minlength=width)))
            kind = np.where(named, width - 1, labels[owner])
            use = named | enough[flat, kind]
            counts = np.bincount((flat * width + kind)[use], minlength=len(words) * width).reshape(-1, width).astype(np.float64)
            if len(kept):
                model = em(lattice, counts[kept])
            # Correct the labels of texts the model is sure about, then fit again.
            scores = bounded(spelt(words, pieces, model))
            total = np.stack([np.bincount(owner, weights=scores[flat, k], minlength=len(batch)) for k in range(len(languages))], axis=1)
            wrong = (long >= 8) & (total.max(axis=1) - total[np.arange(len(batch)), labels] > 20)
            labels[wrong] = total.argmax(axis=1)[wrong]
        texts = np.bincount(seen[0] * width + labels[seen[1]], minlength=len(words) * width).reshape(-1, width).astype(np.float64)
        texts[texts < np.maximum(2, np.ceil(COMMON * np.bincount(labels, minlength=width)))] = 0
        # How often a text brings words that are not learned: the median over the texts.
        alone = np.bincount(seen[1], weights=texts[seen[0], labels[seen[1]]] == 0, minlength=len(batch)) / np.maximum(np.bincount(seen[1], minlength=len(batch)), 1)
        unseen = np.array([np.median(alone[labels == k]) if (labels == k).sum() > 1 else 1.0 for k in range(width)]).clip(UNSEEN, 1.0)
        learned = np.flatnonzero(texts.any(axis=1))
        chances = texts[learned] / np.maximum(texts.sum(axis=0), 1.0) * (1 - unseen)
        values = [*model, unseen, *chances]
        return pd.DataFrame({"kind": ["piece"] * len(model) + ["unseen"] + ["word"] * len(learned), "row": [*range(len(model)), 0, *range(len(learned))], "word": [None] * (len(model) + 1) + [words[i] for i in learned], "p": values})

    rows = sample.groupBy("one").applyInPandas(run, "kind string, row int, word string, p array<double>").collect()
    width = len(languages) + 1
    if not rows:
        size = len(public_pieces(vocabulary))
        return Model(np.full((size, width), 1.0 / size), np.ones(width), {}, np.zeros((0, width)))
    part = lambda kind: sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["row"])
    learned = part("word")
    return Model(np.array([r["p"] for r in part("piece")]), np.array(part("unseen")[0]["p"]), {r["word"]: i for i, r in enumerate(learned)}, np.array([r["p"] for r in learned]).reshape(-1, width))


def identify(df: DataFrame, key: str, text: str, model: Model, languages: tuple[str, ...] = LANGUAGES, vocabulary: str | None = None) -> DataFrame:
    """Rows (key, language, confidence, segments): the main language by words of attested segments, and every segment."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the sample
    codes = [*languages, OTHER]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(public_pieces(vocabulary), shared.value)
        for batch in batches:
            mains, sure, all_segments = [], [], []
            for found in segments(batch["t"].tolist(), scorer):
                words, weight = [0] * len(codes), [0.0] * len(codes)
                # Attested segments name the main language; where there are none, all do.
                for _, _, k, c, n, _ in [x for x in found if x[5]] or found:
                    words[k] += n
                    weight[k] += c * n
                main = words.index(max(words[:-1])) if any(words[:-1]) else None
                mains.append(codes[main] if main is not None else None)
                sure.append(weight[main] / words[main] if main is not None else None)
                all_segments.append([{"start": a, "end": b, "language": codes[k], "confidence": c, "words": n, "attested": sure_} for a, b, k, c, n, sure_ in found])
            yield pd.DataFrame({"key": batch["key"], "language": mains, "confidence": sure, "segments": all_segments})

    schema = "key string, language string, confidence double, segments array<struct<start:int,end:int,language:string,confidence:double,words:int,attested:boolean>>"
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("t")).mapInPandas(run, schema)
    return rows.withColumn("key", F.col("key").cast(df.schema[key].dataType))
