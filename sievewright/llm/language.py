"""Language identification by unigram models over one fixed public vocabulary, with the segmentation summed out.

Each language has a probability for every piece. A word's probability is the sum over all ways to cut it into
pieces, by the forward algorithm; the probabilities are learnt by expectation-maximisation over the same lattice.
No cut crosses white space, so a text's score is the sum of its words' scores and each word is scored once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, text_bytes
from .pieces import vocabulary

#: Words of up to so many characters are scored many at a time, as their products stay in a double's range; longer ones one by
#: one, with the products scaled as they shrink. The models are fitted to the parts of that length of longer words.
WORD_CHARS = 32
#: Probability of a character that no piece has; the same in every language.
UNKNOWN = 1e-7
#: Training documents of one language, on average: the bounded sample that the models are fitted to.
SAMPLE_DOCS = 300
#: Characters of a document in that sample, at most: so the sample is bounded in bytes too.
SAMPLE_CHARS = 100_000
ROUNDS = 3
#: A text is unlike its language if its words are less probable than the training's by so much, in nats a character, and
#: by SLACK nats besides, so that a few characters don't decide.
MARGIN = 2.2
SLACK = 10.0
#: Words of which scores are kept.
CACHE_WORDS = 300_000
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """The pieces of a vocabulary, found in many words of equal length at a time."""

    def __init__(self, pieces: Iterable[str]):
        known = sorted({p for p in pieces if p})
        self.size = len(known) + 1  # the last is the unknown character
        keys = np.array([self._key(p) for p in known], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.longest = max(map(len, known), default=1)

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for c in piece:
            key = ((key ^ ord(c)) * int(_BASE) + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def spans(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece ids of every span (begin, end) that is a piece in some word; -1 where it is none."""
        found, n = {}, codes.shape[1]
        for begin in range(n):
            key = np.zeros(len(codes), dtype=np.uint64)
            for end in range(begin + 1, min(n, begin + self.longest) + 1):
                key = (key ^ codes[:, end - 1]) * _BASE + np.uint64(1)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ids = np.where(self.keys[at] == key, self.ids[at], -1) if len(self.keys) else np.full(len(codes), -1)
                if end == begin + 1:
                    ids = np.where(ids < 0, self.size - 1, ids)
                if (ids >= 0).any():
                    found[begin, end] = ids
        return found


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as a matrix of code points, with their places in the list; at most 4096 at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, -(-len(at) // 4096)):
            text = "".join([words[i] for i in part])
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), n).astype(np.uint64)


def forward(spans: dict, n: int, p: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: words x languages, the probability of the first j characters over all segmentations."""
    words = len(next(iter(spans.values())))
    alpha = [np.zeros((words, p.shape[1])) for _ in range(n + 1)]
    alpha[0][:] = 1.0
    for (begin, end), ids in sorted(spans.items(), key=lambda x: x[0][1]):
        alpha[end] += alpha[begin] * np.where((ids >= 0)[:, None], p[ids], 0.0)
    return alpha


def word_parts(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked words, long ones in parts, and for each part its word's place."""
    parts, owner = [], []
    for i, w in enumerate(words):
        w = MARK + w
        for at in range(0, len(w), WORD_CHARS):
            parts.append(w[at : at + WORD_CHARS])
            owner.append(i)
    return parts, np.array(owner, dtype=np.int64)


def log_score(word: str, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log probability of one word in every language, over all segmentations of the whole word, however long it is."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    ids = np.full((lattice.longest, n + 1), -1, dtype=np.int64)  # of the piece of size + 1 characters that ends before a place
    key = np.zeros(n, dtype=np.uint64)
    for size in range(min(lattice.longest, n)):
        key = (key[: n - size] ^ codes[size:]) * _BASE + np.uint64(1)
        at = np.minimum(np.searchsorted(lattice.keys, key), len(lattice.keys) - 1)
        found = np.where(lattice.keys[at] == key, lattice.ids[at], -1) if len(lattice.keys) else np.full(len(key), -1)
        ids[size, size + 1 :] = np.where(found < 0, lattice.size - 1, found) if size == 0 else found
    alpha, scale = np.zeros((lattice.longest, p.shape[1])), np.zeros(p.shape[1])  # alpha[k]: of the place k + 1 before
    alpha[0] = 1.0
    for end in range(1, n + 1):
        own = ids[:, end]
        here = (alpha * np.where((own >= 0)[:, None], p[own], 0.0)).sum(axis=0)
        alpha[1:] = alpha[:-1]
        alpha[0] = here
        if end % 16 == 0 or end == n:
            top = alpha.max(axis=0)
            alpha, scale = alpha / top, scale + np.log(top)
    return np.log(alpha[0]) + scale


def log_scores(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """words x languages: log probability of each marked word, over all its segmentations."""
    marked = [MARK + w for w in words]
    short = [i for i, w in enumerate(marked) if len(w) <= WORD_CHARS]
    out = np.empty((len(words), p.shape[1]))
    for at, codes in by_length([marked[i] for i in short]):
        out[np.array(short)[at]] = np.log(forward(lattice.spans(codes), codes.shape[1], p)[-1])
    for i, w in enumerate(marked):
        if len(w) > WORD_CHARS:
            out[i] = log_score(w, lattice, p)
    return out


def fit(words: list[str], counts: np.ndarray, lattice: Lattice) -> np.ndarray:
    """pieces x languages: probabilities by expectation-maximisation; counts: words x languages."""
    languages = counts.shape[1]
    p = np.full((lattice.size, languages), 1.0 / lattice.size)
    parts, owner = word_parts(words)
    for _ in range(ROUNDS):
        expected = np.full((lattice.size, languages), 0.01)
        for at, codes in by_length(parts):
            spans, n = lattice.spans(codes), codes.shape[1]
            alpha = forward(spans, n, p)
            beta = [np.zeros_like(alpha[0]) for _ in range(n + 1)]
            beta[n][:] = 1.0
            weight = counts[owner[at]] / alpha[n]
            for (begin, end), ids in sorted(spans.items(), key=lambda x: -x[0][0]):
                here = np.where((ids >= 0)[:, None], p[ids], 0.0) * beta[end]
                beta[begin] += here
                for k in range(languages):
                    expected[:, k] += np.bincount(np.maximum(ids, 0), here[:, k] * alpha[begin][:, k] * weight[:, k], lattice.size)
        p = expected / expected.sum(axis=0)
        p[-1] = UNKNOWN
    return p


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_list(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().split()


def plain_sizes(words: list[str]) -> np.ndarray:
    """Characters of each word with its mark; 0 for words with digits (numbers, addresses, codes), which have no language."""
    return np.array([0 if any(map(str.isdigit, w)) else len(w) + 1 for w in words], dtype=np.float64)


def vocabulary_pieces(path: str) -> list[str]:
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    return [processor.id_to_piece(i).lower() for i in range(processor.vocab_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]


def fit_languages(training: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, their piece probabilities and usual log probability a character, from a sample of training (text, lang, doc_id).

    About sample_docs documents of every language, by a hash of doc_id and text, with SAMPLE_CHARS characters of each at
    most: that is what comes to the driver. Every language that a training row names is learnt.
    """
    labelled = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    lattice = Lattice(pieces)
    if not languages:
        return [], np.zeros((lattice.size, 0)), np.zeros(0)
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, sample_docs / totals[lang]) * 1_000_000) + 1)])[F.col("lang")]
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < part)
    rows = sample.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    place = {lang: k for k, lang in enumerate(languages)}
    index: dict[str, int] = {}
    pairs = np.array([(index.setdefault(w, len(index)), place[r["lang"]]) for r in rows for w in r["text"].lower().split()], dtype=np.int64).reshape(-1, 2)
    counts = np.zeros((len(index), len(languages)))
    np.add.at(counts, (pairs[:, 0], pairs[:, 1]), 1.0)
    words = list(index)
    p = fit(words, counts, lattice)
    sizes = plain_sizes(words)
    plain = counts * (sizes > 0)[:, None]
    usual = (plain * log_scores(words, lattice, p)).sum(axis=0) / np.maximum(1.0, (plain * sizes[:, None]).sum(axis=0))
    return languages, p, usual


def _identify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, p, usual = shared.value
        lattice, index, scores, sizes = Lattice(pieces), {}, np.zeros((0, len(languages))), np.zeros(0)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column("_bytes").to_pylist()]
            words = [t.lower().split() for t in texts]
            new = set().union(*words).difference(index.keys())
            if len(index) + len(new) > CACHE_WORDS:
                index, scores, sizes, new = {}, scores[:0], sizes[:0], set().union(*words)
            if new and languages:
                fresh = list(new)
                index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
                scores = np.concatenate([scores, log_scores(fresh, lattice, p)])
                sizes = np.concatenate([sizes, plain_sizes(fresh)])
            said, sure, likely = [], [], []
            for text, ws in zip(texts, words):
                if not languages or not any(map(str.isalpha, text)):
                    said.append("und")
                    sure.append(0.0)
                    likely.append(not languages)
                    continue
                at = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
                total = scores[at].sum(axis=0)
                k = int(total.argmax())
                said.append(languages[k])
                sure.append(float(1.0 / np.exp(np.minimum(total - total[k], 0.0)).sum()))
                size = sizes[at]
                # Words with digits count only if there are no others.
                reached, size = (scores[at[size > 0], k].sum(), size.sum()) if size.any() else (total[k], sum(map(len, ws)) + len(ws))
                likely.append(bool(reached >= (usual[k] - MARGIN) * size - SLACK))
            names = [n for n in batch.schema.names if n != "_bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(likely, pa.bool_())], names=[*names, "lang_pred", "score", "likely"])

    return run


def identify_languages(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary_path: str | None = None) -> DataFrame:
    """docs -> the columns named in keep, lang_pred, score, likely.

    The models are fitted to training; nothing but the text of docs enters a prediction. score is the posterior of
    the language given the whole text, with equal priors. likely is false for und, and where the text is far less probable
    a character than the training texts of lang_pred: junk, or a language that isn't learnt.
    Nulls: a null text, and one without a letter, is und with score 0; training rows without text or language don't
    count. Ties go to the first language by code point. Very long texts and words are scored whole; a text must fit in a worker's
    memory some ten times. With no language learnt all is und, and likely, as nothing can be told. Repeated rows are predicted each; equal texts get equal predictions. An
    empty table gives none. Columns not in keep are not read.
    """
    pieces = vocabulary_pieces(vocabulary_path or vocabulary("piece_bpe_32k.model"))
    languages, p, usual = fit_languages(training, pieces)
    shared = docs.sparkSession.sparkContext.broadcast((languages, pieces, p, usual))
    slim = docs.select(*keep, text_bytes().alias("_bytes"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("likely", T.BooleanType())])
    return map_batches(slim, _identify(shared), schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify_languages(docs, docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
