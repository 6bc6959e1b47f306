"""Quality rules from tokeniser fertility: characters a token, byte-fallback share and token entropy of a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes
from .pieces import WordPieces, kept_in_worker, piece_encoder, vocabulary

#: Bands of a script: characters of words a token (least, most), most byte-fallback share, least token entropy in
#: bits, as a share of what as many tokens can have at most (at FULL_TOKENS tokens). Fixed values.
BANDS = {
    "latin": (1.6, 6.0, 0.30, 0.62),
    "cyrillic": (1.0, 6.0, 0.30, 0.55),
    "greek": (0.4, 6.0, 0.60, 0.40),
    "cjk": (0.2, 3.0, 0.95, 0.40),
    "other": (0.15, 8.0, 1.0, 0.35),
    "none": (0.8, 6.0, 0.30, 0.62),
}
FULL_TOKENS = 512
#: Lead bytes of UTF-8 that begin a letter of each script, roughly by block; all else that isn't ASCII is other.
_SCRIPT_OF_LEAD = np.full(256, -1, dtype=np.int64)
_SCRIPTS = ("latin", "greek", "cyrillic", "cjk", "other")
_SCRIPT_OF_LEAD[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 0
_SCRIPT_OF_LEAD[[0xCD, 0xCE, 0xCF]] = 1
_SCRIPT_OF_LEAD[0xD0:0xD4] = 2
_SCRIPT_OF_LEAD[0xE3:0xEE] = 3
_SCRIPT_OF_LEAD[[*range(0xD4, 0xE0), 0xE0, 0xE1]] = 4

_SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


def script_of(text: bytes) -> str:
    """The script of most letters; none without letters."""
    kinds = _SCRIPT_OF_LEAD[np.frombuffer(text, dtype=np.uint8)]
    counts = np.bincount(kinds[kinds >= 0], minlength=len(_SCRIPTS))
    return _SCRIPTS[int(counts.argmax())] if counts.any() else "none"


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    if len(numbers) < 4:
        return 0
    _, local = np.unique(numbers, return_inverse=True)
    n = int(local.max()) + 1
    pair, local = local[:-1] * n + local[1:], local
    _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * n + local[2:]
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    hit = np.zeros(len(numbers), dtype=bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def entropy(ids: np.ndarray) -> float:
    """Bits a token, of the text's own piece frequencies."""
    if not len(ids):
        return 0.0
    counts = np.unique(ids, return_counts=True)[1]
    return float(max(0.0, np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids)))


def _rate(path: str, bands: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_file=path)
        is_byte = np.array([processor.is_byte(i) for i in range(processor.vocab_size())])
        pieces = kept_in_worker(f"pieces:{path}", lambda: WordPieces(piece_encoder(path)))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [t.split() for t in texts]
            rows = [_row(t, w, n, pieces, is_byte, bands) for t, w, n in zip(texts, words, pieces.of_texts(words))]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = [batch.column("doc_id"), *(pa.array(c) for c in zip(*rows))] if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _row(text: bytes, words: list[bytes], numbers: np.ndarray, pieces: WordPieces, is_byte: np.ndarray, bands: dict) -> tuple:
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    n, repeated = len(words), repeated_words(numbers)
    failed = n < 50 or 100 * repeated > 50 * n
    ids = pieces.ids(numbers)
    script, tokens = script_of(text), len(ids)
    fertility = chars / tokens if tokens else 0.0
    bytes_share = float(is_byte[ids].mean()) if tokens else 0.0
    bits = entropy(ids)
    least, most, most_bytes, least_bits = bands[script]
    inside = least <= fertility <= most and bytes_share <= most_bytes and bits >= least_bits * np.log2(max(2, min(tokens, FULL_TOKENS)))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, bool(not failed and inside), script, tokens, fertility, bytes_share, bits


def rate_fertility(docs: DataFrame, vocabulary_path: str | None = None, bands: dict | None = None) -> DataFrame:
    """documents -> SCHEMA, one row a document: base counts, the vocabulary's measures, and the verdict.

    A document is kept if the base rules pass and the measures lie within the bands of the script of most letters.
    Texts are counted whole. Nulls: a null text counts as none (no words, so the base rules fail); null doc_ids stay.
    Repeated rows are rated each. An empty table gives none. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_batches(slim, _rate(vocabulary_path or vocabulary("piece_bpe_32k.model"), bands or BANDS), SCHEMA)


def op6_fertility_rules(spark, sf_dir: str) -> DataFrame:
    return rate_fertility(spark.read.parquet(f"{sf_dir}/documents.parquet"))
