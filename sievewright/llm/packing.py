"""Lexical retrieval packing: a window is filled with the unused documents that BM25 ranks next to its seed.

Documents are dealt into shards of a bounded number by a hash. Each shard holds an inverted index of its documents'
token ids; all terms of a seed query it, and the unused documents with the highest scores follow the seed until the
window is full. Where a document is cut, its rest is the next seed, so windows are full without padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shuffle_partitions, text_bytes, written
from .pieces import WordPieces, kept_in_worker, vocabulary, word_encoder

WINDOW = 2048
#: Documents of one shard, on average.
SHARD_DOCS = 2048
#: The id that ends every document.
END = 1
#: Terms that at least one document in so many has are summed as dense rows.
DENSE = 32
#: Neighbours that one query returns; a seed whose neighbours are used up asks again for more.
NEIGHBOURS = 16
#: Ids or words that are looked up or sorted at once, of whole documents.
RUN = 1 << 18
#: Words, and parts of words, whose ids a worker keeps: some 150 bytes each.
KEPT_WORDS = 1_000_000
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_score double"
)


def runs(sizes: list[int]) -> Iterator[slice]:
    """Neighbours that hold RUN ids or words together, or one that holds more: what numpy does at once."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > RUN:
            yield slice(first, i)
            first, held = i, 0
        held += n
    if sizes:
        yield slice(first, len(sizes))


def distinct_terms(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the distinct ids of each document, in that order; one sort serves many documents."""
    lengths, found = [len(d) for d in documents], [(np.zeros(0, dtype=np.int64),) * 3]
    for part in runs(lengths):
        ids = np.concatenate(documents[part])
        base = int(ids.max(initial=0)) + 1
        kind = np.uint32 if base * (part.stop - part.start) < 1 << 32 else np.int64
        keys = np.repeat(np.arange(part.stop - part.start, dtype=kind), lengths[part]) * kind(base) + ids.astype(kind)
        keys, counts = np.unique(keys, return_counts=True)
        doc = keys // kind(base)
        found.append((doc.astype(np.int64) + part.start, (keys - doc * kind(base)).astype(np.int64), counts))
    doc, term, count = (np.concatenate(x) for x in zip(*found))
    return doc, term, count


class Index:
    """An inverted index of documents given as arrays of ids, with BM25 weights.

    corpus: the documents, their mean length and each term's document frequency in the whole corpus; else those given.
    """

    def __init__(self, documents: list[np.ndarray], corpus: tuple[int, float, np.ndarray] | None = None):
        self.n = len(documents)
        lengths = np.fromiter(map(len, documents), np.float64, self.n)
        doc, term, tf = distinct_terms(documents)
        sizes, tf = np.bincount(doc, minlength=self.n), tf.astype(np.float64)
        df = np.bincount(term, minlength=1)
        n, mean, frequency = corpus or (self.n, lengths.mean() if self.n else 1.0, df)
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.term = term
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(df)])
        common = np.flatnonzero(df * DENSE > self.n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), dtype=np.float32)
        at = np.flatnonzero(self.row[term] >= 0)
        self.dense[self.row[term[at]], doc[at]] = weight[at]

    def query(self, document: int) -> np.ndarray:
        """All terms of a document."""
        return self.term[self.first[document] : self.first[document + 1]]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document for these terms."""
        row = self.row[terms]
        total = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float64) if (row >= 0).any() else np.zeros(self.n)
        at = [slice(self.begin[t], self.begin[t + 1]) for t in terms[row < 0]]
        if at:
            total += np.bincount(np.concatenate([self.docs[s] for s in at]), np.concatenate([self.weights[s] for s in at]), self.n)
        return total


def pack(documents: list[np.ndarray], corpus: tuple[int, float, np.ndarray] | None = None) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(document, start, length, sequence, offset, score) of every piece, in order of sequence and offset.

    A document longer than a window fills whole windows first; its rest is packed. What is left at the end goes into
    sequences of powers of two, which need no padding. score is that of the document for its window's seed.
    """
    lengths = [len(d) for d in documents]
    sequence = 0
    rest = np.zeros(len(documents), dtype=np.int64)  # where the rest of a document starts
    for i, n in enumerate(lengths):
        rest[i] = n - n % WINDOW
        for start in range(0, int(rest[i]), WINDOW):
            yield i, start, WINDOW, sequence, 0, 0.0
            sequence += 1
    free = rest < np.array(lengths, dtype=np.int64)
    # Seeds by what they have left, most first.
    order = sorted(np.flatnonzero(free).tolist(), key=lambda i: (rest[i] - lengths[i], i))
    index, upcoming, seed = Index(documents, corpus), iter(order), None
    pieces: list[tuple[int, int, int, float]] = []
    room = WINDOW
    while True:
        if seed is None:
            seed = next((i for i in upcoming if free[i]), None)
            if seed is None:
                break
        queue, score = [seed], None
        here = seed
        seed = None
        scored = {here: 0.0}
        while queue:
            i = queue.pop(0)
            take = min(room, lengths[i] - int(rest[i]))
            pieces.append((i, int(rest[i]), take, scored[i]))
            rest[i] += take
            room -= take
            free[i] = False
            if not room:
                offset = 0
                for j, start, length, s in pieces:
                    yield j, start, length, sequence, offset, s
                    offset += length
                sequence, pieces, room = sequence + 1, [], WINDOW
                if rest[i] < lengths[i]:
                    seed = i
                break
            if not queue:
                if score is None:
                    score = index.scores(index.query(here))
                masked = np.where(free, score, 0.0)
                best = np.argpartition(-masked, NEIGHBOURS)[:NEIGHBOURS] if len(masked) > NEIGHBOURS else np.arange(len(masked))
                best = best[masked[best] > 0]
                queue = best[np.lexsort((best, -masked[best]))].tolist()
                scored |= {j: float(masked[j]) for j in queue}
    # The last window isn't full: its pieces are cut into powers of two.
    left = WINDOW - room
    offset = 0
    size = 1 << (left.bit_length() - 1) if left else 0
    for j, start, length, s in pieces:
        while length:
            take = min(length, size - offset)
            yield j, start, take, sequence, offset, s
            start, length, offset, left = start + take, length - take, offset + take, left - take
            if offset == size:
                sequence, offset, size = sequence + 1, 0, 1 << (left.bit_length() - 1) if left else 0


def _encode(path: str):
    """(doc_id, shard, text) -> (shard, doc_id, ids): 16 bits an id where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(f"words:{path}", lambda: WordPieces(word_encoder(path, KEPT_WORDS), KEPT_WORDS))
        for batch in batches:
            words = [t.split() for t in batch.column("text").to_pylist()]
            sizes = [len(w) for w in words]
            numbers = pieces.numbers(chain.from_iterable(words), sum(sizes))
            ends, data, offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), [], [np.zeros(1, dtype=np.int64)]
            for part in runs(sizes):
                first = ends[part.start]
                ids, count = pieces.known.take(numbers[first : ends[part.stop]])
                data.append(ids.astype("<u2").tobytes())
                upto = np.concatenate([[0], np.cumsum(count)])
                offsets.append(offsets[-1][-1] + 2 * upto[ends[part.start + 1 : part.stop + 1] - first])
            offsets = pa.array(np.concatenate(offsets), pa.int32())  # more than fits is an error
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, offsets.buffers()[1], pa.py_buffer(b"".join(data))])
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), ids], names=["shard", "doc_id", "ids"])

    return run


def _packed(shard: int, rows: list[tuple[int | None, bytes]], corpus: tuple[int, float, np.ndarray]) -> pa.RecordBatch:
    documents = [np.append(np.frombuffer(ids, dtype="<u2"), np.uint16(END)) for _, ids in rows]
    out = []
    for i, start, length, sequence, offset, score in pack(documents, corpus):
        crc = zlib.crc32(documents[i][start : start + length].astype("<u4").tobytes())
        out.append((rows[i][0], start, length, crc, len(documents[i]), (shard << 32) | sequence, offset, score))
    kinds = [*[pa.int64()] * 7, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids -> (term, n): document frequencies; documents as term -1 and their ids as -2."""
    df, documents, tokens = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for batch in batches:
        own = [np.append(np.frombuffer(ids, dtype="<u2"), np.uint16(END)) for ids in batch.column("ids").to_pylist()]
        df += np.bincount(distinct_terms(own)[1], minlength=len(df))
        documents, tokens = documents + len(own), tokens + sum(map(len, own))
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [documents, tokens]))], names=["term", "n"])


def corpus_counts(encoded: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, mean length and document frequencies of the whole corpus: a row a term comes to the driver."""
    rows = map_batches(encoded.select("ids"), _count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    documents, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(1 << 16, dtype=np.int64)
    df[list(counts)] = list(counts.values())
    return documents, tokens / max(1, documents), df


def _pack_shards(shared):
    """Rows in order of shard: one shard at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))):
                if s != shard:
                    if rows:
                        yield _packed(shard, rows, shared.value)
                    shard, rows = s, []
                rows.append((doc_id, ids))
        if rows:
            yield _packed(shard, rows, shared.value)

    return run


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """documents -> SCHEMA, one row a piece; every id of every document is in exactly one piece.

    Nulls: a null text is empty and has the end id only; null doc_ids are packed like others. Repeated rows are packed
    each. A very long text fills windows of its own. An empty table gives none. Other columns are not read.
    """
    parts = shuffle_partitions(docs.sparkSession)
    shards = max(1, -(-docs.count() // shard_docs))
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    slim = docs.select(shard.alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    encoded = map_batches(slim, _encode(vocabulary_path or vocabulary("word_bpe_49k.json")), "shard int, doc_id long, ids binary")
    encoded = written(encoded, "encoded")
    shared = docs.sparkSession.sparkContext.broadcast(corpus_counts(encoded))
    laid = encoded.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return map_batches(laid, _pack_shards(shared), SCHEMA)


def op3_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
