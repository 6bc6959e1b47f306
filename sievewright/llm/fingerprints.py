"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every length, the polynomial hash of the code points so far, modulo two primes.
From it any two spans are compared at the cost of a few products, and the longest common extension of two places is
found by binary search. A fingerprint samples the spans of one width: their hashes are read off the array, the least
ones are kept, and two fingerprints are alike as their samples are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shuffle_partitions, text_bytes

#: Two primes below 2**31, so that products of residues fit 64 bits; bases below them. Fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Scales: width of the sampled spans, and from what length on and up to what length a text has a sample of them, all
#: in code points. An edited text is at least half as long as its own, so the two always have a scale in common.
SCALES = ((24, 256, None), (6, 24, 512), (2, 0, 48))
#: How many hashes a sample holds.
SAMPLE = 64


class Powers:
    """Powers of the bases and of their inverses, as far as they were needed."""

    def __init__(self):
        self.size = 0
        self.grow(1 << 12)

    def grow(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = 1 << (size - 1).bit_length()
        self.up = [self._powers(b, p) for b, p in zip(BASES, PRIMES)]
        self.down = [self._powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]

    def _powers(self, base: int, prime: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < self.size:  # doubled each time
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        return out


POWERS: list[Powers] = []


def powers(size: int) -> Powers:
    if not POWERS:
        POWERS.append(Powers())
    POWERS[0].grow(size)
    return POWERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHashes:
    """Prefix arrays of a text: at i the sum of (code point + 1) * base**k over its first i places k, by each prime."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.powers = powers(self.n + 1)
        c = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up, prime in zip(self.powers.up, PRIMES):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(c * up[: self.n] % np.uint64(prime), out=sums[1:])  # exact: below 2**31 * n
            sums %= np.uint64(prime)
            self.sums.append(sums)

    def span(self, begin, end) -> tuple[np.ndarray, ...]:
        """Hashes of spans, the same wherever the span stands; begin and end may be arrays."""
        out = []
        for sums, down, prime in zip(self.sums, self.powers.down, PRIMES):
            p = np.uint64(prime)
            out.append((sums[end] + p - sums[begin]) % p * down[begin] % p)
        return tuple(out)

    def equal(self, begin: int, other: PrefixHashes, there: int, length: int) -> bool:
        return begin + length <= self.n and there + length <= other.n and self.span(begin, begin + length) == other.span(there, there + length)

    def common_extension(self, begin: int, other: PrefixHashes, there: int) -> int:
        """How far the two texts agree from these places on."""
        low, high = 0, min(self.n - begin, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(begin, other, there, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    x = ((low << np.uint64(32)) ^ high) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(32)).astype(np.uint32)


def sample(hashes: PrefixHashes, width: int) -> str:
    """The least hashes of all spans of this width, in hex; a shorter text is one span."""
    width = min(width, hashes.n)
    if not width:
        return ""
    begin = np.arange(hashes.n - width + 1)
    mixed = _mixed(*hashes.span(begin, begin + width))
    least = np.unique(np.partition(mixed, 4 * SAMPLE)[: 4 * SAMPLE] if len(mixed) > 8 * SAMPLE else mixed)
    if len(least) < SAMPLE:  # a text of few spans, again and again
        least = np.unique(mixed)
    return "".join(f"{x:08x}" for x in least[:SAMPLE].tolist())


def fingerprint(hashes: PrefixHashes) -> str:
    """Length and hash of the whole text, then a sample at each scale, coarse to fine."""
    n, (low, high) = hashes.n, hashes.span(0, hashes.n)
    samples = (sample(hashes, width) if n >= least and (most is None or n < most) else "" for width, least, most in SCALES)
    return ".".join([f"{n:x}", f"{int(low):08x}{int(high):08x}", *samples])


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1, at the coarsest scale that both have: of the least span hashes of both texts
    together, the share that each text has."""
    if a == b:
        return 1.0
    for x, y in zip(a.split(".")[2:], b.split(".")[2:]):
        if x and y:
            x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
            least = sorted(x | y)[:SAMPLE]
            return sum(h in x and h in y for h in least) / len(least)
    return 0.0


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last half of the text, rounded down, replaced by as much of the following text as there is."""
    half = len(codes) // 2
    return np.concatenate([codes[: len(codes) - half], following[:half]])


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "common_prefix long"
)


def _row(doc_id, codes: np.ndarray, own: PrefixHashes, print_: str, next_codes: np.ndarray, next_print: str) -> tuple:
    after = edited(codes, next_codes)
    hashes = PrefixHashes(after)
    edit = fingerprint(hashes)
    sha = hashlib.sha256(after.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(codes), sha, print_, edit, likeness(print_, edit), likeness(print_, next_print), own.common_extension(0, hashes, 0)


def _deal(bounds: np.ndarray, before: dict[int, int], tops: dict[int, int | None]):
    """(doc_id, text) -> (block, own, doc_id, text): each row in its own block, a block's top row also in the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column("doc_id"), bounds)
            ids = batch.column("doc_id").to_pylist()
            top = [i for i, (b, d) in enumerate(zip(block.tolist(), ids)) if tops.get(b, -1) == d]
            for rows, places, own in ((range(len(ids)), block, True), (top, [before[int(block[i])] for i in top], False)):
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([own] * len(at), pa.bool_()), batch.column("doc_id").take(at), batch.column("text").take(at)], names=["block", "own", "doc_id", "text"])

    return run


def block_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Blocks count upward as doc_ids go down; nulls are in the last one."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy()
    return np.where(known, len(bounds) - np.searchsorted(bounds, values, side="right"), len(bounds)).astype(np.int32)


def _place(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(batch.column("doc_id"), bounds)), batch.column("doc_id")], names=["block", "doc_id"])

    return run


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order, each held until the next comes; the first that isn't its own only follows the last."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
    held = None
    for batch in batches:
        rows = []
        for block, own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "own", "doc_id", "text"))):
            if held and held[0] == block and not held[1]:
                continue  # the last row has met the one that follows it
            codes = code_points(text.decode("utf-8", "replace"))
            hashes = PrefixHashes(codes)
            print_ = fingerprint(hashes)
            if held and held[0] == block:
                rows.append(_row(*held[2:], codes, print_))
            held = (block, own, doc_id, codes, hashes, print_)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def fingerprint_documents(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """documents -> SCHEMA, one row a document: its fingerprint, and how like it is to its edited text's and the next document's.

    The next document is that of the next lower doc_id; the first follows the last. Documents are dealt into blocks
    of doc_ids by bounds from a quantile sketch, and each block also gets the document that follows its last one, so
    that every text moves once. Blocks only divide the work: the result doesn't depend on them.
    Nulls: a null text is empty; null doc_ids come last. Rows of one doc_id follow each other by text, descending. One
    document alone follows itself. An empty table gives none. Other columns are not read.
    """
    parts = shuffle_partitions(docs.sparkSession)
    blocks = blocks or 2 * parts
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    found = slim.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], F.lit(10_000)).alias("b")).first()["b"]
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)
    placed = map_batches(slim.select("doc_id"), _place(bounds), "block int, doc_id long")
    tops = {r["block"]: r["top"] for r in placed.groupBy("block").agg(F.max("doc_id").alias("top")).collect()}  # one row a block
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    dealt = map_batches(slim, _deal(bounds, before, tops), "block int, own boolean, doc_id long, text binary")
    dealt = dealt.repartition(parts, "block").sortWithinPartitions("block", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("text"))
    return map_batches(dealt, _follow, SCHEMA)


def op1_prefix_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
