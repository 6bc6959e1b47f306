"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the components that they form.

Rare shingles come first in one order of all shingles, and a document is filed under the first few of its own: two
documents over the threshold share one of these (prefix filter). The documents under a shingle are a tile, kept in
order of set size and cut into size bands. In the first shingle that two sets share, neither has more of them in common than
it has shingles from there on (positional filter); a set that is over the threshold with no other one of a tile by that count
leaves the tile at once. Within a tile, hashed bitmap signatures of fixed size bound the overlap of
two sets from above by their bit counts; what is left is verified by intersecting the sorted arrays.

First every document of a band is held against the band's first one only, so that a large group of near copies costs
one comparison each. Then, in tiles that still hold more than one component, every document is held against the hub, the one
that most such tiles hold: copies edited in places of their own have rare shingles that nobody shares, their common origin
has none. This goes on while it links anything. In what tiles are left, pairs of different components are compared,
each pair in the tile of its first common shingle (again in later ones only where sets are in very many tiles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_small, map_batches, shuffle_partitions, text_bytes, written

#: Cells of the sketch that tells common shingles from rare ones. A task reports the cells that stand out from its
#: mean by so many standard deviations and shingles more; all others count as rare.
CELLS = 1 << 20
DEVIATIONS, MORE = 6, 6
#: Levels of being common, by powers of two.
LEVELS = 16
#: Bytes of sets that are handed on at once.
CHUNK = 16 << 20
#: Words of which hashes are kept, and sets that a task knows it has filed.
CACHE_WORDS = 300_000
SEEN_SETS = 200_000
#: Bits of a signature, parity bits of the hashed shingles: about half of the shingles of the sets that it serves best.
SIGNATURE_BITS = 1024
#: Sets of over twice as many shingles have a wide signature too, of up to so many bits.
WIDE_BITS = 1 << 14
#: Sets of at most so many shingles go to their tiles with a signature folded to so many bits.
FOLDED_SHINGLES, FOLDED_BITS = 800, 256
#: Tiles of a set that are looked through for a pair that has met before.
EARLIER = 64
#: Next sets of its tile that a set is held against by sizes and places; tiles of more sets of like size stay whole.
NEIGHBOURS = 256
#: So many sets of one size band of a tile stay in it: copies edited in places of their own meet their common origin there.
CROWD = 16

#: Rounds in which tiles are held against their hubs, at most; what they leave is compared all the same.
HUB_ROUNDS = 2

#: Members of a group that are verified by one task at a time.
PART = 64

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mixed(out * _M2 + w[i : len(w) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray, bits: int = SIGNATURE_BITS) -> bytes:
    """Parity bits: two sets differ in at least as many shingles as their signatures in bits."""
    parity = np.bincount(((shingles >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def wide_signature(shingles: np.ndarray) -> bytes | None:
    """For large sets, half as many bits as shingles, rounded up to a power of two."""
    if len(shingles) <= 2 * SIGNATURE_BITS:
        return None
    return signature(shingles, min(WIDE_BITS, 1 << (len(shingles) // 2 - 1).bit_length()))


def wide_difference(x: bytes, y: bytes) -> int:
    """Bits that differ; the longer signature is folded onto the shorter, which keeps parities."""
    x, y = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def signatures(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), SIGNATURE_BITS // 64)


def allowed(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures allow a link: half of what their bits don't tell apart bounds the overlap from above."""
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    most = (nx + ny - differ) // 2
    return 100 * most >= percent * (nx + ny - most)


def set_key(shingles: np.ndarray) -> int:
    """One signed 64-bit key for a set and its size."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_DESCRIBE = "doc_id long, th long, n long, key long, sig binary, wide binary, cell int, cnt long"


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), np.zeros(CELLS, dtype=np.int32)
        names = [x.split()[0] for x in _DESCRIBE.split(", ")]
        for batch in batches:
            n, keys, bits, wide, low = [], [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size, hashes)
                low.append((s & np.uint64(CELLS - 1)).astype(np.int32))
                n.append(len(s))
                keys.append(set_key(s))
                bits.append(signature(s))
                wide.append(wide_signature(s))
            if len(hashes) > CACHE_WORDS:
                hashes.clear()
            if n:
                cells += np.bincount(np.concatenate(low), minlength=CELLS).astype(np.int32)
                columns = [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        mean = cells.mean()
        full = np.flatnonzero(cells > mean + DEVIATIONS * np.sqrt(mean) + MORE)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.nulls(len(full), pa.binary())] * 2 + [pa.array(full.astype(np.int32)), pa.array(cells[full].astype(np.int64) - int(mean))], names=names)

    return run


def prefix_length(n, percent: int):
    """Of n shingles in order, so many hold one at least that any partner over the threshold shares."""
    return n - -(-percent * n // 100) + 1


def overlap_needed(nx, ny, percent: int):
    """Common shingles that sets of these sizes need for a link."""
    return -(-percent * (nx + ny) // (100 + percent))


def _file(size: int, percent: int, shared):
    """Rows (token, key, place): a token is a shingle with its level, how common it is, in the highest bits.

    place: the size n of the set, and in the lower 32 bits rest, the number of its shingles from this one on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, level = WordHashes(), set(), shared.value
        for batch in batches:
            tokens, keys, places = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size, hashes)
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                common = level[(s & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
                order = (common << np.uint64(60)) | (s >> np.uint64(4))
                if common.any():
                    order.sort()
                order = order[: prefix_length(len(s), percent)]
                tokens.append(order)
                keys.append(np.full(len(order), key, dtype=np.int64))
                places.append((len(s) << 32) + np.arange(len(s), len(s) - len(order), -1, dtype=np.int64))
            if len(hashes) > CACHE_WORDS:
                hashes.clear()
            if len(seen) > SEEN_SETS:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["token", "key", "place"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole tiles, many at a time, from rows in order of token."""
    held: list[np.ndarray] = []
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if parts and columns[0][-1] == parts[0][0][0]:  # still the tile that is held
            parts.append(columns)
            continue
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts, columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [c[cut:] for c in columns]
        parts = [held]
        if cut:
            yield [c[:cut] for c in columns]
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]


def partnered(token: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Whether the tile of each row has a partner for it that may be over the threshold if this is the first shingle they share.

    Rows are in order of token and n. Sets with more than NEIGHBOURS next ones of like size are kept, with their tiles.
    """
    kept = np.zeros(len(token), dtype=bool)
    i, step = np.arange(len(token)), 1
    while True:
        i = i[i + step < len(token)]
        needed = overlap_needed(n[i], n[i + step], percent)
        # In order of size: a partner that asks too much of i leaves only those that ask more.
        go = (token[i + step] == token[i]) & (rest[i] >= needed)
        i, needed = i[go], needed[go]
        if not len(i):
            return kept
        if step > NEIGHBOURS:
            return kept | np.isin(token, token[i])
        ok = i[rest[i + step] >= needed]
        kept[ok] = kept[ok + step] = True
        step += 1


def band_starts(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its tile's band."""
    starts = np.ones(len(token), dtype=bool)
    starts[1:] = (token[1:] != token[:-1]) | (band[1:] != band[:-1])
    return starts


def _lead(percent: int):
    """(token, key, place) in order of token, size and key -> the rows (token, key, n, rest) that have a partner in their tile or are a crowd there, with the first set of their size band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, key, place in _tiles(batches):
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, n, rest = token[new], key[new], place[new] >> 32, place[new] & 0xFFFFFFFF
            band = np.floor(np.log(n) / np.log(100 / percent)) if percent < 100 else n
            kept = partnered(token, n, rest, percent)
            at = np.flatnonzero(band_starts(token, band))
            times = np.diff(np.append(at, len(token)))
            kept |= np.repeat(times >= CROWD, times)
            token, key, n, rest, band = token[kept], key[kept], n[kept], rest[kept], band[kept]
            if not len(token):
                continue
            starts = band_starts(token, band)
            leader = key[np.maximum.accumulate(np.where(starts, np.arange(len(token)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, key, n, rest, leader)], names=["token", "key", "n", "rest", "leader"])

    return run


def _screen(percent: int):
    """Pairs with sizes and signatures of both -> those that the signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("a_n", "b_n")]
            ok = allowed(signatures(batch.column("a_sig")), signatures(batch.column("b_sig")), *sizes, percent)
            wide = [batch.column(c) for c in ("a_wide", "b_wide")]
            for i in np.flatnonzero(ok & np.logical_and(*(w.is_valid().to_numpy(zero_copy_only=False) for w in wide))).tolist():
                n = int(sizes[0][i] + sizes[1][i])
                most = (n - wide_difference(wide[0][i].as_py(), wide[1][i].as_py())) // 2
                ok[i] = 100 * most >= percent * (n - most)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def folded(signatures: np.ndarray) -> np.ndarray:
    """Rows of signatures folded to FOLDED_BITS, which keeps parities."""
    return np.bitwise_xor.reduce(signatures.reshape(len(signatures), -1, FOLDED_BITS // 64), axis=1)


def disjoint(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two arrays, of different values each, have none in common."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return not (both[1:] == both[:-1]).any()


_TILE_ROWS = "token long, n long, key long, comp long, rest long, sig binary, earlier binary"


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, comp, sig, tokens in order, their rests, n if there are none) -> a row for each token, with the first EARLIER of the tokens before it.

    The signature is folded where the set is so small that the folded one still tells sets apart.
    """
    names, kinds = [x.split()[0] for x in _TILE_ROWS.split(", ")], [pa.int64()] * 5 + [pa.binary()] * 2

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        token, times = np.concatenate([r[4] for r in rows]), [len(r[4]) for r in rows]
        rest = np.concatenate([r[6] for r in rows])
        repeated = [np.repeat([r[i] for r in rows], times) for i in (1, 0, 2)]
        sig = [r[3] for r in rows for _ in range(len(r[4]))]
        earlier = [r[5][: 8 * i] for r in rows for i in range(len(r[4]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((token, *repeated, rest, sig, earlier), kinds)], names=names)

    for batch in batches:
        rows, held = [], 0
        known = batch.column("rests") if "rests" in batch.schema.names else [None] * batch.num_rows
        for key, n, comp, sig, tokens, rests in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "comp", "sig")), batch.column("tokens"), known):
            if n <= FOLDED_SHINGLES:
                sig = folded(np.frombuffer(sig, dtype=np.uint64)[None]).tobytes()
            tokens = tokens.values.to_numpy()
            earlier = tokens[:EARLIER].tobytes()
            rows.append((key, n, comp, sig, tokens, earlier, np.full(len(tokens), n) if rests is None else rests.values.to_numpy()))
            held += len(tokens) * (40 + len(sig) + len(earlier))
            if held > CHUNK:
                yield chunk(rows)
                rows, held = [], 0
        if rows:
            yield chunk(rows)


def _compare(percent: int):
    """Rows of _TILE_ROWS in order of token and n -> pairs of different components that the signatures allow.

    A pair that has met in an earlier tile is passed over. Only the first EARLIER tiles of a set are looked through for
    that: sets in many tiles may give a pair more than once, and none never.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, key, comp, rest, sig, earlier in _tiles(batches):
            own = [np.frombuffer(x, dtype=np.int64) for x in earlier]
            large = n > FOLDED_SHINGLES
            full = np.frombuffer(b"".join(sig[large]), dtype=np.uint64).reshape(-1, SIGNATURE_BITS // 64)
            bits = np.empty((len(n), FOLDED_BITS // 64), dtype=np.uint64)
            bits[~large] = np.frombuffer(b"".join(sig[~large]), dtype=np.uint64).reshape(-1, FOLDED_BITS // 64)
            bits[large] = folded(full) if len(full) else 0
            at = np.cumsum(large) - 1
            i, step = np.arange(len(token)), 1
            while True:
                i = i[i + step < len(token)]
                needed = overlap_needed(n[i], n[i + step], percent)
                # In order of size: a partner that asks too much of i leaves only those that ask more.
                go = (token[i + step] == token[i]) & (rest[i] >= needed)
                i, needed = i[go], needed[go]
                if not len(i):
                    break
                x = i[(comp[i] != comp[i + step]) & (rest[i + step] >= needed)]
                for x in np.array_split(x, -(-len(x) // 65536) or 1):
                    ok = x[allowed(bits[x], bits[x + step], n[x], n[x + step], percent)]
                    both = ok[large[ok] & large[ok + step]]
                    told = both[~allowed(full[at[both]], full[at[both + step]], n[both], n[both + step], percent)]
                    ok = np.setdiff1d(ok, told, assume_unique=True)
                    ok = ok[[disjoint(own[j], own[j + step]) for j in ok.tolist()]] if len(ok) else ok
                    if len(ok):
                        a, b = key[ok], key[ok + step]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                step += 1

    return run


def _gather(size: int):
    """(text, roles) -> a row for each group that the text's set has a role in, with the set as a sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        names = ["group", "part", "leads", "key", "shingles"]
        for batch in batches:
            rows, held = [], 0
            for text, roles in zip(batch.column("text"), batch.column("roles")):
                s = shingle_set(text.as_py(), size, hashes)
                key, data = set_key(s), s.tobytes()
                for r in roles.as_py():
                    rows.append((r["group"], r["part"], r["leads"], key, data))
                    held += len(data)
                    if held > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            if len(hashes) > CACHE_WORDS:
                hashes.clear()

    return run


def _verify(percent: int):
    """Rows of a group's part in order, the leader's first -> the members that are over the threshold with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, None
        for batch in batches:
            linked = []
            for g, leads, key, data in zip(*(batch.column(c).to_pylist() for c in ("group", "leads", "key")), batch.column("shingles")):
                x = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if leads:
                    group, lead = g, x.copy()
                    continue
                if g != group:
                    raise ValueError(f"group {g} has no leader")
                few, many = (x, lead) if len(x) <= len(lead) else (lead, x)
                common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                if 100 * common >= percent * (len(x) + len(lead) - common):
                    linked.append((g, key))
            a, b = zip(*linked) if linked else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (key, label): the least node that is reachable, for every node of an edge.

    Labels take the least of the neighbours' labels, roots are hooked, and labels jump to their own label's label,
    until nothing changes; every round is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("_m")).select("key", F.least("key", "_m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        now = labels.join(seen, labels["key"] == seen["a"]).select("key", "label", F.least("label", "near").alias("near"))
        hooked = now.groupBy(F.col("label").alias("old")).agg(F.min("near").alias("root"))
        now = written(now.join(hooked, now["label"] == hooked["old"]).select("key", F.col("label").alias("was"), F.least("near", "root").alias("label")), "hooked")
        up = now.select(F.col("key").alias("_k"), F.col("label").alias("_l"))
        jumped = written(now.join(up, now["label"] == up["_k"], "left").select("key", "was", F.least("label", "_l").alias("label")), "jumped")
        labels = jumped.select("key", "label")
        if jumped.filter("was <> label").isEmpty():
            return labels


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents -> doc_id, th, n_shingles, component_id, stays, one row a document; th is a hash of the text.

    Documents link when 100 * common shingles >= percent * shingles of either; component_id is the least doc_id that
    links reach. stays is true for one document of each component, that of the least doc_id (rows alike in doc_id and
    text have it together). A text of fewer words than a shingle counts as one shingle.
    Nulls: a null text, like one without words, has no shingles and no links; its component_id is its own doc_id. Null
    doc_ids link like others but name no component: one that has no doc_id at all gets null. Repeated rows and copies
    link with each other. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), text_bytes().alias("text"))
    described = written(map_batches(slim, _describe(size), _DESCRIBE), "described")
    known = described.filter("cell IS NULL").drop("cell", "cnt")
    level = np.zeros(CELLS, dtype=np.uint8)
    for r in described.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("cnt").alias("cnt")).toLocalIterator():  # CELLS rows at most
        level[r["cell"]] = min(LEVELS - 1, r["cnt"].bit_length())
    filed = map_batches(slim.select("text"), _file(size, percent, spark.sparkContext.broadcast(level)), "token long, key long, place long")
    filed = filed.repartition(parts, "token").sortWithinPartitions("token", F.shiftright("place", 32), "key")
    tiles = written(map_batches(filed, _lead(percent), "token long, key long, n long, rest long, leader long"), "tiles")

    # One row a set: what a copy has too is found once.
    sets = known.filter("n > 0").groupBy("key", "n", "sig", "wide").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    sets = written(sets.select("key", "n", "sig", "wide", F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th")), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"{name}_{c}") for c in ("key", "n", "sig", "wide")])

    def screened(pairs: DataFrame, name: str) -> DataFrame:
        """Different pairs (a, b) that the signatures allow, written."""
        both = pairs.distinct().join(side("a"), F.col("a") == F.col("a_key")).join(side("b"), F.col("b") == F.col("b_key"))
        both = both.select("a", "b", *[f"{s}_{c}" for c in ("n", "sig", "wide") for s in "ab"])
        return written(map_batches(both, _screen(percent), "a long, b long"), name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b), written -> those over the threshold.

        Every a leads a group of its b's, cut into parts of about PART members that each get the leader's set too: so
        a set is shuffled once for each pair that it is in.
        """
        led = pairs.groupBy(F.col("a").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        led = written(led, f"{name}-groups")
        role = lambda part, leads: F.struct(F.col("_g").alias("group"), part.alias("part"), F.lit(leads).alias("leads")).alias("role")
        members = pairs.join(led, F.col("a") == F.col("_g")).select(F.col("b").alias("key"), role(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), False))
        leaders = led.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("_g").alias("key"), role(F.col("_part"), True))
        roles = members.union(leaders).groupBy("key").agg(F.collect_list("role").alias("roles"))
        ones = roles.join(sets.select(F.col("key").alias("_k"), "one_id", "one_th"), F.col("key") == F.col("_k")).select("one_id", "one_th", "roles")
        texts = joined_small(slim.withColumnsRenamed({"doc_id": "one_id", "th": "one_th"}), written(ones, f"{name}-ones"), ["one_id", "one_th"], "inner")
        gathered = map_batches(texts.select("text", "roles"), _gather(size), "group long, part int, leads boolean, key long, shingles binary")
        gathered = gathered.repartition(parts, "group", "part").sortWithinPartitions("group", "part", F.desc("leads"))
        return written(map_batches(gathered, _verify(percent), "a long, b long"), f"{name}-links")

    def mixed_tiles(labels: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows (token, n, key, rest) of tiles that hold several components, with comp, written."""
        placed = joined_small(rows.select("token", "n", "key", "rest"), labels, ["key"]).select("token", "n", "key", "rest", F.coalesce("label", "key").alias("comp"))
        mixed = placed.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select(F.col("token").alias("_t"))
        return written(placed.join(mixed, F.col("token") == F.col("_t"), "left_semi"), "mixed")

    stars = tiles.filter("leader <> key").select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b"))
    links = verified(screened(stars, "stars"), "stars")
    labels = components(links)
    mixed = mixed_tiles(labels, tiles)
    discard(tiles)
    past = None
    for _ in range(HUB_ROUNDS):
        times = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        times = written(times if past is None else joined_small(times, past, ["key"], "left_anti"), "tiles-of")
        hubs = joined_small(mixed, times, ["key"], "inner").groupBy("token").agg(F.max(F.struct("times", "key", "n", "comp")).alias("hub"))
        hubs = written(hubs, "hubs")
        named = hubs.select(F.col("hub.key").alias("key")).distinct()
        past = written(named if past is None else past.union(named).distinct(), "past-hubs")
        spokes = mixed.join(hubs.select(F.col("token").alias("_t"), "hub"), F.col("token") == F.col("_t"))
        alike = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & (F.col("comp") != F.col("hub.comp"))
        spokes = spokes.filter(alike).select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b"))
        more = verified(screened(spokes, "spokes"), "spokes")
        if more.isEmpty():
            break
        links = written(links.union(more), "links")
        labels = components(links)
        fewer = mixed_tiles(labels, mixed)
        discard(mixed)
        mixed = fewer

    # A set has few mixed tiles, its prefix at most. Earlier ones are those with more of the set to come, for every set alike.
    prefixes = mixed.groupBy("key").agg(F.min("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("rest", "token")), asc=False).alias("places"))
    prefixes = prefixes.join(side("a"), F.col("key") == F.col("a_key")).select("key", F.col("a_n").alias("n"), "comp", F.col("a_sig").alias("sig"), F.col("places.token").alias("tokens"), F.col("places.rest").alias("rests"))
    rows = map_batches(prefixes, _tile_rows, _TILE_ROWS).repartition(parts, "token").sortWithinPartitions("token", "n", "key")
    more = verified(screened(map_batches(rows, _compare(percent), "a long, b long"), "rest"), "rest")
    discard(mixed)
    if not more.isEmpty():
        labels = components(links.union(more))

    out = joined_small(known.select("doc_id", "th", "n", "key"), labels, ["key"]).select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("comp"))
    # Links and copies alone make components of more than one document.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th"))
    firsts = out.filter("comp IS NOT NULL").groupBy("comp").agg(least.alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    out = joined_small(out, written(firsts, "firsts"), ["comp"])
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), stays.alias("stays"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90).drop("th")
