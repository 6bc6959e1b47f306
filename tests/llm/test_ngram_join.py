import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import ngram_join
from sievewright.llm.ngram_join import WordHashes, allowed, components, ngram_components, op4_ngram_jaccard, prefix_length, shingle_set, signature


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    under = defaultdict(list)
    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in under[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
        for x in s:
            under[x].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[root(i)]) if least[root(i)] else None) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(n, seed=7):
    """Chains of edits, a large group of near copies, exact copies and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    passage, rows = [word() for _ in range(30)], []
    for i in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            words = base[:]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(120)] = word()
        elif kind == 1:
            words = base[: 100 + rng.randrange(20)]
        elif kind == 2:
            words = [word() for _ in range(60)] + passage
        else:
            words = passage if rng.random() < 0.3 else [word() for _ in range(rng.randrange(6))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(make_docs, size, percent):
    rows = near_copies(160)
    assert got(ngram_components(make_docs(rows), size, percent)) == brute(rows, size, percent)


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert got(ngram_components(make_docs(odd_rows), 3, 90)) == brute(rows, 3, 90)
    assert ngram_components(make_docs([])).count() == 0


def test_one_of_each_group_stays(make_docs):
    rows = near_copies(80)
    out = ngram_components(make_docs(rows)).collect()
    staying = Counter(r["component_id"] for r in out if r["stays"])
    assert staying == Counter({r["component_id"] for r in out}) and all(r["doc_id"] == r["component_id"] for r in out if r["stays"])


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4_ngram_jaccard(spark, sf_dir)) == brute(rows, 3, 90)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (-3, 105)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {r["key"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: root(x) for x in parent}


def test_signatures_never_refuse_a_link():
    rng, hashes = random.Random(8), WordHashes()
    for _ in range(200):
        words = [str(rng.randrange(500)) for _ in range(rng.randrange(3, 400))]
        other = words[:]
        for _ in range(rng.randrange(8)):
            other[rng.randrange(len(other))] = str(rng.randrange(500))
        x, y = (shingle_set(" ".join(w).encode(), 3, hashes) for w in (words, other))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            bits = [np.frombuffer(signature(s), dtype=np.uint64)[None] for s in (x, y)]
            assert allowed(*bits, np.array([len(x)]), np.array([len(y)]), 80)[0]
            assert len(np.intersect1d(x[: prefix_length(len(x), 80)], y[: prefix_length(len(y), 80)])) > 0


def test_folded_signatures_keep_the_bound():
    rng = np.random.default_rng(5)
    for n in (3, 200, 3000):
        x, y = (np.unique(rng.integers(0, 4000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        one, two = (ngram_join.folded(np.frombuffer(signature(s), dtype=np.uint64)[None]) for s in (x, y))
        assert int(np.bitwise_count(one ^ two).sum()) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("earlier", [0, 2, 64])
def test_tiles_give_every_pair(monkeypatch, earlier):
    """Pairs over the threshold that share a tile are found; with all earlier tiles at hand, each of them once."""
    monkeypatch.setattr(ngram_join, "EARLIER", earlier)
    monkeypatch.setattr(ngram_join, "FOLDED_SHINGLES", 60)
    rng = np.random.default_rng(11)
    base, sets = rng.integers(1, 1 << 62, 66).astype(np.uint64), []
    for _ in range(40):
        x = base[: int(rng.integers(54, 67))].copy()
        x[rng.integers(0, len(x), int(rng.integers(0, 6)))] = rng.integers(1, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(x))
    tokens = [np.sort(rng.choice(12, int(rng.integers(1, 9)), replace=False)) for _ in sets]
    keys = list(range(len(sets)))
    columns = [pa.array(keys), pa.array([len(s) for s in sets]), pa.array(keys), pa.array([signature(s) for s in sets]), pa.array([t.tolist() for t in tokens], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "n", "comp", "sig", "tokens"])
    rows = pa.Table.from_batches(ngram_join._tile_rows(iter([batch]))).sort_by([("token", "ascending"), ("n", "ascending"), ("key", "ascending")])
    found = Counter((a, b) for out in ngram_join._compare(80)(iter(rows.to_batches(max_chunksize=17))) for a, b in zip(*(out.column(c).to_pylist() for c in "ab")))
    share = {(i, j) for i in keys for j in keys[:i] if len(np.intersect1d(tokens[i], tokens[j]))}
    over = {(j, i) for i, j in share if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert over and over <= set(found) <= {(j, i) for i, j in share}
    if earlier == 64:
        assert max(found.values()) == 1


@pytest.mark.parametrize("neighbours", [2, 256])
def test_first_common_shingles_keep_every_link(monkeypatch, neighbours):
    """Of sets over the threshold the tile of the first common shingle keeps both."""
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", neighbours)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 70, int(rng.integers(1, 200)))) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[: len(s) - int(rng.integers(0, 6))], rng.integers(0, 70, int(rng.integers(0, 3)))])) for s in sets]
    sets = [s for s in sets if len(s)]
    rows = sorted({(int(t), len(s), len(s) - i, key) for key, s in enumerate(sets) for i, t in enumerate(s[: prefix_length(len(s), 80)])})
    token, n, rest, key = (np.array(c) for c in zip(*rows))
    kept = {(t, k) for t, k, ok in zip(token.tolist(), key.tolist(), ngram_join.partnered(token, n, rest, 80)) if ok}
    links = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            common = np.intersect1d(x, y)
            if len(common) and 100 * len(common) >= 80 * (len(x) + len(y) - len(common)):
                links += 1
                assert {(int(common[0]), i), (int(common[0]), j)} <= kept
    assert links > 100
    if neighbours == 256:
        assert len(kept) < len(rows)


def test_chance_meetings_leave_their_tiles(make_docs, monkeypatch):
    """Texts that share a passage in sizes or places that allow no link are held in no tile."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(40 + 12 * i)] + passage)) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " " + word()) for i in range(5)]
    held, written = {}, ngram_join.written

    def counted(df, name, *args, **options):
        out = written(df, name, *args, **options)
        held.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    assert got(ngram_components(make_docs(rows), 3, 90)) == brute(rows, 3, 90)
    # The links' own tiles: a tenth of two sets each.
    assert 0 < held["tiles"] < 100
