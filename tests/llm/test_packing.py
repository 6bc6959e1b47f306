import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from sievewright.llm import packing
from sievewright.llm.packing import Index, corpus_counts, op3_retrieval_packing, pack, pack_documents
from sievewright.llm.pieces import WordPieces, vocabulary, word_encoder

LIBRARY = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, got):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(ids_of(t))
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        if len(ids[d]) == 1:
            at, (own,) = 0, ids[d]
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(own) and p["length"] > 0
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(own[p["start"] : at].tobytes())
            assert at == len(own)
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[d]))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 2048 and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_odd_rows(make_docs, odd_rows):
    check([r[:2] for r in odd_rows], pack_documents(make_docs(odd_rows)).collect())
    check([r[:2] for r in odd_rows], pack_documents(make_docs(odd_rows), shard_docs=3).collect())
    assert pack_documents(make_docs([])).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op3_retrieval_packing(spark, sf_dir).collect())


def test_words_have_the_librarys_ids(spark, sf_dir, odd_rows):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()][:60] + [r[1] for r in odd_rows if r[1]]
    texts += ["aaa aaaa aaaaaaa Aa'LL we'RE x'ss !!!???... 1234 a1b2 ñandú ÀÉ İı ſ ΑΣ. Σ é \x1c.\x1d  b", "z" * 300, "the,the.the;", "a.,b", ".,.", "'s 's's"]
    pieces = WordPieces(word_encoder(vocabulary("word_bpe_49k.json")), limit=500)
    for text in texts:
        (numbers,) = pieces.of_texts([text.encode().split()])
        assert pieces.ids(numbers).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_scores_are_bm25():
    docs = [np.array(x) for x in ([1, 2, 2, 3], [2, 3, 4], [5, 5, 5, 5, 5, 6], [1, 6])]
    index, average = Index(docs), np.mean([4, 3, 6, 2])
    expected = []
    for d in docs:
        total = 0
        for t in (1, 2, 3):
            df = sum(t in x for x in docs)
            tf = (d == t).sum()
            total += np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
        expected.append(total)
    assert np.allclose(index.scores(index.query(0)), expected)


def test_neighbours_come_together():
    rng = np.random.default_rng(4)
    topics = [rng.integers(100 * k, 100 * k + 60, (8, 512)) for k in range(1, 9)]
    documents = [d for group in zip(*topics) for d in group]  # dealt round robin
    together = defaultdict(set)
    for i, _, _, sequence, _, _ in pack(documents):
        together[sequence].add(i % 8)
    assert all(len(t) == 1 for t in together.values())


def test_all_terms_of_a_seed_count():
    rng = np.random.default_rng(8)
    docs = [rng.permutation(400)[: rng.integers(80, 200)] for _ in range(40)]  # common terms
    docs += [np.append(rng.permutation(np.arange(400, 4000))[:90], docs[k][:30]) for k in range(8)]  # rare ones
    index, average = Index(docs), np.mean([len(d) for d in docs])
    df = np.bincount(np.concatenate(docs), minlength=4000)
    for seed in (0, 40, 47):
        expected = [sum(np.log1p((48 - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / average)) for t in np.intersect1d(d, docs[seed])) for d in docs]
        assert np.allclose(index.scores(index.query(seed)), expected)


def test_scores_are_of_the_whole_corpus(spark):
    docs = [np.array(x, dtype="<u2") for x in ([5, 6, 6, 7], [6, 7, 8], [9, 9, 9, 10], [5, 10], [5, 8, 8, 8, 8])]
    encoded = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "ids binary").repartition(3)
    n, mean, df = corpus = corpus_counts(encoded)
    assert (n, mean, [int(df[t]) for t in (1, 5, 6, 7, 8, 9, 10, 11)]) == (5, np.mean([len(d) + 1 for d in docs]), [5, 3, 2, 2, 2, 1, 2, 0])
    shard = [np.append(d, np.uint16(1)) for d in docs[:2]]
    index = Index(shard, corpus)
    expected = [sum(np.log1p((5 - df[t] + 0.5) / (df[t] + 0.5)) * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in (1, 5, 6, 7)) for d in shard]
    assert np.allclose(index.scores(index.query(0)), expected)


def test_documents_share_numpy_calls(monkeypatch):
    """Terms of many documents are found by one sort, words looked up at once, and long documents apart; all as one by one."""
    rng = np.random.default_rng(5)
    documents = [rng.integers(0, 50_000, n).astype("<u2") for n in (3, 0, 40, 500, 1, 7, 300, 0)]
    one_by_one, calls, unique = [np.unique(d, return_counts=True) for d in documents], [], np.unique
    monkeypatch.setattr(packing.np, "unique", lambda *a, **k: calls.append(0) or unique(*a, **k))
    index = Index(documents)
    assert len(calls) == 1
    assert all(index.query(i).tolist() == terms.tolist() for i, (terms, _) in enumerate(one_by_one))
    for most in (1, 50, 400):
        monkeypatch.setattr(packing, "RUN", most)
        doc, term, count = packing.distinct_terms(documents)
        assert list(zip(doc.tolist(), term.tolist(), count.tolist())) == [(i, t, c) for i, own in enumerate(one_by_one) for t, c in zip(*map(np.ndarray.tolist, own))]
        texts = ["one two", "", "three of these words", "x", "", "two one " * 30]
        batch = packing.pa.RecordBatch.from_pydict({"shard": [0] * 6, "doc_id": list(range(6)), "text": [t.encode() for t in texts]})
        (out,) = packing._encode(vocabulary("word_bpe_49k.json"))(iter([batch]))
        assert [np.frombuffer(x, "<u2").tolist() for x in out.column("ids").to_pylist()] == [ids_of(t)[:-1].tolist() for t in texts]
    assert [x.tolist() for x in packing.distinct_terms([])] == [[], [], []]
