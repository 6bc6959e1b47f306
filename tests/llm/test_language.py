import itertools
import zlib

import numpy as np
import pytest

from sievewright.llm import language
from sievewright.llm.language import Lattice, fit, held_out, identify_languages, log_scores, op5_language_id

PIECES = ["▁", "▁a", "a", "ab", "b", "ba", "▁ab", "c", "abc"]


def brute_score(word, pieces, p):
    """The sum over all segmentations, one by one."""
    known = sorted(set(pieces))
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, cut in enumerate([*cuts, 1], 1):
            if cut:
                parts.append(word[start:i])
                start = i
        chance = 1.0
        for x in parts:
            chance *= p[known.index(x)] if x in known else p[-1] if len(x) == 1 else 0.0
        total += chance
    return np.log(total)


def test_forward_sums_all_segmentations():
    lattice = Lattice(PIECES)
    p = np.random.default_rng(0).random((lattice.size, 3))
    words = ["abab", "cab", "zzb", "a", "bacabba", "日a"]
    for k in range(3):
        assert np.allclose(log_scores(words, lattice, p)[:, k], [brute_score("▁" + w, PIECES, p[:, k]) for w in words])


def test_long_words_are_scored_whole():
    """Against a sum in logarithms: pieces across any border count, and products of thousands of characters keep their size."""
    lattice, rng = Lattice([*PIECES, "abababababababab", "ba" * 9]), np.random.default_rng(1)
    p = rng.random((lattice.size, 2)) * 0.01
    known = {x: i for i, x in enumerate(sorted({*PIECES, "abababababababab", "ba" * 9}))}
    for word in ("ab" * 3000, "".join(rng.choice(list("abcz日"), 500)), "ab" * 16, "ab" * 15 + "c"):
        marked, totals = "▁" + word, [np.zeros(2)]
        for end in range(1, len(marked) + 1):
            ways = []
            for begin in range(max(0, end - 18), end):
                piece = marked[begin:end]
                if piece in known or len(piece) == 1:
                    ways.append(totals[begin] + np.log(p[known.get(piece, -1)]))
            totals.append(np.logaddexp.reduce(ways))
        assert np.allclose(log_scores([word], lattice, p)[0], totals[-1])


def test_fit_raises_the_likelihood():
    lattice, words = Lattice(PIECES), ["abab", "abc", "cab", "bb"]
    counts = np.array([[5.0, 0.0], [3.0, 1.0], [0.0, 4.0], [0.0, 6.0]])
    flat = np.full((lattice.size, 2), 1 / lattice.size)
    p = fit(words, counts, lattice)
    assert (counts * log_scores(words, lattice, p)).sum() > (counts * log_scores(words, lattice, flat)).sum()
    assert np.allclose(p[:-1].sum(axis=0), 1, atol=0.05)


def test_odd_rows(make_docs, odd_rows):
    training = make_docs([(i, "der die und das ist nicht ein haus", "de") for i in range(20)] + [(i, "the and that is not a house of this", "en") for i in range(20)] + [(99, None, "fr"), (98, "texte", None)])
    out = identify_languages(make_docs(odd_rows), training).collect()
    assert len(out) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by_id[4]["lang_pred"] == "en" and by_id[4]["score"] > 0.9
    for i in (3, 8, 9, 11, 12):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("de", "en", "und") for r in out)
    assert identify_languages(make_docs([]), training).count() == 0


def test_nothing_to_learn_from(make_docs):
    out = identify_languages(make_docs([(1, "some text")]), make_docs([])).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)]


def test_numbers_are_no_language(make_docs):
    training = make_docs([(1, "one two three", "en")])
    assert identify_languages(make_docs([(1, "12 34 ... !!")]), training).first()["lang_pred"] == "und"


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_held_out_accuracy(spark, folder):
    path = f"/root/testdata/{folder}"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    out = op5_language_id(spark, path).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)


def test_held_out_is_by_id(spark):
    ids = [0, 1, 7, 12345, -3, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out()).collect()]
    assert got == [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i in ids]
