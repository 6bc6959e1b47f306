import hashlib
import os
import random

import pytest

from sievewright.llm.fingerprints import PrefixHashes, code_points, fingerprint, fingerprint_documents, likeness, op1_prefix_fingerprint


def prints(text):
    return fingerprint(PrefixHashes(code_points(text)))


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        a, b = prints(t), prints(edit)
        out.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, prints(after)), len(os.path.commonprefix([t, edit]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_odd_rows(make_docs, odd_rows, blocks):
    assert sorted(map(tuple, fingerprint_documents(make_docs(odd_rows), blocks).collect()), key=str) == expected([r[:2] for r in odd_rows])


def test_one_and_none(make_docs):
    assert [tuple(r) for r in fingerprint_documents(make_docs([(1, "abcdef")])).collect()] == expected([(1, "abcdef")])
    assert fingerprint_documents(make_docs([])).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op1_prefix_fingerprint(spark, sf_dir).collect()), key=str) == expected(rows)


def test_spans_and_extensions():
    rng = random.Random(1)
    a = "".join(rng.choice("ab日") for _ in range(400))
    b = a[57:300] + "z" + a[:40]
    x, y = PrefixHashes(code_points(a)), PrefixHashes(code_points(b))
    for _ in range(300):
        i, j, n = rng.randrange(400), rng.randrange(len(b)), rng.randrange(8)
        assert x.equal(i, y, j, n) == (i + n <= 400 and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        assert x.common_extension(i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))


def test_likeness():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    text, other = " ".join(words[:450]), " ".join(words[450:])
    assert likeness(prints(text), prints(text)) == 1 and likeness(prints(""), prints("")) == 1 and likeness(prints(""), prints("a")) == 0
    assert likeness(prints(text), prints(other)) < 0.05 < 0.2 < likeness(prints(text), prints(text[:1500] + other[:1500])) < 0.6
    assert likeness(prints(text), prints(text.replace(words[9], "changed"))) > 0.8
