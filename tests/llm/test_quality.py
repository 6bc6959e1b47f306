import re
from collections import Counter

import numpy as np
from sentencepiece import SentencePieceProcessor

from sievewright.llm.pieces import vocabulary
from sievewright.llm.quality import BANDS, FULL_TOKENS, op6_fertility_rules, rate_fertility, script_of

LIBRARY = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit), failed


def check(rows, out):
    got = sorted((tuple(r)[1:7] for r in out), key=str)
    assert got == sorted((brute(t) for _, t in rows), key=str)
    for r in out:
        least, most, most_bytes, least_bits = BANDS[r["script"]]
        inside = least <= r["chars_per_token"] <= most and r["byte_share"] <= most_bytes and r["token_entropy"] >= least_bits * np.log2(max(2, min(r["n_tokens"], FULL_TOKENS)))
        assert r["kept"] == (not r["base_failed"] and inside)


def test_odd_rows(make_docs, odd_rows):
    check([r[:2] for r in odd_rows], rate_fertility(make_docs(odd_rows)).collect())
    assert rate_fertility(make_docs([])).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = op6_fertility_rules(spark, sf_dir).collect()
    check(rows, out)
    texts = dict(rows)
    for r in out[:40]:  # the library gives the same measures for words one by one
        ids = [i for w in texts[r["doc_id"]].split() for i in LIBRARY.encode(w)]
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        assert r["n_tokens"] == len(ids) and abs(r["token_entropy"] + (share * np.log2(share)).sum()) < 1e-9
        assert r["byte_share"] == np.mean([LIBRARY.is_byte(i) for i in ids])


def test_clean_text_stays_and_junk_goes(spark, make_docs):
    path = "/root/testdata/sf0.01"
    good = [r["doc_id"] for r in spark.read.parquet(f"{path}/labels.parquet").filter("quality = 1").collect()]
    kept = {r["doc_id"]: r for r in op6_fertility_rules(spark, path).collect()}
    clean = [kept[i] for i in good if i in kept and not kept[i]["base_failed"]]
    assert clean and all(r["kept"] for r in clean)
    junk = [(1, " ".join("༺\U0001f9ff" for _ in range(80))), (2, " ".join(f"AB{i % 3}!!" for i in range(90)) + " end"), (3, "aaaa " * 200)]
    assert not any(r["kept"] for r in rate_fertility(make_docs(junk)).collect())


def test_scripts():
    names = {"plain words é": "latin", "обычный текст": "cyrillic", "λόγος": "greek", "日本語の文": "cjk", "नमस्ते": "other", "12 !": "none", "": "none"}
    assert {t: script_of(t.encode()) for t in names} == names
