"""Each stage, and the whole, against plain Python on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_mixing import check as check_mix
from test_ngram_join import brute as brute_groups
from test_packing import check as check_packs

import corpus_pipeline
from sievewright.llm.common import written
from sievewright.llm.mixing import mix_sources

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"de": "der die und das ist nicht ein haus baum wasser schule straße himmel garten".split(), "en": "the and that is not a house tree water school street sky garden with".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(["de", "en"])
        lines = [" ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines), lang, f"src{i % 4}"))
    rows += [(100 + i, rows[i][1], *rows[i][2:]) for i in range(10)]  # exact copies
    for i in range(10):  # near copies in one long line
        line = rows[20 + i][1].replace("\n", " ") + " " + " ".join(rng.choice(words["en"]) + str(rng.randrange(90)) for _ in range(60))
        rows += [(200 + i, line, "en", "src1"), (300 + i, line + " added words here", "en", "src2")]
    rows += [(400, "12345 !!!", "en", "src0"), (401, None, None, None), (402, "", "de", "src1"), (403, rows[0][1].split("\n")[0] + "\nand a new line that nobody else has anywhere", None, "src3")]
    path = tmp_path_factory.mktemp("corpus")
    full = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_stages_and_whole(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language id", "line dedup", "n-gram jaccard join", "source mixing", "retrieval packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    start = rows_of(docs)

    docs = written(stages["language id"](spark, docs, corpus), "1")
    told = rows_of(docs)
    assert docs.columns == COLUMNS
    assert sorted(r[0] for r in told) == sorted(r[0] for r in start if r[0] not in (400, 401, 402)) and all(r[2] for r in told)

    docs = written(stages["line dedup"](spark, docs, corpus), "2")
    lined = rows_of(docs)
    expected = {d: (text, left, lost + near) for d, text, _, lost, near, left in brute_lines(sorted((r[0], r[1]) for r in told))}
    assert {r[0]: r[1] for r in lined} == {d: t for d, (t, left, lost) in expected.items() if left or not lost}
    assert all(r[4] == len(r[1]) for r in lined) and len(lined) < len(told)

    docs = written(stages["n-gram jaccard join"](spark, docs, corpus), "3")
    joined = rows_of(docs)
    groups = brute_groups([(r[0], r[1]) for r in lined], 5, 80)
    assert sorted(r[0] for r in joined) == sorted({g for _, _, g in groups}) and len(joined) < len(lined)
    assert set(joined) <= set(lined)

    mixed_in = docs
    docs = written(stages["source mixing"](spark, docs, corpus), "4")
    mixed = rows_of(docs)
    decided = mix_sources(mixed_in).collect()
    check_mix([(r[0], r[1], r[3]) for r in joined], decided)
    assert Counter(r[0] for r in mixed) == Counter({r["doc_id"]: r["copies"] for r in decided if r["copies"]}) and set(mixed) <= set(joined)

    packed = stages["retrieval packing"](spark, docs, corpus).collect()
    check_packs([(r[0], r[1]) for r in mixed], packed)

    whole = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(map(str, whole)) == sorted(map(str, packed))


def test_repeated_rows_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, "en", "s", 9), (1, long, "en", "s", 9), (None, long, "en", None, 9), (2, None, "en", "s", None), (1, "other text", "en", "s", 9)], schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = rows_of(stages["n-gram jaccard join"](spark, docs, ""))
    assert Counter((r[0], r[1]) for r in kept) == {(1, long): 1, (2, None): 1, (1, "other text"): 1}
    assert all(r[0] in (1, None, 2) for r in rows_of(stages["source mixing"](spark, docs, "")))
    assert len(rows_of(stages["line dedup"](spark, docs, ""))) == 4  # the third has lost its line


def test_clashing_columns_and_long_texts(spark):
    long = "\n".join(" ".join(f"word{i * 7 + j}" for j in range(7)) for i in range(20_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 9), (2, long + " end", "en", "s", 9), (3, "a short text of its own", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_d", "_t", "_th", "_times", "_copy", "_lost", "th", "h", "line", "key", "comp", "size", "copies", "stays", "rank"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == COLUMNS and {r["doc_id"] for r in out.select("doc_id").collect()} <= {1, 2, 3}, name
    assert sorted(r[0] for r in rows_of(dict(corpus_pipeline.STAGES)["n-gram jaccard join"](spark, docs, ""))) == [1, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_language_id_rejects_junk_and_foreign_text(spark):
    rng = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = [(r["doc_id"], r["text"], r["lang"], "s", 1) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 200").collect()]
    letters = "abcdefghijklmnopqrstuvwxyz"
    planted = [
        " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(60)),
        " ".join(f"{rng.getrandbits(32):08x}" for _ in range(40)),
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心",
    ]
    english = (-100, "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.", None, "s", 1)
    docs = spark.createDataFrame([*clean, english, *[(-1 - i, t, None, "s", 1) for i, t in enumerate(planted)]], schema)
    stage = dict(corpus_pipeline.STAGES)["language id"]
    kept = {r[0]: r[2] for r in rows_of(stage(spark, docs, ""))}
    assert set(kept) == {-100, *(r[0] for r in clean)} and kept[-100] == "en"
    # Without any label nothing can be told, and nothing goes.
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(rows_of(stage(spark, bare, "")), key=str) == sorted(rows_of(bare), key=str)
