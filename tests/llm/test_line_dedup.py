import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, line_dedup
from sievewright.llm.line_dedup import bit_parallel_distance, dedup_lines, op8_line_dedup

BLANK = " \t\n\x0b\x0c\r"


def within(a, b, edits):
    """Only the cells that can be within edits are filled."""
    row = {j: j for j in range(min(edits, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            now[j] = i if not j else min(row.get(j, edits) + 1, now.get(j - 1, edits) + 1, row.get(j - 1, edits + 1) + (x != b[j - 1]))
        if min(now.values(), default=edits + 1) > edits:
            return False
        row = now
    return row.get(len(b), edits + 1) <= edits


def threshold(length, edits, near):
    if length < near or (edits is not None and length <= edits):
        return 0
    return max(1, min(5, length // 20)) if edits is None else edits


def brute(rows, edits=None, near=30):
    """rows of different documents, in order."""
    seen, out = [], []
    for doc_id, text in rows:
        kept, repeated, close_count = [], 0, 0
        for line in (text or "").split("\n"):
            x = line.strip(BLANK)
            if not x:
                kept.append(line)
            elif x in seen:
                repeated += 1
            else:
                most = {y: threshold(min(len(x), len(y)), edits, near) for y in seen}
                close = any(abs(len(x) - len(y)) <= n and within(x, y, n) for y, n in most.items() if n)
                seen.append(x)
                close_count += close
                if not close:
                    kept.append(line)
        left = sum(bool(k.strip(BLANK)) for k in kept)
        out.append((doc_id, None if text is None else "\n".join(kept), 0 if text is None else text.count("\n") + 1, repeated, close_count, 0 if text is None else left))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_repeated", "n_near", "n_left")) for r in df.collect()), key=str)


def edited(n, most, length, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(length + rng.randrange(4))).strip() for _ in range(20)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(5):
            x = rng.choice(base)
            for _ in range(rng.randrange(most + 1)):
                k = rng.randrange(len(x))
                x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "ü" + x[k + 1 :]])
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("edits", "length"), [(2, 33), (None, 57), (None, 100)])
def test_against_brute_force(make_docs, edits, length):
    rows = edited(30, (5 if edits is None else edits) + 2, length, length)
    expected = brute(rows, edits)
    assert got(dedup_lines(make_docs(rows), edits)) == expected and (edits == 0 or any(r[4] for r in expected))


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_short_lines(make_docs, edits):
    rng = random.Random(edits)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 41) if j else rng.randrange(1, 9))) for j in range(4))))
    rows += [(100 + i, "\n".join(x[:-2] + "bc" + x[-1:] if len(x) > 4 else x for x in t.split("\n"))) for i, t in rows[:30]]
    expected = brute(rows, edits, 1)
    assert got(dedup_lines(make_docs(rows), edits, near_chars=1)) == expected


def test_large_groups(make_docs, monkeypatch):
    """A template of which each line changes some words, far from each other; chains of small edits; one common start."""
    rng = random.Random(4)
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    template = [word() for _ in range(40)]
    lines = []
    for _ in range(120):
        words = template[:]
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(40)] = word(rng.randrange(5, 8))
        lines.append(" ".join(words))
        if rng.random() < 0.4:
            k = rng.randrange(len(lines[-1]))
            lines.append(rng.choice(lines)[:k] + word(rng.randrange(1, 4)) + lines[-1][k + rng.randrange(3) :])
            lines.append(lines[-2][:k] + "z" + lines[-2][k + 1 :])
    lines += ["the same beginning of every line, then " + " ".join(word() for _ in range(12)) for _ in range(40)]
    lines += [x[:60] + "q" + x[62:] for x in lines[-10:]]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(-(-len(lines) // 3))]
    expected = brute(rows)
    assert sum(r[4] for r in expected) > 30
    monkeypatch.setattr(line_dedup, "LARGE_BUCKET", 4)
    assert got(dedup_lines(make_docs(rows))) == expected
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert got(dedup_lines(make_docs(rows))) == expected


@pytest.mark.parametrize("most", [1, 2, 5, 9])
def test_bit_parallel_distance(spark, most):
    rng = random.Random(most)
    rows = []
    for _ in range(400):
        a = [rng.choice("ab😀é") for _ in range(rng.randrange(30))]
        b = a[:]
        for _ in range(rng.randrange(most + 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "é", "😀"])
        rows.append(tuple(sorted(("".join(a), "".join(b)), key=len)))
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", bit_parallel_distance(F.col("a"), F.col("b"), most).alias("n")).collect()
    assert all((r["n"] <= most) == within(r["a"], r["b"], most) and (r["n"] == 0 or r["n"] > most or not within(r["a"], r["b"], r["n"] - 1)) for r in out)


def test_every_edit_is_found(make_docs):
    line = "0123456789abcdefghijklmnopqrstuvwxyz+-"
    rows = [(0, line)] + [(1 + i, line[:i] + line[i + 1 :]) for i in range(len(line))] + [(100 + i, line[:i] + "é" + line[i:]) for i in range(len(line) + 1)] + [(200 + i, line[:i] + "é" + line[i + 1 :]) for i in range(len(line))]
    assert all(r["n_near"] == 1 for r in dedup_lines(make_docs(rows)).collect() if r["doc_id"])


def test_odd_rows(make_docs, odd_rows):
    rows = list(dict.fromkeys(r[:2] for r in odd_rows))
    rows = [r for r in rows if r[0] is not None]
    rows.sort()
    assert got(dedup_lines(make_docs(rows))) == brute(rows)
    # Rows alike lose nothing to each other; nulls come last.
    line = "a line of more than thirty characters"
    out = got(dedup_lines(make_docs([(2, line), (2, line), (None, line), (1, None)])))
    assert [r[1] for r in out] == [None, line, line, ""]
    assert dedup_lines(make_docs([])).count() == 0


def test_other_columns_pass(make_docs):
    out = dedup_lines(make_docs([(1, "x", "de", "s")]), keep=("lang", "source")).first()
    assert (out["lang"], out["source"]) == ("de", "s")


def test_whole_table(spark, sf_dir):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    seen, expected = set(), {}
    for doc_id, text in rows:
        lines = [x.strip(BLANK) for x in text.split("\n")]
        again = 0
        for x in lines:
            if x:
                again += x in seen
                seen.add(x)
        expected[doc_id] = again
    assert {r["doc_id"]: r["n_repeated"] for r in op8_line_dedup(spark, sf_dir).collect()} == expected


def test_no_python_on_executors(spark, sf_dir):
    plan = op8_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_longer_lines_allow_more_edits(make_docs, tmp_path, spark):
    rng = random.Random(6)
    bases = ["".join(rng.choice("abcdefghijklmnopé ") for _ in range(n)).strip() for n in (32, 41, 62, 81, 103, 240, 400) for _ in range(8)]
    rows = []
    for i, x in enumerate(bases):
        rows.append((2 * i, x))
        for _ in range(rng.randrange(1, 8)):
            k = rng.randrange(len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "ü" + x[k + 1 :]])
        rows.append((2 * i + 1, x))
    near = {i: any(within(x, y, max(1, min(5, min(len(x), len(y)) // 20))) for _, y in rows[:i]) for i, x in rows}
    assert 10 < sum(near.values()) < len(bases) and any(near[i] and not within(rows[i][1], rows[i - 1][1], 1) for i in near if i % 2)
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_near"] == 1 for r in op8_line_dedup(spark, str(tmp_path)).collect()} == near


def test_chance_meetings_are_not_listed(make_docs, monkeypatch):
    """Lines of one common beginning and unrelated rests: their texts aren't compared, and near ones among them are found."""
    rng = random.Random(8)
    lines = ["one beginning that many lines have, and " + "".join(rng.choice("abcdefghijklmnoprstu ") for _ in range(60 + rng.randrange(15))).strip() + "." for _ in range(150)]
    lines += [x[:70] + "Q" + x[72:] for x in lines[:9]]
    rows = [(i, x) for i, x in enumerate(lines)]
    listed, verified = [], line_dedup.verified

    def counted(pairs, *rest):
        listed.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    expected = brute(rows)
    assert got(dedup_lines(make_docs(rows))) == expected and sum(r[4] for r in expected) == 9
    assert sum(listed) < 40


def test_profiles_bound_the_edits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a = [rng.choice("eeeea ,éü😀zQ") for _ in range(rng.randrange(1, 300))]
        b, n = a[:], rng.randrange(1, 6)
        for _ in range(n):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "e", "a", "é", "😀"])
        rows.append((i, "".join(a), "".join(b), n))
    out = spark.createDataFrame(rows, "i int, a string, b string, n int")
    for name in "ab":
        out = out.select("*", *[c.alias(f"{name}{k}") for k, c in enumerate(line_dedup.profile(F.col(name)))])
    out = out.withColumn("differ", F.expr("bit_count(a1 ^ b1) + bit_count(a2 ^ b2)")).filter("differ > 2 * n OR abs(a0 - b0) > n")
    assert out.isEmpty()


def test_copies_edited_apart_are_not_listed(make_docs, monkeypatch):
    """Copies of one line, each with words of its own replaced: hardly any have their texts compared, and near ones are found."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(7))
    base = [word() for _ in range(50)]
    lines = [" ".join(base)]
    for _ in range(120):
        words = base[:]
        for k in rng.sample(range(50), 3):
            words[k] = word()
        lines.append(" ".join(words))
    lines += [x[:90] + "Q" + x[91:200] + x[201:] for x in lines[1:10]]
    listed, verified = [], line_dedup.verified

    def counted(pairs, *rest):
        listed.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    rows = [(i, x) for i, x in enumerate(lines)]
    expected = brute(rows)
    assert got(dedup_lines(make_docs(rows))) == expected and sum(r[4] for r in expected) >= 9
    assert sum(listed) < 400, listed


def test_grams_bound_the_edits(spark):
    rng = random.Random(10)
    rows = []
    for i in range(300):
        a = [rng.choice("eeeea ,éü😀zQ") for _ in range(rng.randrange(1, 200))]
        b, n = a[:], rng.randrange(1, 6)
        for _ in range(n):
            k, new = rng.randrange(len(b) + 1), rng.choice(["", "e", "a", "é", "😀"])
            b[k : k + rng.randrange(2)] = [new] if new else []
        rows.append((i, "".join(a), "".join(b), n))
    rows = [r for r in rows if r[2]]
    out = spark.createDataFrame(rows, "i int, a string, b string, n int")
    for name in "ab":
        out = out.select("*", *[c.alias(f"{name}{k}") for k, c in enumerate(line_dedup.grams(F.col(name)))])
    apart = " + ".join(f"bit_count(a{k} ^ b{k})" for k in range(line_dedup.GRAM_WORDS))
    out = out.withColumn("apart", F.expr(apart))
    assert out.filter("apart > 4 * n - abs(char_length(a) - char_length(b))").isEmpty()
    assert out.filter("apart > 0").count() > 200


def test_only_rows_that_matter_are_joined(make_docs, monkeypatch):
    """Texts are brought to pairs only where they are in one, places of lines only where something goes, whatever is broadcast."""
    rng = random.Random(13)
    lines = ["one beginning that many lines have, and " + "".join(rng.choice("abcdefghijklmnoprstu ") for _ in range(60 + rng.randrange(15))).strip() + "." for _ in range(80)]
    lines += [x[:70] + "Q" + x[72:] for x in lines[:9]] + lines[:3]
    rows = [(i, x) for i, x in enumerate(lines)]
    expected, joined, texts, places = brute(rows), line_dedup.joined_spread, [], []

    def counted(left, right, key, other, by, **more):
        if more.get("wide"):
            texts.append(right.count())
        if more.get("counted"):
            places.append(left.count())
        return joined(left, right, key, other, by, **more)

    monkeypatch.setattr(line_dedup, "joined_spread", counted)
    assert got(dedup_lines(make_docs(rows))) == expected and sum(r[4] for r in expected) == 9
    assert max(texts) < 40 and places == [9 + 2 * 3]
    # More keys than are broadcast go through a bit map of few words.
    monkeypatch.setattr(line_dedup, "KEYS", 40)
    assert got(dedup_lines(make_docs(rows))) == expected


def test_a_bit_map_keeps_every_key(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS", 500)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), "id")
    kept = line_dedup.thinned(rows, rows.filter("id < 1000").select("k"), "k")
    assert kept.filter("id < 1000").count() == 1000 and kept.count() < 2500
