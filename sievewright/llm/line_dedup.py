"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line that another one equals, or comes within a few edits of, keeps its first occurrence in the corpus. The threshold
grows with the length of the shorter of the two.

Lengths are cut into bands with one threshold each. A line of a band is split into threshold + 1 segments of one size, the
first half of them counted from the line's start, the others from its end. Of two lines within the threshold, either
the first half of the segments holds fewer edits than it has segments, or the second half does; in that half the first
segment that no edit touched has at most as many edits before it as segments. So a line is filed under its segments, and
looks up, for its own band and the one below, each segment shifted by no more than its place: about a fourth of the
substrings that segments of exact lengths would need. What meets is verified by a banded edit distance.

Lines that differ by few edits have nearly the same counts of each letter. So every line that meets another has a profile, its
length and codes of how often it has each of 32 characters, and only pairs whose profiles allow it are listed at all and have their
texts compared: two lines that share a short substring by chance nearly always fail that. Lines without these characters pass it.
Copies of one line, each edited in places of its own by more than the threshold, have much the same letters. So lines of buckets of
some size also have parity bits of their pairs of neighbouring characters, of which an edit changes four at most and a word many.

Only whether an earlier line is near is asked, so pairs are never listed within a bucket. Every member is held against the
bucket's first line; what that settles asks nothing more. Small buckets compare what is left. Lines of large buckets, which
have much text in common, are split once more into finer pieces and filed under their threshold + 1 rarest ones: any
so many disjoint pieces hold an untouched one, and the rare ones are those that the crowd doesn't share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_small, joined_spread, shuffle_partitions, written

#: Lines of fewer characters are compared for equality only: a few characters tell headings and list items apart.
NEAR_CHARS = 30
#: Edits (insert, delete, replace a character) within which two lines count as one: one for every so many characters of
#: the shorter line, at least 1 and at most MAX_EDITS. A band of lengths is as wide.
CHARS_AN_EDIT = 20
MAX_EDITS = 5
#: From this length on bands are wider than CHARS_AN_EDIT.
WIDE_FROM = 128
#: Most edits that can be asked for; more would reach beyond the next band.
MOST_EDITS = CHARS_AN_EDIT - 1
#: Buckets of more lines are split by finer pieces, about so many for each segment and of so many characters at least.
LARGE_BUCKET = 4000
FINER, PIECE_CHARS = 8, 6
#: Characters whose counts make a line's profile, sixteen in a long.
COUNTED = "etaoinsrhdlucmgpfwybvkxjqz .,-éü"
_PROFILE = ("length", "c0", "c1")
#: Members of buckets of more lines have GRAM_WORDS longs of parity bits of their character pairs besides.
CROWD = 50
GRAM_WORDS = 4
_GRAMS = tuple(f"g{i}" for i in range(GRAM_WORDS))
#: Tables of at most so many single long keys are broadcast; of more keys, a bit map of as many words.
KEYS = 1_000_000
_BLANK = " \t\n\x0b\x0c\r"


class Rule:
    """How many edits lines of a length allow, and how a band of lengths is cut. edits: one threshold for every length."""

    def __init__(self, edits: int | None = None, near_chars: int = NEAR_CHARS):
        if edits is not None and not 0 <= edits <= MOST_EDITS:
            raise ValueError(f"edits must be between 0 and {MOST_EDITS}, not {edits}")
        self.edits, self.most = edits, MAX_EDITS if edits is None else edits
        # A line of no more characters than edits would be near every other such line.
        self.least = max(near_chars, self.most + 1 if edits is not None else 1, 1)

    def of_band(self, band: Column) -> Column:
        """The threshold of the lines of a band."""
        if self.edits is not None:
            return F.lit(self.edits)
        return F.greatest(F.lit(1), F.least(F.lit(MAX_EDITS), F.floor(band / CHARS_AN_EDIT))).cast("int")

    def allowed(self, length: Column) -> Column:
        """The threshold of a pair whose shorter line has this length."""
        return F.when(length >= self.least, self.of_band(length)).otherwise(F.lit(0))

    @staticmethod
    def band(length: Column) -> Column:
        """The least length of the band that a length is in: bands are a fourth of a power of two wide, and CHARS_AN_EDIT at least."""
        wide = F.char_length(F.bin(length)) - F.lit(3)
        even = (F.floor(length / CHARS_AN_EDIT) * CHARS_AN_EDIT).cast("int")
        return F.when(length < WIDE_FROM, even).otherwise(F.call_function("shiftleft", F.call_function("shiftright", length, wide), wide))

    def shortest(self, band: Column) -> Column:
        """The length of the shortest line of a band that takes part."""
        return F.greatest(band, F.lit(self.least))

    def targets(self, length: Column) -> Column:
        """The bands in which shorter partners, or equally long ones, can be: the line's own, and at times the one below."""
        own = self.band(length)
        below = self.band(own - 1)
        reach = (own > self.least) & (length - (own - 1) <= self.of_band(below))
        return F.when(reach, F.array(own, below)).otherwise(F.array(own))


def _constant(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """Side (0: counted from the start, 1: from the end), place and shift of every substring looked up."""
    first = (edits + 2) // 2
    return [(side, i, shift) for side, n in ((0, first), (1, edits + 1 - first)) for i in range(n) for shift in range(-i, i + 1)]


def _wide(line: Column) -> Column:
    """Four bytes a character: any substring is cut out of it without counting characters."""
    return F.encode(line, "UTF-32")


def _piece(wide: Column, length: Column, side: Column, i: Column, size: Column, shift: Column) -> Column:
    """The i-th piece of a side, shifted."""
    start = F.when(side == 0, i * size).otherwise(length - (i + 1) * size) + shift
    return F.substring(wide, (F.greatest(start, F.lit(0)) * 4 + 1).cast("int"), (size * 4).cast("int"))


def entries(lines: DataFrame, rule: Rule, keep: tuple[str, ...] = ()) -> DataFrame:
    """lines (line, length, h) -> key, h, own and the columns in keep: what each line is filed under (own) and looks up."""
    at = lines.filter(F.col("length") >= rule.least).select("h", *keep, "length", _wide(F.col("line")).alias("wide"), F.explode(rule.targets(F.col("length"))).alias("band"))
    specs = [_constant(_probes(k), ("side", "i", "shift")) for k in ([rule.most] if rule.edits is not None else range(1, MAX_EDITS + 1))]
    edits = rule.of_band(F.col("band"))
    mine = specs[0] if len(specs) == 1 else F.element_at(F.array(*specs), edits)
    # What a line's entries have in common is computed once for each band.
    at = at.withColumn("size", F.floor(rule.shortest(F.col("band")) / (edits + 1)).cast("int")).withColumn("in_own", F.col("band") == rule.band(F.col("length"))).withColumn("p", F.explode(mine))
    text = _piece(F.col("wide"), F.col("length"), F.col("p.side"), F.col("p.i"), F.col("size"), F.col("p.shift"))
    own = (F.col("p.shift") == 0) & F.col("in_own")
    return at.select(F.xxhash64("band", "p.side", "p.i", text).alias("key"), "h", own.alias("own"), *keep)


def fine_pieces(lines: DataFrame, rule: Rule, shifts: bool) -> DataFrame:
    """lines (h, line, length) -> h, key, band, side, i: finer pieces of each line's own band, or, with shifts, all that it looks up."""
    at = lines.withColumn("wide", _wide(F.col("line"))).withColumn("band", F.explode(rule.targets(F.col("length"))) if shifts else rule.band(F.col("length")))
    edits, shortest = rule.of_band(F.col("band")), rule.shortest(F.col("band"))
    n = F.greatest(edits + 1, F.least((edits + 1) * FINER, F.floor(shortest / PIECE_CHARS)))
    at = at.withColumn("edits", edits.cast("int")).withColumn("n", n.cast("int")).withColumn("size", F.floor(shortest / n).cast("int"))
    at = at.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    first = F.ceil(F.col("n") / 2).cast("int")
    at = at.withColumn("side", F.when(F.col("q") < first, 0).otherwise(1)).withColumn("i", F.when(F.col("q") < first, F.col("q")).otherwise(F.col("n") - 1 - F.col("q")))
    most = F.least("i", "edits")
    at = at.withColumn("shift", F.explode(F.sequence(-most, most)) if shifts else F.lit(0))
    text = _piece(F.col("wide"), F.col("length"), F.col("side"), F.col("i"), F.col("size"), F.col("shift"))
    return at.select("h", F.xxhash64("band", "side", "i", F.lit("fine"), text).alias("key"), "edits", "q")


def bit_parallel_distance(a: Column, b: Column, most: int) -> Column:
    """The edit distance of a to b, which is at least as long, if it is at most most; else something larger. Nulls give null.

    A row for each character of a holds the 2 * most + 1 cells next to the diagonal as bits: where the value rises by one
    to the next cell (up), where it falls (down), and how the diagonal of the last cell stands (score). Once that is
    over most, the rest of the rows is passed over.
    """
    width = 2 * most + 1
    if width > 62:
        raise ValueError("the band must fit into a long")
    every = (1 << width) - 1
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    edge = F.array_repeat(F.lit(""), most)

    def row(both: Column, state: Column, i: Column) -> Column:
        x, y, ahead, up, down = both["x"], both["y"], both["ahead"], state["up"], state["down"]
        equal = F.lit(0).cast("long")
        for d in range(width):
            equal = equal.bitwiseOR(F.when(F.get(y, i + d) == F.get(x, i), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
        # A step along the diagonal costs nothing where same has a bit.
        matched = equal.bitwiseOR(down)
        same = (matched.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(matched).bitwiseAND(F.lit(every).cast("long"))
        return F.transform(
            F.array(same),
            lambda s: F.struct(
                s.bitwiseAND(up).bitwiseOR(F.lit(every).cast("long").bitwiseAND(F.bitwise_not(down.bitwiseOR(F.bitwise_not(s.bitwiseOR(up))).bitwiseOR(F.shiftright(s, 1))))).alias("up"),
                F.shiftright(s, 1).bitwiseAND(down.bitwiseOR(F.lit(every).cast("long").bitwiseAND(F.bitwise_not(s.bitwiseOR(up))))).alias("down"),
                (state["score"] + F.lit(1) - F.getbit(s, ahead + most).cast("int")).alias("score"),
            ),
        )[0]

    def whole(both: Column) -> Column:
        start = F.struct(F.lit(every ^ ((1 << most) - 1)).cast("long").alias("up"), F.lit((1 << most) - 1).cast("long").alias("down"), both["ahead"].alias("score"))
        return F.aggregate(F.sequence(F.lit(0), F.size(both["x"]) - 1), start, lambda s, i: F.when(s["score"] > most, s).otherwise(row(both, s, i)), lambda s: s["score"])

    ahead = F.char_length(b) - F.char_length(a)
    # A lambda's argument is computed once; a column within a lambda would be for every element.
    both = F.struct(chars(a).alias("x"), F.concat(edge, chars(b), edge).alias("y"), ahead.alias("ahead"))
    return F.when(ahead > most, F.lit(most + 1)).when(F.char_length(a) == 0, ahead).otherwise(F.transform(F.array(both), whole)[0])


def _common(x: Column, y: Column, side) -> Column:
    """Characters that x and y share at a side (F.left or F.right), x being no longer: by doubling and halving."""
    steps = F.sequence(F.ceil(F.log2(F.char_length(x) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))

    def longer(n: Column, e: Column) -> Column:
        m = n + F.pow(F.lit(2), e).cast("int")
        return F.when((m <= F.char_length(x)) & (side(x, m) == side(y, m)), m).otherwise(n)

    return F.aggregate(steps, F.lit(0), longer)


def near(one: Column, two: Column, rule: Rule) -> Column:
    """Whether two lines are within the threshold of the shorter one.

    First the shorter line is cut into pieces: each that the other doesn't have thereabouts holds an edit of its own. Then what both
    begin and end with is taken off, which leaves the distance as it is, and the rest goes through Spark's own banded edit
    distance (-1 beyond the threshold), which takes about a sixth of the time of bit_parallel_distance.
    """

    def bound(p: Column) -> Column:
        """Whether no more pieces than edits are missing; one that no edit touched has moved by the edits at most."""
        size = F.greatest(F.lit(PIECE_CHARS), F.floor(p["n"] / ((p["most"] + 1) * FINER)).cast("int"))

        def missing(z: Column) -> Column:
            def found(q: Column) -> Column:
                window = F.substring(p["b"], F.greatest(q * z - p["most"], F.lit(0)) + 1, z + 2 * p["most"])
                return F.call_function("instr", window, F.substring(p["a"], q * z + 1, z))

            pieces = F.sequence(F.lit(0), F.floor(p["n"] / z).cast("int") - 1, F.lit(1))
            return F.aggregate(pieces, F.lit(0), lambda n, q: F.when(n > p["most"], n).otherwise(n + F.when(found(q) == 0, 1).otherwise(0)))

        return F.transform(F.array(size), lambda z: F.when(p["n"] < z, True).otherwise(missing(z) <= p["most"]))[0]

    def trimmed(p: Column) -> Column:
        return F.transform(F.array(_common(p["a"], p["b"], F.left)), lambda n: F.struct(F.substring(p["a"], n + 1, F.char_length(p["a"])).alias("a"), F.substring(p["b"], n + 1, F.char_length(p["b"])).alias("b")))[0]

    def ends(p: Column) -> Column:
        return F.transform(F.array(_common(p["a"], p["b"], F.right)), lambda n: F.struct(F.left(p["a"], F.char_length(p["a"]) - n).alias("a"), F.left(p["b"], F.char_length(p["b"]) - n).alias("b")))[0]

    def distance(p: Column) -> Column:
        return F.transform(F.transform(F.transform(F.array(p), trimmed), ends), lambda r: F.levenshtein(r["a"], r["b"], rule.most))[0]

    swap = F.char_length(one) > F.char_length(two)
    shorter, longer = F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)
    pair = F.struct(shorter.alias("a"), longer.alias("b"), rule.allowed(F.least(F.char_length(one), F.char_length(two))).alias("most"), F.least(F.char_length(one), F.char_length(two)).alias("n"))
    return F.transform(F.array(pair), lambda p: F.when(F.char_length(p["b"]) - p["n"] > p["most"], False).when(~bound(p), False).otherwise(distance(p).between(0, p["most"])))[0]


def profile(line: Column) -> list[Column]:
    """length, c0 and c1 of a line: of each count modulo 8, a code of four bits in which neighbours differ by one bit."""
    codes = F.array(*[F.lit(x).cast("long") for x in (0, 1, 3, 7, 15, 14, 12, 8)])
    packed = []
    for k, name in enumerate(_PROFILE[1:]):
        word = F.lit(0).cast("long")
        for i, c in enumerate(COUNTED[16 * k : 16 * k + 16]):
            n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))  # bytes needn't be counted
            n = n if c.isascii() else F.call_function("shiftright", n, F.lit(1))
            word = word.bitwiseOR(F.shiftleft(F.get(codes, n % 8), 4 * i))
        packed.append(word.alias(name))
    return [F.char_length(line).alias("length"), *packed]


def alike(rule: Rule, prefix: str) -> Column:
    """Whether the profile in columns of these names and that in those with a prefix allow two lines to be near.

    An edit takes one character away at most and adds one at most, so it changes two bits at most, and one if it changes the length.
    """
    most, longer = rule.allowed(F.least(F.col("length"), F.col(f"{prefix}length"))), F.abs(F.col("length") - F.col(f"{prefix}length"))
    return (_bits_apart(_PROFILE[1:], prefix) <= 2 * most - longer) & (longer <= most)


def _bits_apart(names: tuple[str, ...], prefix: str) -> Column:
    differ = F.lit(0)
    for c in names:
        differ = differ + F.bit_count(F.col(c).bitwiseXOR(F.col(prefix + c)))
    return differ


def grams(line: Column) -> list[Column]:
    """Parity bits of a line's hashed pairs of neighbouring characters, its last one counted alone."""
    wide = F.struct(_wide(line).alias("wide"), F.char_length(line).alias("n"))
    hashed = F.transform(F.array(wide), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.xxhash64(F.substring(x["wide"], i * 4 + 1, F.lit(8)))))[0]

    def word(k: int, all_of_them: Column) -> Column:
        bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(v, 8).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        return F.aggregate(all_of_them, F.lit(0).cast("long"), lambda bits, v: F.when(F.pmod(v, F.lit(GRAM_WORDS)) == k, bits.bitwiseXOR(bit(v))).otherwise(bits))

    words = F.transform(F.array(hashed), lambda x: F.struct(*[word(k, x).alias(name) for k, name in enumerate(_GRAMS)]))[0]
    return [words[name].alias(name) for name in _GRAMS]


def grams_alike(rule: Rule, prefix: str) -> Column:
    """Whether the parity bits allow two lines to be near; true where one has none.

    An edit takes two pairs of characters away at most and adds two at most, three of both if it changes the length.
    """
    most, longer = rule.allowed(F.least(F.col("length"), F.col(f"{prefix}length"))), F.abs(F.col("length") - F.col(f"{prefix}length"))
    return F.coalesce(_bits_apart(_GRAMS, prefix) <= 4 * most - longer, F.lit(True))


def with_grams(members: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """members (h, n, ...) with the parity bits of those in buckets of more than CROWD lines; null for others."""
    crowd = written(members.filter(F.col("n") > CROWD).select("h").distinct(), f"{name}-crowd")
    if crowd.isEmpty():
        return members.select("*", *[F.lit(None).cast("long").alias(c) for c in _GRAMS])
    bits = written(joined_small(texts.select("h", "line"), crowd, ["h"], "left_semi", KEYS).withColumn("_g", F.struct(*grams(F.col("line")))).select("h", "_g.*"), f"{name}-grams")
    return joined_small(members, bits, ["h"], "left")


def thinned(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose long in the column on may be in keys, a written table of that column: of up to KEYS those that are, of more those that a bit map lets through.

    The bit map has KEYS words, whatever the size of keys; who needs an exact answer joins what is left.
    """
    if keys.count() <= KEYS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    word, bit = F.pmod(F.col(on), F.lit(KEYS)), F.call_function("shiftrightunsigned", F.col(on), F.lit(24)).bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    return rows.join(F.broadcast(bits), word == F.col("_word")).filter(F.getbit("_bits", bit) == 1).drop("_word", "_bits")


def corpus_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The lines that take part: doc_id, th, pos, line (without outer white space), length, h."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    rows = rows.select("doc_id", "th", "pos", F.btrim("raw", F.lit(_BLANK)).alias("line")).withColumn("length", F.char_length("line"))
    return rows.filter(F.col("length") >= max(1, min_chars)).withColumn("h", F.xxhash64("line", "length"))


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule, name: str) -> DataFrame:
    """pairs (h, before) of different lines -> the h that are within the threshold of before."""
    # Pairs are few bytes and much work: they are dealt out evenly.
    pairs = written(pairs.distinct(), f"{name}-pairs")
    # Most texts are in no pair.
    texts = thinned(texts.select("h", "line"), written(pairs.select("h").union(pairs.select("before")).distinct(), f"{name}-ends"), "h")
    pairs = pairs.repartition(shuffle_partitions(pairs.sparkSession), "h", "before")
    both = joined_spread(pairs, texts.select(F.col("h").alias("_h"), F.col("line").alias("one")), "h", "_h", "before", wide="one")
    both = joined_spread(both, texts.select(F.col("h").alias("_b"), F.col("line").alias("two")), "before", "_b", "h", wide="two")
    return written(both.filter(near(F.col("one"), F.col("two"), rule)).select("h").distinct(), f"{name}-near")


def settle(met: DataFrame, order: DataFrame, texts: DataFrame, settled: DataFrame | None, rule: Rule, large: int | None, name: str) -> tuple[list[DataFrame], DataFrame]:
    """met (key, h, own): lines under the keys that they share -> the tables of lines found near an earlier one; keys left open.

    order (_h, first and the profile). First a bucket's members are held against its first line; then, in buckets of at most
    large lines (None: in all), what is still open against the earlier members besides. Only pairs of like profiles are listed.
    """
    placed = written(joined_spread(met.groupBy("key", "h").agg(F.max("own").alias("own")), order, "h", "_h", "key"), f"{name}-placed")
    heads = placed.groupBy("key").agg(F.min(F.struct("first", "h", *_PROFILE)).alias("head"), F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).filter("n > 1 AND any")
    heads = written(heads.select(F.col("key").alias("_key"), F.col("head.h").alias("head"), "n", *[F.col(f"head.{c}").alias(f"_{c}") for c in _PROFILE]), f"{name}-heads")
    members = joined_spread(placed, heads, "key", "_key", "h").withColumn("close", alike(rule, "_")).drop(*[f"_{c}" for c in _PROFILE])
    if settled is not None:
        members = joined_small(members, settled.withColumn("_done", F.lit(True)), ["h"], "left", KEYS)
        members = members.withColumn("open", F.col("_done").isNull()).drop("_done")
    else:
        members = members.withColumn("open", F.lit(True))
    members = written(members, f"{name}-members")
    stars = verified(members.filter("open AND close AND h <> head").select("h", F.col("head").alias("before")), texts, rule, f"{name}-stars")
    members = joined_small(members, stars.withColumn("_near", F.lit(True)), ["h"], "left", KEYS)
    members = members.withColumn("open", F.col("open") & F.col("_near").isNull() & (F.col("h") != F.col("head")))
    left = members.filter("n > 2").select("key", "h", "own", "first", "open", "head", "n", *_PROFILE)
    small = with_grams(left if large is None else left.filter(F.col("n") <= large), texts, name)
    before = small.filter("h <> head").select(F.col("key").alias("_key"), F.col("h").alias("before"), F.col("own").alias("_own"), F.col("first").alias("_first"), *[F.col(c).alias(f"_{c}") for c in _PROFILE + _GRAMS])
    rest = joined_spread(small.filter("open"), before, "key", "_key", "h").filter(alike(rule, "_") & grams_alike(rule, "_") & F.expr("(own AND length <= _length OR _own AND _length <= length) AND _first < first")).select("h", "before")
    others = verified(rest, texts, rule, f"{name}-rest")
    open_keys = left.filter(F.col("n") > (large or 0)).groupBy("key").agg(F.max("open").alias("open")).filter("open").select("key")
    return [stars, others], open_keys


def near_lines(lines: DataFrame, firsts: DataFrame, rule: Rule) -> DataFrame:
    """(h) of the lines within the threshold of a different line that stands before their own first place."""
    looked_up = entries(lines, rule)
    met_keys = looked_up.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("any")).filter("lo <> hi AND any").select("key")
    met_keys = written(met_keys, "met-keys")
    if met_keys.count() <= KEYS:
        # Texts come along where no shuffle follows; a line's rows are neighbours, so the copies pack well.
        hits = written(thinned(entries(lines, rule, ("line",)), met_keys, "key"), "hits")
        met, texts = written(hits.select("key", "h", "own"), "met"), hits.select("h", "line")
    else:
        met = written(thinned(looked_up, met_keys, "key").join(met_keys, "key", "left_semi").select("key", "h", "own").distinct(), "met")
        texts = thinned(lines.select("h", "line"), hashes := written(met.select("h").distinct(), "met-lines"), "h").join(hashes, "h", "left_semi")
    texts = written(texts.groupBy("h").agg(F.min("line").alias("line")).select("h", "line", *profile(F.col("line"))), "texts")
    if met_keys.count() <= KEYS:
        discard(hits)
    order = joined_small(firsts.select("h", "first"), texts.select("h", *_PROFILE), ["h"], "inner", KEYS)
    order = written(order.select(F.col("h").alias("_h"), "first", *_PROFILE), "order")
    found, open_keys = settle(met, order, texts, None, rule, LARGE_BUCKET, "coarse")
    settled = written(found[0].union(found[1]).distinct(), "settled")
    open_keys = written(open_keys, "open-keys")
    if open_keys.isEmpty():
        return settled

    # What is open in large buckets meets again under rare pieces.
    crowd = written(joined_small(met, open_keys, ["key"], "left_semi", KEYS).select("h").distinct(), "crowd")
    crowd = written(joined_small(texts.select("h", "line", "length"), crowd, ["h"], "left_semi", KEYS), "crowd-texts")
    own = fine_pieces(crowd, rule, False)
    counts = written(own.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "piece-counts")
    own = joined_spread(own, counts.withColumnRenamed("key", "_key"), "key", "_key", "h")
    # A line has (edits + 1) * FINER pieces at most.
    own = own.groupBy("h", "edits").agg(F.array_sort(F.collect_list(F.struct("times", "q", "key"))).alias("pieces"))
    own = own.select("h", F.explode(F.slice("pieces", F.lit(1), F.col("edits") + 1)).alias("p")).select(F.col("p.key").alias("key"), "h", F.lit(True).alias("own"))
    own = written(own, "rare")
    rare = written(own.select("key").distinct(), "rare-keys")
    asked = joined_small(fine_pieces(crowd, rule, True).select("key", "h", F.lit(False).alias("own")), rare, ["key"], "left_semi", KEYS)
    again, _ = settle(written(own.union(asked).distinct(), "crowd-met"), order, texts, settled, rule, None, "fine")
    return settled.union(again[0]).union(again[1]).distinct()


def dedup_lines(docs: DataFrame, edits: int | None = None, min_chars: int = 1, near_chars: int = NEAR_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> doc_id, text, n_lines, n_repeated, n_near, n_left and the columns named in keep, one row a document.

    Lines of at least min_chars characters, without outer white space, are compared; blank ones are left alone. A line
    goes (n_repeated) if it equals one before it in the corpus, or else (n_near) if a line within the threshold stands
    before the first of its own kind. Lines of fewer than near_chars characters, and with edits given those of no more characters
    than edits, only go if they equal another. edits: one threshold for all; None: as many as allowed for the lengths.
    Documents are in order of doc_id, then of a hash of the text; n_left counts the lines left that aren't blank.
    Lines count as equal if a 64-bit hash and their lengths are.
    Nulls: a null text stays null, without lines; null doc_ids come last. Ties: rows alike in doc_id and text count as one
    document, and none of them loses lines to another. Very long texts and lines are compared whole; a line must fit in a
    task's memory some ten times. An empty table gives none. Columns not in keep are not read.
    """
    lines, rule = corpus_lines(docs, min_chars), Rule(edits, near_chars)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th", "pos")
    # Texts are split and hashed once for all that asks only where a line stands.
    places = written(lines.select("doc_id", "th", "pos", "h"), "places")
    firsts = written(places.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")), "firsts")
    if rule.most:
        later = written(near_lines(lines, firsts, rule), "later")
        firsts = joined_small(firsts, later.withColumn("near", F.lit(True)), ["h"], "left", KEYS)
    else:
        firsts = firsts.withColumn("near", F.lit(False))
    # Only lines of two places or more, or near an earlier one, lose anything.
    some = written(firsts.filter("first <> last OR near").select(F.col("h").alias("_h"), "first", F.coalesce("near", F.lit(False)).alias("near"), "n"), "some")
    slim = thinned(places, some.select(F.col("_h").alias("h")), "h")
    gone = joined_spread(slim, some, "h", "_h", place, counted="n").withColumn("again", place != F.col("first")).filter("again OR near")
    # A document's own lines only are gathered here.
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "again")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "gone")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("th"), *keep)
    gone = written(gone, "gone")
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= KEYS:
        gone = F.broadcast(gone)
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    all_lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.transform("gone", lambda g: g["pos"]))
    out = out.withColumn("_lines", all_lines)
    out = out.withColumn("_kept", F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(F.transform(kept, lambda i: F.get("_lines", i))))
    size = F.coalesce(F.cardinality("gone"), F.lit(0))
    again = F.coalesce(F.cardinality(F.filter("gone", lambda g: g["again"])), F.lit(0))
    return out.select(
        "doc_id", F.when(size > 0, F.array_join("_kept", "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.cardinality("_lines")), F.lit(0)).cast("long").alias("n_lines"), again.cast("long").alias("n_repeated"), (size - again).cast("long").alias("n_near"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.cardinality(F.filter("_kept", lambda x: F.btrim(x, F.lit(_BLANK)) != ""))), F.lit(0)).cast("long").alias("n_left"), *keep,
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
