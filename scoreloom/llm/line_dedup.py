"""Line dedup by an exact set-similarity join of lines, with DataFrame functions only.

A line is the set of its lower-case words. A line goes if an earlier one (by doc_id, then text, then line number) has
a Jaccard similarity of ``SIMILAR`` or more with it; equal sets have 1. Every line that isn't blank takes part, whatever its
length; blank lines always stay. A line without blanks is one word.

1. Lines whose sorted distinct words are equal (128 bits of hash) are one set with its earliest
   line; copies cost nothing further on. Parts are sums over rows of words, made where the set is. Sets of fewer than ``JOINED`` words are similar to none but their equals, so they need no more; four
   words and those with one more have 0.8. Sets are numbered in the order of their earliest lines, so the smaller number is the earlier one.
2. Two similar sets of n and m words differ in at most d words, a ninth of n + m. The range of hashes is cut into more than d equal parts, four times two to the
   power of g in the group g: sizes up to ``FEW`` times that. Each word that only one set has spoils one part, so of a set's parts that hold words all but d are the same
   in both, word for word. Hence both have one of them among their d + 1 strongest (of most letters, which are the rarest), two among one more,
   and so on: sets meet by the hash of a strong part. A set takes part in the group of its size, and in the one below if it may be similar to a set of that.
3. Sets of up to ``FEW`` words, those as near to them, and the rare ones whose words fall into too few parts meet by two words instead: they share two of the first
   ``n - ceil(t n) + 2`` of each by length and hash, three among one more, and so on.
4. Most of these keys belong to one set only and go at once; of those left, a key of more than ``HOT`` sets doesn't do alone, but together with each
   part (or word) that follows it in the set, as there is a second (third) one in common, if an undecided set meets an earlier one by them. So no list grows with
   the whole corpus unless its sets share several parts.
5. The sizes may differ by the factor t at most; a parity sketch of 128 bits bounds the symmetric difference from below. What passes is compared word by word.
   First each set meets all earlier ones of its keys but for those of more than ``HOT`` sets, of which the ``EARLIEST`` and ``NEAREST`` preceding ones do, and is compared with the ``CLOSEST`` of all these by
   sketch: nearly all of a group of near copies is decided there. Then undecided sets meet all earlier ones.

Rows equal in doc_id and text are decided alike. A document that loses all its lines goes, one that had no lines to lose (null or empty
text) stays; n_chars, if there, follows the text. Null doc_ids come last; ties in doc_id and text are repeated rows. Texts of any length
are read whole, and only keys of words are shuffled for the join. Other columns stay, whatever their names, but for n_lines and n_removed, which
are set anew. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions.lookup import let
from scoreloom.llm.common import discard, lean_shuffles, spare, table, written

SIMILAR = 0.8
LEAST = 1
JOINED = math.ceil(SIMILAR / (1 - SIMILAR) - 1e-9)
FEW = 9  # words of sets that meet by two words
HOT = 24  # sets of a key that does alone
EARLIEST = 8
NEAREST = 4
CLOSEST = 4
LENGTH = 63  # a longer word counts as one of so many bytes
BLANKS = r"[ \t\n\x0B\f\r]+"


def words_of(line: Column) -> Column:
    """64-bit hashes of the distinct lower-case words of a line, between blanks."""
    plain = F.when(line.rlike("[\t\x0B\f\r]"), F.regexp_replace(line, BLANKS, " ")).otherwise(line)
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(plain), " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\n\x0B\f\r]")


def _spelt(line: Column, odd: Column) -> Column:
    """The distinct lower-case words of a line, sorted, with a blank between: equal for equal sets. odd: whether there may be blanks of other kinds."""
    plain = F.when(odd, F.regexp_replace(line, BLANKS, " ")).otherwise(line)
    return F.array_join(F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower(plain), " "), ""))), " ")


def _right(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


SKETCH = ["s0", "s1"]


def _sketch(word: Column) -> list[Column]:
    """Parity of the words' hashes in two times 64 places: each bit that differs between two sets stands for a word that only one of them has."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(word, 1).bitwiseAND(F.lit(63)).cast("int"))
    return [F.bit_xor(F.when(word.bitwiseAND(F.lit(1)) == q, bit).otherwise(F.lit(0).cast("long"))).alias(s) for q, s in enumerate(SKETCH)]


def _differing(x, y) -> Column:
    """Number of bits that differ between two sketches."""
    return reduce(lambda a, b: a + b, [F.bit_count(x(s).bitwiseXOR(y(s))) for s in SKETCH])


def _most_different(n: Column, m: Column) -> Column:
    """Words that only one of two similar sets has, at most; grows with n and m."""
    return F.floor((n + m) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-9).cast("int")


def _least_overlap(n: Column, m: Column) -> Column:
    """ceil(t / (1 + t) * (n + m)) with t = SIMILAR."""
    return F.ceil((n + m) * (SIMILAR / (1 + SIMILAR)) - 1e-9)


def _passes(x, y) -> Column:
    """Length and sketch filters of two sets."""
    need = _least_overlap(x("n"), y("n"))
    return (F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * SIMILAR - 1e-9) & (_differing(x, y) <= x("n") + y("n") - 2 * need)


def _keyed_text(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _group(n: Column) -> Column:
    """The smallest g for which a set of n words has at most ``FEW`` times two to the power of g."""
    return F.when(n <= FEW, 0).otherwise(F.length(F.bin(F.floor((n - 1) / FEW).cast("long"))))


def _largest(g: Column) -> Column:
    return F.call_function("shiftleft", F.lit(FEW), g)


def _smallest_similar(n: Column) -> Column:
    return F.ceil(n * SIMILAR - 1e-9).cast("int")


def _strong(n: Column, below: bool) -> Column:
    """How many of a set's strongest parts meet others in its own group, or in the one below, where it is the larger one of a pair."""
    return 1 + (_most_different(n, _largest(_group(n) - 1)) if below else _most_different(n, F.floor(n / SIMILAR + 1e-9)))


def _marked(letters: Column, words: Column, g: Column) -> Column:
    """What a part meets others by: its letters in the upper bits, then a hash of its words, which are summed by exclusive or; null if it has none."""
    return F.when(letters > 0, F.shiftleft(F.least(letters, F.lit((1 << 14) - 1)), 49).bitwiseOR(F.shiftrightunsigned(F.xxhash64(words, g), 15)))


def _longest(words: Column, most: Column) -> Column:
    """The longest words as hashes with their length in the upper bits, longest first."""
    of = lambda w: F.shiftleft(F.least(F.octet_length(w), F.lit(LENGTH)).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 7))
    return F.slice(F.sort_array(F.transform(words, of), False), F.lit(1), most)


def _meeting(found: DataFrame) -> DataFrame:
    """Rows (i, j, at, spelt), one a set and dealt by i and j, with what a set meets others by: its strongest parts in its own group and the one
    below, or its longest words, in each case one more than needed. Parts are summed over rows of words where they are, in compiled code: of the
    four times two to the power of g parts of the hashes, two that are one in the group below are summed side by side."""
    none, n, g, split = F.array().cast("array<bigint>"), F.col("n"), F.col("g"), F.col("split")
    out = found.select("i", "j", "at.*", F.split("spelt", " ").alias("split")).withColumn("n", F.size("split")).withColumn("g", _group(n))
    out = out.withColumn("lower", (g > 1) & (_smallest_similar(n) <= _largest(g - 1)))
    out = out.withColumn("parts", F.array_distinct(F.transform("split", lambda w: _right(F.xxhash64(w), 62 - g))))
    halves = F.size(F.array_distinct(F.transform("parts", lambda p: F.shiftright(p, 1))))
    lacks = (F.size("parts") < _strong(n, False) + 1) | (F.col("lower") & (halves < _strong(n, True) + 1))
    wanted = (n >= JOINED) & ((_smallest_similar(n) <= FEW) | lacks)
    out = out.withColumn("words", F.when(wanted, _longest(split, n - _smallest_similar(n) + 3)).otherwise(none))
    of = ["i", "j", "z", "doc_id", "h", "line_no", "n", "g", "lower", "words"]
    each = out.select(*of, F.explode("split").alias("w")).select(*of, F.xxhash64("w").alias("x"), F.octet_length("w").alias("letters"))
    left, x = _right(F.col("x"), 62 - g).bitwiseAND(F.lit(1)) == 0, F.col("x")
    sums = [f(F.when(c, v)).alias(a) for c, k in ((left, "a"), (~left, "b")) for f, v, a in ((F.bit_xor, x, f"x{k}"), (F.sum, F.col("letters"), f"l{k}"))]
    two = each.groupBy(*of, F.when(n > FEW, _right(x, 63 - g)).otherwise(0).alias("half")).agg(*sums, *_sketch(x))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = _marked(zero(F.col("la")) + zero(F.col("lb")), zero(F.col("xa")).bitwiseXOR(zero(F.col("xb"))), g - 1)
    lists = {"a": F.when(n > FEW, _marked(F.col("la"), F.col("xa"), g)), "b": F.when(n > FEW, _marked(F.col("lb"), F.col("xb"), g)), "c": F.when(F.col("lower"), both)}
    two = two.select(*of, *SKETCH, *[v.alias(k) for k, v in lists.items()])
    out = two.groupBy(*of).agg(*[F.collect_list(k).alias(k) for k in lists], *[F.bit_xor(s).alias(s) for s in SKETCH])
    strongest = lambda c, below: F.slice(F.sort_array(c, False), F.lit(1), _strong(n, below) + 1)
    at = F.struct("z", "doc_id", "h", "line_no").alias("at")
    return out.select(at, "n", *SKETCH, strongest(F.concat("a", "b"), False).alias("own"), F.when(F.col("lower"), strongest(F.col("c"), True)).otherwise(none).alias("below"), "words")


def _sets(docs: DataFrame) -> DataFrame:
    """One row per distinct word set: id in the order of at (its earliest line), n, sketch and what it meets others by."""
    # What holds for a text is found before there are lines, else it is found again for each of them.
    odd = F.lit(False)
    for blank in "\t\x0b\f\r":
        odd = odd | F.contains("text", F.lit(blank))
    texts = docs.where("text <> ''").select("doc_id", _keyed_text().alias("h"), odd.alias("odd"), F.split("text", "\n").alias("lines"))
    lines = texts.select("doc_id", "h", "odd", F.posexplode("lines").alias("line_no", "line"))
    at = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", "line_no").alias("at")
    spelt = lines.where(~is_blank(F.col("line"))).select(at, _spelt(F.col("line"), F.col("odd")).alias("spelt"))
    first = spelt.groupBy(F.xxhash64("spelt").alias("i"), F.xxhash64(F.lit(1), "spelt").alias("j")).agg(F.min(F.struct("at", "spelt")).alias("s"))
    found = written(_meeting(first.select("i", "j", "s.*")))
    sets = written(found.repartitionByRange("at").sortWithinPartitions("at").select(F.monotonically_increasing_id().alias("id"), "*"))
    discard(found)
    return sets


def _entries(sets: DataFrame) -> DataFrame:
    """A row (id, key, kind, pos) for every part or two words by which a set meets others; pos is the place of the last one of them."""
    entry = lambda key, kind, pos: F.struct(key.alias("key"), F.lit(kind).alias("kind"), pos.alias("pos"))
    parts = lambda c, kind, most: sets.where(F.size(c) > 0).select("id", F.lit(kind).alias("kind"), F.posexplode(F.slice(c, F.lit(1), most)).alias("pos", "key")).select("id", "key", "kind", "pos")
    first = F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))
    two = F.flatten(F.transform(first, lambda y, j: F.transform(F.slice("words", F.lit(1), j), lambda x: entry(F.xxhash64(x, y), 2, j))))
    return parts("own", 0, _strong(F.col("n"), False)).union(parts("below", 1, _strong(F.col("n"), True))).union(sets.where(F.size("words") > 0).select("id", F.inline(two)))


def _shared(sets: DataFrame) -> DataFrame:
    """The entries whose key is not one set's alone, with the size and sketch of the set and the number of entries of the key."""
    by = Window.partitionBy("key")
    some = _entries(sets).withColumn("many", F.count(F.lit(1)).over(by)).where("many > 1")
    return written(some.join(sets.select("id", "n", *SKETCH), "id"))


def _of(t: str):
    return lambda c: F.col(f"{t}.{c}")


def _pairs(x: DataFrame, y: DataFrame, also: Column | None = None) -> DataFrame:
    """Pairs (a, b) of set ids, a earlier, with a key in common that pass the filters, and by how much they differ at least."""
    x, y = x.alias("x"), y.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _passes(_of("x"), _of("y"))
    both = x.join(y, meet if also is None else meet & also)
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), _differing(_of("x"), _of("y")).alias("far")).distinct()


def _first_common() -> Column:
    """Whether the key is made of the first that two sets share, so that a pair of near copies meets once and not by every two of their parts."""
    common = F.array_intersect("x.of", "y.of")
    two = F.when(F.col("x.kind") < 2, F.get(common, F.lit(0))).otherwise(F.xxhash64(F.get(common, F.lit(0)), F.get(common, F.lit(1))))
    return F.col("x.key") == F.xxhash64(two, F.get(common, F.when(F.col("x.kind") < 2, 1).otherwise(2)))


def _leaders(hot: DataFrame) -> DataFrame:
    """For each set b the closest, x, by sketch, of the ``EARLIEST`` sets of each of its keys and the ``NEAREST`` preceding ones."""
    by = Window.partitionBy("key").orderBy("id")
    own, before = F.struct("id", "n", *SKETCH), by.rowsBetween(Window.unboundedPreceding, 0)
    some = {f"e{k}": F.nth_value(own, k).over(before) for k in range(1, EARLIEST + 1)} | {f"l{k}": F.lag(own, k).over(by) for k in range(1, NEAREST + 1)}
    found = [F.when((F.col(f"{e}.id") < F.col("id")) & _passes(_of(e), F.col), F.struct(_differing(_of(e), F.col).alias("far"), F.col(f"{e}.id").alias("a"))) for e in some]
    return hot.withColumns(some).select(F.col("id").alias("b"), F.array_min(F.array(*found)).alias("x")).where("x is not null")


def _followed(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Entries of keys together with each part or word that follows, of those keys by which a set that isn't decided meets an earlier one."""
    of, by = F.when(F.col("kind") == 0, F.col("own")).when(F.col("kind") == 1, F.col("below")).otherwise(F.col("words")), Window.partitionBy("key")
    each = hot.join(sets.select("id", "own", "below", "words"), "id").select("id", "kind", "decided", "key", F.explode(F.slice(of, F.col("pos") + 2, F.size(of))).alias("x"))
    each = each.select("id", "kind", "decided", F.xxhash64("key", "x").alias("key"))
    met = {"first": F.min("id").over(by), "last": F.max(F.when(~F.col("decided"), F.col("id"))).over(by)}
    some = written(each.withColumns(met).where("last > first").drop(*met))
    out = written(some.join(sets.select("id", "n", *SKETCH, "own", "below", "words"), "id").select("id", "n", *SKETCH, "kind", of.alias("of"), "key", "decided"))
    discard(some)
    return out


def _later(parts: list[DataFrame], sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set ids, a earlier, compared word by word, the b that are similar."""
    pairs = written(reduce(DataFrame.union, parts).distinct())
    discard(*parts)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    places = written(sets.select("id", "at").join(wanted, "id"))
    by_text = places.groupBy(F.col("at.doc_id").alias("d"), F.col("at.h").alias("h")).agg(F.collect_list(F.struct("id", "at.line_no")).alias("all"))
    read = docs.select("doc_id", "text", _keyed_text().alias("key")).join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h")))
    split = F.split("text", "\n")
    lines = read.select(F.explode(F.transform("all", lambda x: F.struct(x["id"].alias("id"), F.get(split, x["line_no"]).alias("line")))).alias("x"))
    lines = written(lines.select("x.id", words_of(F.col("x.line")).alias("words")))
    two = pairs.join(lines.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    two = two.join(lines.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    two = two.where(F.size(F.array_intersect("wa", "wb")) >= _least_overlap(F.size("wa"), F.size("wb")))
    out = written(two.select(F.col("b").alias("id")).distinct())
    discard(pairs, places, lines)
    return out


def earliest(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no) of the lines with words that stay; h is the text's MD5."""
    sets = _sets(docs)
    shared = _shared(sets)
    cold, hot = shared.where(F.col("many") <= HOT), shared.where(F.col("many") > HOT)
    near = written(_pairs(cold, cold))
    best = near.select("b", F.struct("far", "a").alias("x")).union(_leaders(hot))
    closest = F.slice(F.sort_array(F.collect_set("x")), 1, CLOSEST)  # of few, as every key gives a bounded number
    best = written(best.groupBy("b").agg(closest.alias("x")).select(F.explode("x.a").alias("a"), "b"))
    hot = written(hot.select("id", "key", "kind", "pos"))
    discard(shared)
    gone = _later([best], sets, docs)
    decided = sets.select("id").join(gone.withColumn("gone", F.lit(True)), "id", "left").select("id", F.col("gone").isNotNull().alias("decided"))  # a set once, not once a key
    lists = _followed(hot.join(decided, "id"), sets)
    discard(hot)
    parts = [written(_pairs(lists, lists.where(~F.col("decided")), _first_common()).select("a", "b")), written(near.select("a", F.col("b").alias("id")).join(gone, "id", "left_anti").select("a", F.col("id").alias("b")))]
    discard(lists, near)
    more = _later(parts, sets, docs)
    stay = written(sets.select("id", "at").join(gone, "id", "left_anti").join(more, "id", "left_anti").select("at.doc_id", "at.h", "at.line_no"))
    discard(sets, gone, more)
    return stay


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later matches removed from their texts; adds n_lines and n_removed."""
    keep = docs.drop("n_lines", "n_removed")
    id_, h, key, kept, stays, text = spare(keep, "id", "h", "key", "kept", "stays", "text")
    with lean_shuffles(docs.sparkSession):
        stay = earliest(docs.select("doc_id", "text"))
        left_in = written(stay.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.collect_set("line_no").alias(kept)))
        discard(stay)
    all_ = keep.withColumn(key, _keyed_text()).join(left_in, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(h)), "left")
    lines = F.split("text", "\n")
    all_ = all_.withColumn(stays, F.when(F.length("text") > 0, F.filter(lines, lambda line, i: F.array_contains(F.coalesce(kept, F.array().cast("array<int>")), i) | is_blank(line))))
    left = F.when(F.size(stays) == F.size(lines), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = all_.withColumns({
        "n_lines": F.when(F.length("text") > 0, F.size(lines)).otherwise(0),
        "n_removed": F.when(F.length("text") > 0, F.size(lines) - F.size(stays)).otherwise(0),
        text: F.when(F.length("text") > 0, left).otherwise(F.col("text")),
    })
    out = out.select(*[F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in keep.columns], "n_lines", "n_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in keep.columns else out


def emptied() -> Column:
    """Whether a document lost all that it said."""
    return (F.col("n_removed") > 0) & (F.trim(F.col("text")) == "")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
