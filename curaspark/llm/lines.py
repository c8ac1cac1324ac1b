"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is a \\n-separated piece of a text; its words are those between blanks, in lower case, and in scripts without
blanks (``_UNSPACED``) every character. A line goes if an earlier one (by doc_id, text hash, line number; null doc_ids
last) has the same words; one of at least ``min_words`` also if an earlier one lies within one word edit: a word replaced,
inserted or deleted. Empty lines all stay.

1. Equal lines are grouped by two hashes of 64 bits (aggregated before the shuffle).
2. Two lines within one edit agree in the first or the second half of the shorter one, so a line that shares no half
   with another distinct line has no partner; only the others go on. This loses no pair.
3. Those emit all their variants: the line itself and every one-word deletion, hashed twice. Hashes are exclusive ors of
   position-wise word hashes, so running ones over the exploded words give all variants of a line in linear time.
4. Equal variants are joined: of lines that agree but for the word at one place, each meets the earliest only; a line
   meets the earliest of the lines that have one word more, and those meet it. The edit distance is verified on the words.

Joins whose key may be hot (a very common line, a template of which one word changes) stand between two plain exchanges,
so that adaptive execution can split a large partition.

Defined results: null and empty texts stay as they are; a text that loses all its lines is empty; repeated rows of one
doc_id and text are one document and get the same text; an empty table gives no rows; columns named text or n_lines_dropped
are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

_BLANKS = "[ \\t\\x0B\\f\\r]+"
_UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"


def _unspaced(text: Column) -> Column:
    """Whether a text has characters of a script without blanks; all lie above the first 0xE00 code points, and a text of
    ASCII, known by its length in bytes, is not searched."""
    return (F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit("[^\\x00-\\u0DFF]")) & F.rlike(text, F.lit(_UNSPACED))


def normal(text: Column, unspaced: Column) -> Column:
    """A text in lower case, the words of each of its lines apart by one space; the regular expressions run only over
    texts that hold other blanks than single spaces between words."""
    low = F.when(unspaced, F.regexp_replace(F.lower(text), f"({_UNSPACED})", " $1 ")).otherwise(F.lower(text))
    odd = unspaced | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for mark in ("\t", "\x0b", "\f", "\r", "  ", " \n", "\n "):
        odd = odd | F.contains(text, F.lit(mark))
    plain = F.regexp_replace(F.regexp_replace(low, _BLANKS, " "), " ?\n ?", "\n")
    return F.when(odd, F.trim(plain)).otherwise(low)


def _half_keys(norm: Column, n: Column) -> list[Column]:
    """Hashes of the first and the last half, cut as for lines of n and of n - 1 words."""
    keys = []
    for length in (n, n - 1):
        m = F.floor(length / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), length, F.call_function("substring_index", norm, F.lit(" "), m)))
        keys.append(F.xxhash64(F.lit("last"), length, F.call_function("substring_index", norm, F.lit(" "), (m - length).cast("int"))))
    return keys


def _position() -> Column:
    return F.struct(F.col("__id").isNull().alias("lost"), F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("pos").alias("pos"))


def _lines(docs: DataFrame) -> DataFrame:
    """__id, __th, pos, norm, n (words), h and g (hashes of norm) of every line that is not empty."""
    base = docs.select(F.col("doc_id").cast("long").alias("__id"), "text", _unspaced(F.col("text")).alias("__unspaced"))
    base = base.select("__id", F.xxhash64("text").alias("__th"), normal(F.col("text"), F.col("__unspaced")).alias("__text"))
    rows = base.select("__id", "__th", F.posexplode(F.split("__text", "\n")).alias("pos", "norm")).filter("norm <> ''")
    n = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return rows.withColumns({"n": n, "h": F.xxhash64("norm"), "g": F.xxhash64(F.lit(1), "norm")})


def _variants(lines: DataFrame) -> DataFrame:
    """line, n, at (deleted word, 0 for none), y and z (hashes of what is left), for every line (line, n, norm)."""
    w = lines.select("line", "n", F.posexplode(F.split("norm", " ")).alias("i", "w"))
    seeds = {"y": (), "z": (F.lit(1),)}
    hashes = {f"{k}{m}": F.xxhash64(*seed, "w", (F.col("i") - m).cast("long")) for k, seed in seeds.items() for m in (0, 1)}  # at its place, and one before
    w = w.select("line", "n", "i", *[c.alias(k) for k, c in hashes.items()])
    whole = W.partitionBy("line")
    up_to = whole.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    sums = {f"{k}_{what}": F.bit_xor(k).over(window) for k in hashes for what, window in (("up", up_to), ("all", whole))}
    s = w.select("line", "n", "i", "y0", "z0", *[c.alias(k) for k, c in sums.items()])

    def gone(k: str) -> Column:  # the words before in place, those behind one place earlier
        return F.col(f"{k}0_up").bitwiseXOR(F.col(f"{k}0")).bitwiseXOR(F.col(f"{k}1_all")).bitwiseXOR(F.col(f"{k}1_up")).alias(k)

    one = F.struct((F.col("i") + 1).alias("at"), gone("y"), gone("z"))
    none = F.struct(F.lit(0).alias("at"), F.col("y0_all").alias("y"), F.col("z0_all").alias("z"))
    return s.select("line", "n", F.explode(F.when(F.col("i") == 0, F.array(none, one)).otherwise(F.array(one))).alias("v")).select("line", "n", "v.at", "v.y", "v.z")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether word lists a and b differ by one replaced, inserted or deleted word at most: the words that they share
    at the start and at the end cover all but one word of the longer."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def run(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(F.slice(x, F.lit(1), short), F.slice(y, F.lit(1), short), lambda p, q: p != q), True)
        return F.when(first == 0, short.cast("long")).otherwise(first - 1)

    return (long - short <= 1) & (run(a, b) + run(F.reverse(a), F.reverse(b)) >= long - 1)


def dropped_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """__id, __th, gone: the numbers (from 0) of the lines to drop, for every document that loses any."""
    lines = _lines(docs)
    keys = {f"k{i}": F.when(F.col("n") >= min_words, k) for i, k in enumerate(_half_keys(F.col("norm"), F.col("n")))}
    rows = common.stash(lines.select("__id", "__th", "pos", "h", "g", *[k.alias(c) for c, k in keys.items()]), "lines")
    half = rows.filter("k0 is not null").select("h", *keys).distinct().select("h", F.explode(F.array(*keys)).alias("key"))
    shared = half.groupBy("key").agg(F.min("h").alias("p"), F.max("h").alias("q")).filter("p < q").select("key")
    partners = common.cut(half.join(shared, "key").select("h").distinct())
    texts = common.mark(lines.filter(F.col("n") >= min_words), F.col("h"), partners, "h", "__may").filter("__may")
    texts = texts.groupBy("h", "g", "n").agg(F.min(_position()).alias("first"), F.min("norm").alias("norm"))
    some = common.cut(texts.join(partners, "h", "left_semi").withColumn("line", F.monotonically_increasing_id()))
    v = common.cut(_variants(some).join(some.select("line", "first"), "line"))
    gone = v.filter("at > 0")
    # one word replaced: same place, same rest; each meets the earliest
    key = ["y", "z", "at", "n"]
    earliest = gone.groupBy(key).agg(F.min(F.struct("first", "line")).alias("m"), F.count("*").alias("c"))
    replaced = common.cut(earliest.filter("c > 1").select(*key, F.col("m.line").alias("other")))
    pairs = gone.join(replaced, key).filter("line <> other").select("line", "other")
    # one word more or less: the shorter line is a variant of the longer
    plain = v.filter("at = 0").select("y", "z", F.col("n").alias("short"), F.col("line").alias("other"), F.col("first").alias("other_first"))
    more = gone.withColumn("short", F.col("n") - 1).join(plain, ["y", "z", "short"])
    longer = more.groupBy("other", "other_first").agg(F.min(F.struct("first", "line")).alias("m"))
    pairs = pairs.unionByName(more.filter("other_first < first").select("line", "other")).unionByName(longer.filter("m.first < other_first").select(F.col("other").alias("line"), F.col("m.line").alias("other"))).distinct()
    words = some.select("line", F.split("norm", " ").alias("words"))
    checked = pairs.join(words, "line").join(words.select(F.col("line").alias("other"), F.col("words").alias("others")), "other").filter(_one_edit(F.col("words"), F.col("others")))
    near = checked.select("line").distinct().join(some.select("line", "h", "g"), "line").select("h", "g", F.lit(True).alias("near"))
    # exact repetitions of each line besides its first, and all occurrences of lines that are near an earlier one
    short_rows = rows.select("__id", "__th", "pos", "h", "g")
    counts = short_rows.groupBy("h", "g").agg(F.min(_position()).alias("first"), F.max(_position()).alias("last"))
    fate = common.cut(counts.join(near, ["h", "g"], "left").filter("near or first < last").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")))
    common.drop(partners, some, v, replaced)
    out = short_rows.join(fate, ["h", "g"]).filter(F.col("near") | (_position() > F.col("first")))
    return out.groupBy("__id", "__th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """docs with the text of each document less the lines that an earlier line makes redundant, and n_lines_dropped."""
    before = common.written()
    gone = common.cut(dropped_lines(docs, min_words).select(F.col("__id").alias("__d"), F.col("__th").alias("__t"), F.col("gone").alias("__gone")))
    common.clean(docs.sparkSession, but=before | common.files(gone))
    keyed = common.mark(docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64("text")}), F.col("__th"), gone, "__t", "__may")
    both = keyed.filter("__may").join(gone, F.col("__id").eqNullSafe(F.col("__d")) & F.col("__th").eqNullSafe(F.col("__t")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    edited = common.replace_columns(both, {"text": text, "n_lines_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
    same = common.replace_columns(keyed.filter("not __may"), {"text": F.col("text"), "n_lines_dropped": F.lit(0).cast("long")})
    return edited.drop("__id", "__th", "__may", "__d", "__t", "__gone").unionByName(same.drop("__id", "__th", "__may"))
