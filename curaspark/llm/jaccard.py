"""N-gram Jaccard join by prefix trees.

A document's set is the 64-bit hashes of its distinct word n-grams; documents of one set are one node. Steps, each exact:

1. A node can only have links if at most ``n - ceil(t n)`` of its n-grams stand in no other node. That is tested on its
   n-grams whose hash lies below one threshold for all nodes, ``sketch`` of the range, so that an n-gram is looked at in
   all nodes that hold it or in none: two aggregations count, for each node, the n-grams that nobody else has.
2. The full sets of the nodes left are put in one global order, rare n-grams first (document frequency, then hash).
   Nodes that share an n-gram of their prefixes may link; components of that relation are the candidate groups.
3. Candidate groups are cut into blocks of bounded size, ordered by set size. A block's sets stand in a trie; each set
   is sent through it, partial overlaps are shared by all sets below a trie node, and a subtree is left as soon as its
   remaining length cannot reach the needed overlap, or all its sets are known to be connected to the probe.
4. What a block has connected counts as one afterwards: first representatives of all blocks are joined, then only those
   pairs of blocks in which sets that are not connected yet share an n-gram of their prefixes and fit in size; and of
   these blocks only such sets.

Joins whose key may be hot (copies of one text, an n-gram that all documents have) stand between two plain exchanges, so
that adaptive execution can split a large partition.

Defined results: a text without words (or null) has the empty set and links with nothing; fewer words than ``size`` make
one n-gram of all; repeated rows share their set and so their component; rows with null doc_id link but never name
a component unless no other row can; an empty table gives no rows; other columns are not read. keep_one returns the columns
of docs; of rows that repeat doc_id and text one is kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Sets, and n-grams of all sets, in a block.
BLOCK, BLOCK_GRAMS = 512, 400_000


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes (int64) of each text."""
    out = []
    for a, b in common.slices(texts):
        w = common.Words(texts[a:b], lower=True)
        h, first = w.windows(size)
        bounds = np.searchsorted(w.doc[first], np.arange(b - a + 1)) if len(first) else np.zeros(b - a + 1, int)
        n = np.diff(w.bounds)
        for i in range(b - a):
            if n[i] >= size:
                s = np.unique(h[bounds[i] : bounds[i + 1]].view(np.int64))
            elif n[i]:
                own = np.uint64(n[i])
                for x in w.hash[w.bounds[i] : w.bounds[i + 1]].tolist():
                    own = common.mix64(np.array([(int(own) * 31 + x) % (1 << 64)], np.uint64))[0]
                s = np.array([own], np.uint64).view(np.int64)
            else:
                s = np.zeros(0, np.int64)
            out.append(s)
    return out


def set_key(s: np.ndarray) -> int:
    """64-bit name of a set; two different sets of a corpus share one with a chance of 2**-64 a pair."""
    if not len(s):
        return 0
    u = s.view(np.uint64)
    both = np.array([int(u.sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 % (1 << 64)), int(np.bitwise_xor.reduce(common.mix64(u)))], np.uint64)
    return int(common.mix64(common.mix64(both[:1]) + both[1:]).view(np.int64)[0])


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def _threshold(sketch: float) -> int:
    """The hash that so large a share of all hashes lies below."""
    return min(int(sketch * 2.0**64), (1 << 64) - 1) - (1 << 63)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))


def _sets(docs: DataFrame, size: int, keep) -> DataFrame:
    """doc_id, th, node, n and what keep(set) takes of the set."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in common.leanly(batches):
            sets = shingle_sets([t or "" for t in x["text"]], size)
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "th": x["th"], "node": np.array([set_key(s) for s in sets], np.int64), "n": np.array([len(s) for s in sets], np.int64), "hashes": [keep(s) for s in sets]})

    return docs.mapInPandas(read, "doc_id long, th long, node long, n long, hashes array<long>")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, toks (n-grams that another node has too, rare first, as ranks by frequency and hash), prefix of toks."""
    toks = sets.select("node", "n", F.explode("hashes").alias("h"))
    df = common.cut(toks.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    rows = toks.join(df, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    return rows.filter(F.size("s") >= need).select("node", "n", F.col("s.h").alias("toks"), F.slice(F.col("s.h"), 1, F.size("s") - need + 1).alias("prefix"))


class Trie:
    """Path-compressed trie of ordered token lists. Each trie node knows the least set size, the longest rest and the sets below."""

    __slots__ = ("tokens", "children", "here", "least", "longest", "below")

    def __init__(self, tokens: tuple):
        self.tokens, self.children, self.here = tokens, {}, []

    @staticmethod
    def of(lists: list[tuple[int, int, tuple]]) -> Trie:
        """lists: (set's number, its size, its tokens)."""
        root = Trie(())
        for k, n, toks in lists:
            node, at = root, 0
            while True:
                child = node.children.get(toks[at]) if at < len(toks) else None
                if at == len(toks):
                    node.here.append((k, n))
                    break
                if child is None:
                    node.children[toks[at]] = leaf = Trie(toks[at:])
                    leaf.here.append((k, n))
                    break
                own, m = child.tokens, 0
                while m < len(own) and at + m < len(toks) and own[m] == toks[at + m]:
                    m += 1
                if m < len(own):
                    upper = Trie(own[:m])
                    upper.children[own[m]] = child
                    child.tokens = own[m:]
                    node.children[toks[at]] = upper
                    child = upper
                node, at = child, at + m
        root._close()
        return root

    def _close(self) -> None:
        stack, order = [self], []
        while stack:
            x = stack.pop()
            order.append(x)
            stack.extend(x.children.values())
        for x in reversed(order):
            x.least = min([n for _, n in x.here] + [c.least for c in x.children.values()], default=0)
            x.longest = max([0] + [len(c.tokens) + c.longest for c in x.children.values()])
            x.below = [k for k, _ in x.here] + [k for c in x.children.values() for k in c.below]


class Groups:
    """Union-find over a block's sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def probe(trie: Trie, rank: dict, n: int, toks: tuple, percent: int, same) -> Iterator[int]:
    """Numbers of the trie's sets whose overlap with toks suffices. same(k): already connected, so it need not be found.

    rank: position of each of the probe's tokens in its own order, which is the global order.
    """
    full = 100 + percent
    stack = [(c, 0, -1) for c in trie.children.values()]
    while stack:
        x, overlap, last = stack.pop()
        # overlap >= percent / 100 * union  <=>  overlap * (100 + percent) >= percent * (n + m)
        need = -(-percent * (n + max(x.least, 1)) // full)
        if overlap + min(len(toks) - 1 - last, len(x.tokens) + x.longest) < need or all(same(k) for k in x.below):
            continue
        alive = True
        rest = len(x.tokens) + x.longest
        for t in x.tokens:
            rest -= 1
            r = rank.get(t)
            if r is not None:
                overlap, last = overlap + 1, r
            elif overlap + rest < need:
                alive = False
                break
        if not alive or overlap + min(len(toks) - 1 - last, x.longest) < need:
            continue
        for k, m in x.here:
            if overlap * full >= percent * (n + m) and not same(k):
                yield k
        stack.extend((c, overlap, last) for c in x.children.values())


def _block_links(left: pd.DataFrame, right: pd.DataFrame | None, percent: int) -> list[tuple[int, int]]:
    """Stars (least node, node) of what the links inside a block, or between two blocks, connect, given what is connected
    already (root, the least node): few rounds find the components of stars."""
    rows = left if right is None else pd.concat([left, right], ignore_index=True)
    nodes, sizes, roots = rows["node"].tolist(), rows["n"].tolist(), rows["root"].tolist()
    toks = [tuple(t.tolist()) for t in rows["toks"]]
    groups, first = Groups(len(nodes)), {}
    for i, r in enumerate(roots):
        groups.join(i, first.setdefault(r, i))
    split = len(left)
    inside = range(len(nodes)) if right is None else range(split)
    trie = Trie.of(sorted(((i, sizes[i], toks[i]) for i in inside), key=lambda x: x[2]))
    for i in inside if right is None else range(split, len(nodes)):
        rank = {t: k for k, t in enumerate(toks[i])}
        for k in probe(trie, rank, sizes[i], toks[i], percent, lambda k, i=i: groups.find(k) == groups.find(i)):
            groups.join(i, k)
    least: dict[int, int] = {}
    for i, r in enumerate(roots):
        g = groups.find(i)
        least[g] = min(least.get(g, r), r)
    return [(least[groups.find(i)], r) for r, i in first.items() if least[groups.find(i)] != r]


def _join_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """rows: group (candidate group), node, n, toks, root. Stars a, b of what is linked inside each block."""

    def links(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(x.sort_values(["n", "node"]), None, percent), columns=["a", "b"], dtype="int64")

    return rows.groupBy("group", "block").applyInPandas(links, "a long, b long")


def _cross_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links between different blocks of a group, for pairs of blocks in which unconnected sets share an n-gram of their
    prefixes and fit in size. rows: as in _join_blocks, with prefix."""
    tokens = rows.select("group", "block", "node", "n", "root", F.explode("prefix").alias("h"))
    open_ = common.cut(tokens.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("h"))
    tokens = common.cut(tokens.join(open_, "h"))
    about = tokens.groupBy("h", "group", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    x, y = about.alias("x"), about.alias("y")
    connected = (F.col("x.r0") == F.col("x.r1")) & (F.col("x.r1") == F.col("y.r0")) & (F.col("y.r0") == F.col("y.r1"))
    sizes = (F.col("y.lo") * percent <= F.col("x.hi") * 100) & (F.col("x.lo") * percent <= F.col("y.hi") * 100)
    fits = (F.col("x.block") < F.col("y.block")) & sizes & ~connected
    pairs = x.join(y, F.col("x.h") == F.col("y.h")).filter(fits).select(F.col("x.group").alias("group"), F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct()
    sides = pairs.select("group", "p", "q", F.explode(F.array("p", "q")).alias("block"))
    still = rows.select("group", "block", "node", "n", "toks", "root").join(tokens.select("node").distinct(), "node", "left_semi")

    def links(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["n", "node"])
        return pd.DataFrame(_block_links(x[x["block"] == x["p"]], x[x["block"] == x["q"]], percent), columns=["a", "b"], dtype="int64")

    found = common.cut(sides.join(still, ["group", "block"]).groupBy("group", "p", "q").applyInPandas(links, "a long, b long"))
    common.drop(open_, tokens)
    return found


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Numbers blocks of at most about ``block`` sets and BLOCK_GRAMS n-grams in each group, by set size. A group's sets
    are spread by size class first, so that no task sorts a whole large group: classes keep the order of sizes, and hash
    splits a class that is large."""
    about = F.struct(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    rows = rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) * 16).cast("int"))
    many = rows.groupBy("group", "class").agg(about.alias("of_class"))
    whole = rows.groupBy("group").agg(about.alias("of_group"))
    parts = F.ceil(F.greatest(F.col("of_class.sets") / block, F.col("of_class.grams") / BLOCK_GRAMS))
    number = F.col("class").cast("long") * 2**31 + F.pmod(F.xxhash64("node"), parts)
    small = (F.col("of_group.sets") <= block) & (F.col("of_group.grams") <= BLOCK_GRAMS)
    found = rows.join(many, ["group", "class"]).join(whole, "group")
    return found.withColumns({"block": F.when(small, F.lit(0).cast("long")).otherwise(number), "large": ~small}).drop("class", "of_class", "of_group")


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """root: the smallest node known to be connected."""
    label = components(links).withColumnRenamed("root", "r")
    return rows.drop("root").join(label, "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")


def node_links(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Edges a, b whose components are those of all links between nodes (sets: node, n, hashes)."""
    rows = common.cut(_ordered(sets, percent))
    tokens = rows.select("node", F.explode("prefix").alias("h"))
    least = common.cut(tokens.groupBy("h").agg(F.min("node").alias("m"), F.max("node").alias("x")).filter("m < x").select("h", "m"))
    groups = components(tokens.join(least, "h").select(F.col("node").alias("a"), F.col("m").alias("b")))
    grouped = common.cut(_blocks(rows.join(groups.withColumnRenamed("root", "group"), "node").withColumn("root", F.col("node")), block))
    common.drop(rows, least)
    links = common.cut(_join_blocks(grouped, percent))
    large = grouped.filter("large").drop("large")
    if not large.isEmpty():
        own = links.select(F.col("b").alias("node"), F.col("a").alias("r"))  # a node stands in one block, so in one star
        large = common.cut(large.drop("root").join(own, "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r"))
        heads = large.filter("node = root")
        links = common.cut(links.unionByName(_join_blocks(_blocks(heads.drop("block"), block), percent)))
        links = common.cut(links.unionByName(_cross_blocks(common.cut(_relabel(large, links)), percent)))
    return links


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, sketch: float = 0.34, block: int = BLOCK) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id and is_head (the component's first row by doc_id and
    text hash) of every document. See the module's text."""
    spark, before = docs.sparkSession, common.written()
    source = _documents(docs)

    def low(s: np.ndarray) -> np.ndarray:
        return s[: np.searchsorted(s, _threshold(sketch))]

    with common.small_batches(spark):
        about = common.cut(_sets(source, size, lambda s: None).drop("hashes"))
        own = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "th")
        reps = common.cut(about.filter("n > 0").groupBy("node", "n").agg(F.min(own).alias("r")))
        tokens = _sets(source, size, low).select("node", F.explode("hashes").alias("h"))
        alone = tokens.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("x")).filter("node = x").groupBy("node").agg(F.count("*").alias("alone"))
        may = reps.join(alone, "node", "left").filter(F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * percent / 100))
        may = common.cut(may.select(F.col("r.doc_id").alias("d"), F.col("r.th").alias("t")))
        near = common.mark(source, F.col("th"), may, "t", "__may").filter("__may")
        texts = near.join(may, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t"))).select("doc_id", "th", "text")
        sets = common.cut(_sets(texts, size, lambda s: s).dropDuplicates(["node"]).select("node", "n", "hashes"))
    label = components(node_links(sets, percent, block))
    linked = common.cut(reps.join(label, "node"))
    best = common.cut(linked.groupBy("root").agg(F.min("r").alias("best")))
    least = reps.join(linked.join(best, "root").select("node", "best"), "node", "left").select("node", F.coalesce("best", "r").alias("least"))
    least = common.cut(least)
    common.clean(spark, but=before | common.files(about, least))
    n, first = F.col("n") > 0, F.col("least")
    is_head = F.when(n, first["doc_id"].eqNullSafe(F.col("doc_id")) & first["th"].eqNullSafe(F.col("th"))).otherwise(F.lit(True))
    component = F.when(n, first["doc_id"]).otherwise(F.col("doc_id"))
    return about.join(least, "node", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), is_head.alias("is_head"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id. Documents without words all stay."""
    found = common.cut(jaccard_components(docs, **options))
    keep = found.filter("is_head").groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("n_shingles").alias("__n")).agg(F.count("*").alias("__times"))
    check = found.filter("not is_head").select("th").unionByName(keep.filter("__times > 1").select(F.col("__t").alias("th")))
    keyed = common.mark(docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64("text")}), F.col("__th"), check, "th", "__may")
    kept = keyed.filter("__may").join(keep, F.col("__id").eqNullSafe(F.col("__d")) & F.col("__th").eqNullSafe(F.col("__t")))
    own = F.when(F.col("__n") == 0, F.monotonically_increasing_id())
    once = kept.withColumn("__own", own).dropDuplicates(["__id", "__th", "__own"])
    return once.select(docs.columns).unionByName(keyed.filter("not __may").select(docs.columns))
