"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text gets a leading space, as the model asks for, and is cut into units: runs of spaces with the characters after
them, cut again between a letter and a sign where no piece of the vocabulary holds such a pair. No piece of such a model
holds a space after another character either, so units can be merged apart from each other. Within
a unit the agenda offers the adjacent pair with the best (lowest) piece id, leftmost first; each candidate, known by
where its two parts start and end, is skipped for good if a hash falls below the dropout rate. The hash is keyed by the
seed, the document and the place of the unit in its text, so every occurrence of a word draws skips of its own.
What is left of characters outside the vocabulary becomes its UTF-8 bytes, so decoding gives back any text exactly.

What an agenda does between two skips is the same for all occurrences of a unit. It is kept as a tree: a node knows the
candidates that it merges in turn if none is skipped, the ids that result, and for each candidate the node that follows
if that one is skipped. Occurrences walk the trees of their units all at once. A node is made when it is needed for the
second time; the first occurrence that needs it goes through its agenda by itself, as most words of a text are met once.

Defined results: null and empty texts have no ids and decode to the empty text; a null doc_id counts as 0 in the hash;
repeated rows get equal ids; an empty table gives no rows; columns named ids or decoded give way, others stay.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Units longer than this are merged by a heap instead of in numpy rounds.
LONG_UNIT = 48
_NONE = np.int64(1 << 40)
#: Instead of a node: not needed yet, a long unit, needed once.
_NEW, _LONG, _ASKED = -1, -2, -3
_SLOT_BITS = 18


def _unit_pattern(pieces: list[str]) -> re.Pattern:
    """Units that no piece crosses: a text is cut before spaces, around signs of ASCII that stand in no piece, and between a
    letter or digit (below code point 256) and a sign of ASCII that follows none of these in any piece."""
    pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
    plain = {chr(c) for c in range(256) if chr(c).isalnum()}
    signs = {chr(c) for c in range(128)} - plain - {" "}
    lone = signs.difference(*pieces) | {"\0"}
    signs -= {b for a, b in pairs if a in plain}
    a, k, u = (re.escape("".join(sorted(x))) for x in (plain, signs - lone, lone))
    rest = f"[^ {a}{k}{u}][^ {a}{u}]*+"
    return re.compile(f" *+[^ {a}{u}]*+[{a}]++(?:{rest}[{a}]++)*+(?:{rest})?+| *+[^ {a}{u}]++|[{u}]++| ++")


class Model:
    """Vocabulary and pair table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(self.size)]
        score = [sp.get_score(i) for i in range(self.size)]
        self.byte = np.zeros(256, np.int32)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte[int(self.pieces[i][1:-1], 16)] = i
        ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        order = sorted(ids.values(), key=lambda i: (-score[i], i))
        self.rank = np.zeros(self.size, np.int64)  # place in the agenda
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array(order, np.int64)
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        self.char[" "] = self.char.pop(SPACE, -1)
        keys, values = [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(self.rank[i])
        self.pairs = dict(zip(keys, values, strict=True))
        self._fill(np.array(keys, np.int64), np.array(values, np.int64))
        cps = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            cps[ord(c)] = i
        self.cps = cps
        self.unit = _unit_pattern([self.pieces[i].replace(SPACE, " ") for i in ids.values()])
        self.text = [b"" for _ in range(self.size)]
        for i in range(self.size):
            if sp.is_byte(i):
                self.text[i] = bytes([int(self.pieces[i][1:-1], 16)])
            elif plain[i]:
                self.text[i] = self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text that encode() was given."""
        out = b"".join([self.text[i] for i in ids.tolist()])
        return out[1:].decode("utf-8", "surrogatepass")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _fill(self, key: np.ndarray, value: np.ndarray) -> None:
        """Open addressing; each round writes what finds its slot empty."""
        self.keys, self.values = np.full((1 << _SLOT_BITS) + 1, -1, np.int64), np.full((1 << _SLOT_BITS) + 1, _NONE, np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several keys for a slot, the last stays
            own = self.keys[slot] == key
            self.values[slot[own]] = value[own]
            key, value, slot = key[~own], value[~own], (slot[~own] + 1) % (1 << _SLOT_BITS)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two pieces make, _NONE if none."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -2)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % (1 << _SLOT_BITS)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """common.mix64 of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _place(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(42)) ^ (mid.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)


class Encoder:
    """most: nodes that may be kept; beyond, all are forgotten before the next slice of texts. Units beyond as many are
    forgotten too, but for those that have nodes."""

    def __init__(self, model: Model, dropout: float = 0.1, seed: int = 1, most: int = 300_000):
        self.model, self.dropout, self.seed, self.most = model, dropout, seed, most
        self._forget()

    def _forget(self) -> None:
        self.unit = common.Numbers()
        self.root = common.Rows(np.int32)  # by unit: its first node
        # by node: where its candidates begin, how many they are, where its ids begin, how many they are, merges before
        self.first, self.chain, self.ids_at, self.n_ids, self.before = (common.Rows(np.int32) for _ in range(5))
        self.ids = common.Rows(np.uint32)
        # by candidate: its place, hashed and as it is, its node, the node that follows if it is skipped
        self.hashed, self.place, self.node, self.next = common.Rows(np.uint64), common.Rows(np.uint64), common.Rows(np.int32), common.Rows(np.int32)
        self.node_unit, self.parent = common.Rows(np.int32), common.Rows(np.int32)  # by node; parent: the candidate that was skipped

    def _forget_units(self) -> None:
        root, names, nodes = self.root.all[: self.root.n], self.unit.names, self.node_unit
        keep = np.flatnonzero(root >= 0)
        if len(keep) > self.most // 2:
            self._forget()
            return
        nodes.all[: nodes.n] = (np.cumsum(root >= 0) - 1)[nodes.all[: nodes.n]]
        self.unit, self.root = common.Numbers(), common.Rows(np.int32)
        for k in keep.tolist():
            self.unit[names[k]]  # numbered anew
        self.root.add(root[keep])

    def keys(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The key of each occurrence."""
        own = common.mix64(doc.astype(np.int64).view(np.uint64) ^ np.uint64(self.seed * 0x9E3779B1))
        return common.mix64(own + place.astype(np.uint64))

    def encode(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Ids of each text; docs and places in the text key the skips."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        for a, b in common.slices(texts):
            if self.first.n > self.most:
                self._forget()
            elif len(self.unit.names) > self.most:
                self._forget_units()
            units = [self.model.unit.findall(" " + t) if t else [] for t in texts[a:b]]
            flat = np.fromiter(map(self.unit.__getitem__, chain.from_iterable(units)), np.int64)
            n = np.fromiter(map(len, units), np.int64, len(units))
            first = np.cumsum(n) - n
            place = np.arange(len(flat)) - np.repeat(first, n)
            keys = self.keys(np.repeat(np.array(docs[a:b], np.int64), n), place)
            start, size, ids = self._segment(flat, keys)
            whole = ids[common.ranges(start, size)]
            bounds = np.concatenate([[0], np.cumsum(size)])
            for i in range(b - a):
                out[a + i] = whole[bounds[first[i]] : bounds[first[i] + n[i]]]
        return out

    def _segment(self, flat: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each occurrence begin in the array that is returned too, and how many they are."""
        names = self.unit.names
        new = names[self.root.n :]
        self.root.add(np.array([_LONG if len(u) > LONG_UNIT else _NEW for u in new], np.int32))
        missing = self._due(self.root, flat)
        if len(missing):
            self.root.all[missing] = self._make(missing, np.full(len(missing), -1))
        node = self.root.all[flat].astype(np.int64)
        active = np.flatnonzero(node >= 0)
        while self.dropout > 0 and len(active):
            at = node[active]
            tried, size = common.ranges(self.first.all[at], self.chain.all[at]), self.chain.all[at]
            hit = np.flatnonzero(self._skipped(np.repeat(keys[active], size) ^ self.hashed.all[tried]))
            owner = np.repeat(active, size)[hit]
            one = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]  # the first skip of each
            active, skipped = owner[one], tried[hit[one]]
            missing = self._due(self.next, skipped)
            if len(missing):
                self.next.all[missing] = self._make(self.node_unit.all[self.node.all[missing]], missing)
            node[active] = self.next.all[skipped]
            active = active[node[active] >= 0]
        known = np.maximum(node, 0)
        start, size = (x.all[known].astype(np.int64) if x.n else np.zeros(len(node), np.int64) for x in (self.ids_at, self.n_ids))
        found, end = [self.ids.all[: self.ids.n]], self.ids.n
        long, alone = np.flatnonzero(node == _LONG), np.flatnonzero(node == _ASKED)
        if len(long):
            parts = [self._finish(names[u], *self.by_heap(names[u], int(k))) for u, k in zip(flat[long].tolist(), keys[long].tolist(), strict=True)]
            size[long] = [len(x) for x in parts]
            found += parts
        for a in range(0, len(alone), 20_000):
            own = alone[a : a + 20_000]
            part, size[own] = self._by_rounds([names[u] for u in flat[own].tolist()], keys=keys[own])[:2]
            found.append(part)
        rest = np.concatenate([long, alone])
        start[rest] = end + np.cumsum(size[rest]) - size[rest]
        return start, size, np.concatenate(found) if len(rest) else self.ids.all

    def _skipped(self, x: np.ndarray) -> np.ndarray:
        return (common.mix64(x) >> np.uint64(11)).astype(np.float64) < self.dropout * 2.0**53

    def _due(self, rows: common.Rows, at: np.ndarray) -> np.ndarray:
        """Entries that get a node now: needed before, or more than once among at. Others without one are noted."""
        now = rows.all[at]
        open_ = at[(now == _NEW) | (now == _ASKED)]
        one, count = np.unique(open_, return_counts=True)
        due = (count > 1) | (rows.all[one] == _ASKED)
        rows.all[one[~due]] = _ASKED
        return one[due]

    def _make(self, units: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """Numbers of new nodes of units, each for the skip of a candidate (-1: for none yet)."""
        first = self.first.n
        for a in range(0, len(units), 20_000):
            unit, before = units[a : a + 20_000], parents[a : a + 20_000]
            self._add(unit, before, *self._by_rounds([self.unit.names[u] for u in unit.tolist()], self._skips(before)))
        return np.arange(first, first + len(units))

    def _finish(self, unit: str, ids: list[int], starts: list[int]) -> np.ndarray:
        """Ids, with unknown characters as their UTF-8 bytes."""
        out: list[int] = []
        for i, s in zip(ids, starts, strict=True):
            out += [i] if i >= 0 else self.model.byte[list(unit[s].encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, np.uint32)

    def by_heap(self, unit: str, key: int) -> tuple[list[int], list[int]]:
        """Pieces (-1: unknown character) and their first characters, by one agenda for one occurrence."""
        model, n = self.model, len(unit)
        ids = [model.char.get(c, -1) for c in unit]
        end, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []
        least = self.dropout * 2.0**53

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else n
            if i < 0 or j >= n or ids[i] < 0 or ids[j] < 0:
                return
            r = model.pairs.get(ids[i] * model.size + ids[j])
            if r is not None:
                heapq.heappush(agenda, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while agenda:
            r, i, j, e = heapq.heappop(agenda)
            if gone[i] or gone[j] or right[i] != j or end[j] != e or end[i] != j:
                continue
            if least and _mix(key ^ _mix(i << 42 ^ j << 21 ^ e)) >> 11 < least:
                continue
            ids[i], end[i], gone[j], right[i] = int(model.by_rank[r]), e, True, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        starts = [i for i in range(n) if not gone[i]]
        return [ids[i] for i in starts], starts

    def _skips(self, parents: np.ndarray) -> np.ndarray:
        """Places that are skipped on the way to each new node, a row each, filled up with a place that no unit has."""
        out = []
        while (parents >= 0).any():
            known = np.maximum(parents, 0)
            out.append(np.where(parents >= 0, self.place.all[known], np.uint64(_MASK)))
            parents = np.where(parents >= 0, self.parent.all[self.node.all[known]], -1)
        return np.array(out, np.uint64).reshape(len(out), len(parents))

    def _by_rounds(self, units: list[str], skips: np.ndarray | None = None, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Ids of short units, how many each has, and the merges: a round merges the best candidate of every unit that is
        not skipped. skips: places by unit (see _skips); keys: of occurrences, whose own skips count."""
        model = self.model
        cps = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, units), np.int64, len(units))
        word = np.repeat(np.arange(len(units)), n)
        start = np.arange(len(cps)) - np.repeat(np.cumsum(n) - n, n)
        ids, end = model.cps[cps].astype(np.int64), start + 1
        nobody = np.full(1, _NONE)

        def candidates(at: np.ndarray) -> np.ndarray:
            """Rank of the merge of each symbol with the next one; at must not hold the last symbol."""
            r = np.where(word[at] == word[at + 1], model.look_up(ids[at], ids[at + 1]), _NONE)
            ok = np.flatnonzero(r < _NONE)
            if len(ok) and (keys is not None and self.dropout > 0 or skips is not None and len(skips)):
                o = at[ok]
                place = _place(start[o], start[o + 1], end[o + 1])
                r[ok[self._skipped(keys[word[o]] ^ common.mix64(place)) if keys is not None else (skips[:, word[o]] == place).any(0)]] = _NONE
            return r

        rank = np.concatenate([candidates(np.arange(len(ids) - 1)), nobody]) if len(ids) else np.zeros(0, np.int64)
        done: list[tuple] = []
        merged: list[tuple] = []
        while len(ids):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, head)
            count = np.diff(np.append(head, len(ids)))
            stop = np.repeat(best == _NONE, count)
            if stop.any():
                done.append((word[stop], start[stop], ids[stop]))
                word, start, end, ids, rank = (x[~stop] for x in (word, start, end, ids, rank))
                if not len(ids):
                    break
                count, best = count[best < _NONE], best[best < _NONE]
            hit = np.flatnonzero(rank == np.repeat(best, count))
            hit = hit[np.diff(word[hit], prepend=-1) > 0]  # the leftmost of each unit
            if keys is None:
                merged.append((word[hit], _place(start[hit], start[hit + 1], end[hit + 1])))
            ids[hit], end[hit] = model.by_rank[rank[hit]], end[hit + 1]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            word, start, end, ids, rank = (x[keep] for x in (word, start, end, ids, rank))
            near = np.zeros(len(ids), bool)
            near[moved[hit]] = near[np.maximum(moved[hit] - 1, 0)] = True
            near[-1] = False
            again = np.flatnonzero(near)
            rank[again] = candidates(again)
            rank[-1] = _NONE
        many = len(units)
        w, s, i = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.lexsort((s, w))
        w, s, i = w[order], s[order], i[order]
        size = np.bincount(w, minlength=many)
        odd = np.unique(w[i < 0])
        if len(odd):  # characters outside the vocabulary
            bounds = np.concatenate([[0], np.cumsum(size)])
            parts = np.split(i.astype(np.uint32), bounds[1:-1])
            for k in odd.tolist():
                x = slice(bounds[k], bounds[k + 1])
                parts[k] = self._finish(units[k], i[x].tolist(), s[x].tolist())
            i, size = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, many)
        return i.astype(np.uint32), size, merged

    def _add(self, unit: np.ndarray, parents: np.ndarray, ids: np.ndarray, size: np.ndarray, merged: list[tuple]) -> None:
        """Keeps new nodes of units."""
        many = len(unit)
        at = self.ids.add(ids)
        self.ids_at.add(at + np.cumsum(size) - size)
        self.n_ids.add(size)
        m, place = (np.concatenate([x[k] for x in merged]) if merged else np.zeros(0, np.uint64) for k in (0, 1))
        order = np.argsort(m, kind="stable")
        m, place = m[order].astype(np.int64), place[order]
        # merges up to the skipped candidate are those of the parent
        known = np.maximum(parents, 0)
        before = np.where(parents >= 0, self.before.all[self.node.all[known]] + known - self.first.all[self.node.all[known]], 0)
        count = np.bincount(m, minlength=many)
        own = np.arange(len(m)) - np.repeat(np.cumsum(count) - count, count) >= before[m]
        m, place, count = m[own], place[own], count - before
        first = self.first.n
        self.before.add(before)
        self.chain.add(count)
        self.node_unit.add(unit)
        self.parent.add(parents)
        self.node.add(first + m)
        self.place.add(place)
        self.next.add(np.full(len(place), _NEW))
        at = self.hashed.add(common.mix64(place))
        self.first.add(at + np.cumsum(count) - count)


@lru_cache(2)
def _model(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    """Kept by the Python worker, so that later tasks find nodes that earlier ones made."""
    return Encoder(_model(path), dropout, seed)


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """All columns of docs, with ids (array<int>)."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = _encoder(model_path, dropout, seed)
        for text, doc in common.leanly(batches):
            ids = encoder.encode([t or "" for t in text.to_pylist()], doc.to_pylist())
            at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.ListArray.from_arrays(at, np.concatenate([np.zeros(0, np.uint32), *ids]).view(np.int32))

    out = common.in_small_batches(docs).withColumn("__ids", run.asNondeterministic()(F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    return common.replace_columns(out, {"ids": F.col("__ids")}).drop("__ids")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """All columns of rows, with decoded (the text that ids stand for)."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(model_path)
        for batch in common.leanly(batches):
            at, ids = batch.offsets.to_pylist(), batch.values.to_numpy(zero_copy_only=False)
            yield pa.array([model.decode(ids[a:b]) if there else "" for a, b, there in zip(at[:-1], at[1:], batch.is_valid().to_pylist(), strict=True)], pa.string())

    out = common.in_small_batches(rows).withColumn("__text", run.asNondeterministic()(F.col("ids")))
    return common.replace_columns(out, {"decoded": F.col("__text")}).drop("__text")
