"""Packing: bounded-space online best fit per partition, then a merge of what stays open.

Each partition keeps at most ``open_windows`` windows. A document's full windows are emitted at once; its rest goes
to the open window that it fills best. When none has room, the fullest is topped up with the head of the rest (if at
least ``min_piece`` ids go there), emitted, and the remaining ids are placed again. Windows open at a partition's end
(at most ``open_windows``) go with their ids to a merge over ``merge_partitions`` partitions each; the last window of
a merge is cut into sequences of power-of-two lengths, which need no padding.

Defined results: a null text is an empty one, which is the end id alone; null doc_ids and repeated rows are packed
like others; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQ_LEN = 2048
END_ID = 1
OUTPUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN_SCHEMA = SCHEMA + ", partition long, window int, ids binary"

#: Characters that the tokenizer's normaliser handles one by one, so that words may be encoded apart from each other.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ſ]*")
_LETTERS, _NUMBERS = ("".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN")
#: Parts of a word that the tokenizer encodes apart: its published pattern, for the characters of _PLAIN.
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_SIGNS = re.compile(r"[.,](?<![^\W_].)(?<!\s.)[ \n]")  # neither a letter, a number nor white space before it
#: Settings of the tokenizer for lower-case parts with a space between them, their bytes written as its characters: it
#: merges alone.
_PARTS_ALONE = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _byte_characters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary; a space stays, as it parts the words."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u2")
    out[own] = own
    rest = np.flatnonzero(out == 0)
    out[rest] = 256 + np.arange(len(rest))
    out[32] = 32
    return out


_BYTES = _byte_characters()


class WordMemo:
    """encode(text) of a word-level tokenizer, through a bounded memo of words split at white space.

    The tokenizer lower-cases, turns white space into word ends and never merges across it, so the ids of a text are
    those of its words, as long as no normalisation crosses characters and no special token stands in the text; any
    other text goes to the tokenizer whole. Words of more than ``most`` are forgotten before the next slice of texts, but
    for those met in several slices since the last time.
    """

    def __init__(self, path: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.parts = Tokenizer.from_str(json.dumps(json.loads(self.tokenizer.to_str()) | _PARTS_ALONE))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close one of the tokenizer's own words
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.word = common.Numbers()
        # by word: where its ids begin, how many they are, in how many slices it was met
        self.at, self.size, self.met, self.ids = common.Rows(np.int64), common.Rows(np.int32), common.Rows(np.int32), common.Rows(np.uint32)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met.all[: self.met.n] > 1)
        names, at, size, ids = self.word.names, self.at.all[keep], self.size.all[keep], self.ids.all
        self._empty()
        if len(keep) <= self.most // 2:
            for k in keep.tolist():
                self.word[names[k]]  # numbered anew
            self._add(ids[common.ranges(at, size)], size)

    def _add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.at.add(self.ids.add(ids) + np.cumsum(size) - size)
        self.size.add(size)
        self.met.add(np.zeros(len(size), np.int32))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in common.slices(texts):
            if len(self.word.names) > self.most:
                self._forget()
            words = [self._words(t) for t in texts[a:b]]
            n = np.fromiter((len(w or ()) for w in words), np.int64, b - a)
            flat = np.fromiter(map(self.word.__getitem__, chain.from_iterable(filter(None, words))), np.int64, int(n.sum()))
            new = self.word.names[self.at.n :]
            for i in range(0, len(new), 500):
                self._learn(new[i : i + 500])
            self.met.all[flat] += 1  # once, however often a word stands there
            size = self.size.all[flat]
            ids = self.ids.all[common.ranges(self.at.all[flat], size)]
            bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])].tolist()
            for k, w in enumerate(words):
                out.append(ids[bounds[k] : bounds[k + 1]] if w is not None else np.array(self.tokenizer.encode(texts[a + k], add_special_tokens=False).ids, np.uint32))
        return out

    def _words(self, text: str) -> list[str] | None:
        if not _PLAIN.fullmatch(text) or any(s in text for s in _SPECIAL):
            return None
        low = text.lower()
        if not _SIGNS.search(low):  # a comma or stop after a letter is a part of its own: words are met again without it
            low = low.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return low.split()

    def _learn(self, words: list[str]) -> None:
        """Encodes the words' parts as one text and cuts its ids where each word's last part ends."""
        split = [[w] if w.isalpha() else _PART.findall(w) for w in words]
        text = " ".join(chain.from_iterable(split))
        if not text.isascii():
            text = _BYTES[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        parts = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        if parts[-1] != len(ends):
            raise ValueError("the tokenizer cuts words in another way than expected")
        self._add(ids, np.diff(ends[parts - 1], prepend=0))


class Packer:
    """Open windows of one partition (or one merge). Emitted pieces collect in ``out``."""

    def __init__(self, first_sequence: int, seq_len: int, open_windows: int, min_piece: int):
        self.next, self.seq_len, self.most, self.min_piece = first_sequence, seq_len, open_windows, min_piece
        self.gaps: list[tuple[int, int]] = []  # (gap, window), ascending
        self.windows: dict[int, list] = {}
        self.count = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list, sequence: int | None = None) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids) >= self.seq_len:
            self.emit([(doc, start, ids[: self.seq_len], total)])
            ids, start = ids[self.seq_len :], start + self.seq_len
        while len(ids):
            k = bisect.bisect_left(self.gaps, (len(ids), -1))
            if k < len(self.gaps):
                self._put(k, doc, start, ids, total)
                return
            if len(self.gaps) < self.most:
                self.gaps.append((self.seq_len, self.count))
                self.windows[self.count] = []
                self.count += 1
                continue
            gap = self.gaps[0][0]
            if gap >= self.min_piece:
                self._put(0, doc, start, ids[:gap], total)
                ids, start = ids[gap:], start + gap
            else:
                self.emit(self.windows.pop(self.gaps.pop(0)[1]))

    def _put(self, k: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        gap, w = self.gaps.pop(k)
        self.windows[w].append((doc, start, ids, total))
        if gap == len(ids):
            self.emit(self.windows.pop(w))
        else:
            bisect.insort(self.gaps, (gap - len(ids), w))

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _encoder(path: str):
    key = f"_memo_{path}"
    module = sys.modules[__name__]
    if not hasattr(module, key):
        setattr(module, key, WordMemo(path))
    return getattr(module, key)


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, open_windows: int = 48, min_piece: int = 8, merge_partitions: int = 16) -> DataFrame:
    """Pieces of all documents: one row for each, with its sequence and offset. See the module's text."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, encoder = Packer(part << 32, seq_len, open_windows, min_piece), _encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in common.leanly(batches):
            for doc, ids in zip(batch["doc_id"].astype("Int64"), encoder.encode_all([t or "" for t in batch["text"]]), strict=True):
                packer.add(None if doc is pd.NA else int(doc), np.concatenate([ids, end]))
            yield frame(packer.take(), part, [], [])
        rows, windows, ids = [], [], []
        for w, pieces in sorted(packer.windows.items()):
            for doc, start, x, total in pieces:
                rows.append((doc, start, len(x), 0, total, 0, 0))
                windows.append(w)
                ids.append(x.tobytes())
        yield frame(rows, part, windows, ids)

    def frame(rows: list, part: int, windows: list, ids: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=OUTPUT)
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["partition"] = part
        out["window"] = pd.array(windows if windows else [None] * len(rows), dtype="Int32")
        out["ids"] = pd.Series(ids if ids else [None] * len(rows), dtype=object)
        return out

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer((1 << 62) + (int(key[0]) << 32), seq_len, 1 << 30, min_piece)
        rows = rows.assign(lost=rows["doc_id"].isna()).sort_values(["length", "lost", "doc_id", "start", "partition", "window"], ascending=[False, True, True, True, True, True])
        pieces = [(None if lost else int(d), int(s), np.frombuffer(x, np.uint32), int(t)) for d, lost, s, x, t in zip(rows["doc_id"].fillna(0), rows["lost"], rows["start"], rows["ids"], rows["doc_tokens"], strict=True)]
        windows = -(-sum(len(p[2]) for p in pieces) // seq_len)
        packer.most = max(1, windows)  # so many windows suffice as pieces may be cut
        for doc, start, ids, total in pieces:
            packer.add(doc, ids, start, total)
        rest = [p for _, w in sorted(packer.gaps) for p in packer.windows[w]]
        for size in _power_lengths(sum(len(p[2]) for p in rest), seq_len):
            taken, need = [], size
            while need:
                doc, start, ids, total = rest.pop(0)
                taken.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need, ids[need:], total))
                need -= min(need, len(ids))
            packer.emit(taken)
        out = pd.DataFrame(packer.take(), columns=OUTPUT)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    pieces = common.cut(common.in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(pack, _OPEN_SCHEMA))
    merged = pieces.filter("window is not null").groupBy(F.expr(f"partition div {merge_partitions}").alias("g")).applyInPandas(merge, SCHEMA)
    return pieces.filter("window is null").select(*OUTPUT).unionByName(merged)


def _power_lengths(n: int, most: int) -> list[int]:
    """Full windows, then the binary digits of the rest: lengths that need no padding."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length(), -1, -1) if (n % most) >> k & 1]
