"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents it reads, group by group, with no shuffle and bounded memory: a group closes when
its tokens fill `group` windows exactly (its last document is cut there; documents may be cut freely). Slices as long as a window
stand alone. The other pieces are dealt to windows by differencing: the two partial partitions of the largest spread are
merged, the fullest window of one with the emptiest of the other, until one partition is left. What a window then has
over its capacity is cut off and moved to the windows that have room. The number of windows is the tokens over the capacity, rounded up, so it rises
when a group has more than fits. The last group of a task is cut so that its rest makes windows whose lengths are powers of two, which need no padding.

Nulls: a null text is an empty document (its end id alone). Null ids and repeated rows are packed as rows of their own.
No rows: no pieces. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from blockdb.llm import common, text

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows by largest differencing; returns the item numbers of each window, fullest first."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [size] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, sums, items = heapq.heappop(heap)
        _, _, sums2, items2 = heapq.heappop(heap)
        pairs = sorted(((a + b, i) for i, (a, b) in enumerate(zip(sums, reversed(sums2)))), reverse=True)
        back = items2[::-1]
        merged = [items[i] + back[i] for _, i in pairs]
        total = [s for s, _ in pairs]
        heapq.heappush(heap, (total[-1] - total[0], tie, total, merged))
        tie += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def pack_group(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length), none over `capacity`."""
    total = sum(sizes)
    if not total:
        return []
    k = -(-total // capacity)
    windows = [[(i, 0, sizes[i]) for i in items if sizes[i]] for items in difference(sizes, k)]
    fill = [sum(n for _, _, n in w) for w in windows]
    spare: list[tuple[int, int, int]] = []
    for w, full in zip(windows, fill):
        over = full - capacity
        while over > 0:
            i, start, n = w.pop()
            cut = min(n, over)
            if n > cut:
                w.append((i, start, n - cut))
            spare.append((i, start + n - cut, cut))
            over -= cut
    for w in windows:
        room = capacity - sum(n for _, _, n in w)
        while room > 0 and spare:
            i, start, n = spare.pop()
            take = min(n, room)
            w.append((i, start, take))
            if n > take:
                spare.append((i, start + take, n - take))
            room -= take
    return windows


class Tokens:
    """Ids of texts: each distinct word is encoded once; the vocabulary's rules drop white space, so words don't affect one another."""

    MOST = 400_000  # words kept: some 30 MB
    MARK, MARK_ID = "<|startoftext|>", 49406  # a special token of the vocabulary: it parts the words of one call
    LETTER, POINT = np.zeros(256, bool), np.zeros(256, bool)
    LETTER[97:123] = True
    POINT[list(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\")] = True

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder, self.end_id = Tokenizer.from_file(path), end_id
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(0, text.U), np.zeros(0, np.int64)  # hashes in order, and their entries
        self.at, self.size, self.seen, self.ids, self.n, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, np.uint32), 0, 0

    def _shrink(self) -> None:
        """Keep the words that several blocks of text had; should that be most of them, none."""
        keep = np.flatnonzero(self.seen[: self.n] > 1)
        if len(keep) > self.MOST // 2:
            self.clear()
            return
        size = self.size[keep]
        places = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.at[keep] - places[:-1], size) + np.arange(places[-1])]
        new = np.full(self.n, -1, np.int64)
        new[keep] = np.arange(len(keep))
        entry = new[self.entry]
        self.keys, self.entry = self.keys[entry >= 0], entry[entry >= 0]
        self.n, self.used = len(keep), len(ids)
        room = max(1024, self.n)
        self.at, self.size, self.seen = (np.resize(x, room) if len(x) else np.zeros(room, x.dtype) for x in (places[:-1], size, np.zeros(len(keep), np.int32)))
        self.ids = np.append(ids, np.zeros(max(0, 8192 - len(ids)), np.uint32))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of hashes; -1 for those that are new."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], -1)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """`keys` are in order."""
        ids: list[int] = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            if any("<|" in x for x in part):
                ids += [i for e in self.encoder.encode_batch(part, add_special_tokens=False) for i in (*e.ids, -1)]
            else:
                joined = self.encoder.encode(self.MARK.join(part), add_special_tokens=False).ids
                ids += [*(-1 if i == self.MARK_ID else i for i in joined), -1]
        flat = np.array(ids, np.int64)
        ends = np.flatnonzero(flat < 0)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = flat[flat >= 0].astype(np.uint32)
        while len(self.at) < self.n + len(keys):
            self.at, self.size, self.seen = (np.concatenate((x, x)) for x in (self.at, self.size, self.seen))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate((self.ids, self.ids))
        new = slice(self.n, self.n + len(keys))
        self.at[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.seen[new] = 0
        where = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, where, keys), np.insert(self.entry, where, np.arange(new.start, new.stop))
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in text.blocks(texts):
            # The vocabulary's rules lower all case, and always part a word's last points from a letter before them.
            special = any("<|" in (t or "") for t in texts[a:b])
            words = text.scan(texts[a:b], lower=not special)
            start, end, cut = words.start, words.end, np.zeros(len(words.start), bool)
            if not special:
                stem = end.copy()
                for _ in range(4):
                    stem -= (stem - start > 1) & self.POINT[words.data[stem - 1]]
                cut = (stem < end) & self.LETTER[words.data[stem - 1]]
                stem = np.where(cut, stem, end)
                first = np.arange(len(start)) + np.cumsum(cut) - cut
                both = np.empty((2, len(start) + int(cut.sum())), np.int64)
                both[0, first], both[1, first] = start, stem
                both[0, first[cut] + 1], both[1, first[cut] + 1] = stem[cut], end[cut]
                start, end = both
            begin = words.first + np.concatenate(([0], np.cumsum(cut)))[words.first]
            if self.n > self.MOST:
                self._shrink()
            keys, one, inverse = np.unique(words.span_hash(start, end), return_index=True, return_inverse=True)
            found = self._find(keys)
            new = np.flatnonzero(found < 0)
            if len(new):
                raw = words.data.tobytes()
                where = one[new]
                self._learn(keys[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[where].tolist(), end[where].tolist())])
                found = self._find(keys)
            self.seen[found] += 1
            entry = found[inverse]
            size = self.size[entry]
            # Each text ends with the end id, which takes the place after its last word.
            places = np.concatenate(([0], np.cumsum(size)))
            begin = places[begin]
            total = int(places[-1])
            source = np.repeat(self.at[entry] - places[:-1], size) + np.arange(total)
            flat = self.ids[source]
            for i in range(b - a):
                out.append(np.append(flat[begin[i] : begin[i + 1]], np.uint32(self.end_id)))
        return out


_tokens: dict[tuple[str, int], Tokens] = {}


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, group: int) -> Iterator[pa.RecordBatch]:
    if (path, end_id) not in _tokens:
        _tokens[path, end_id] = Tokens(path, end_id)
    tokens = _tokens[path, end_id]
    task = TaskContext.get()
    sequence = (task.partitionId() if task else 0) << 32
    rows: list[tuple] = []
    waiting: list[tuple] = []  # (doc_id, ids, start): what is left of documents
    held = 0
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def put(pieces: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for doc_id, ids, start, n in pieces:
            rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), sequence, offset))
            offset += n
        sequence += 1

    def close(items: list[tuple]) -> None:
        for window in pack_group([n for *_, n in items], capacity):
            put([(items[i][0], items[i][1], items[i][2] + s, n) for i, s, n in window])

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in text.blocks(texts):
            for doc_id, ids in zip(doc_ids[a:b], tokens.encode(texts[a:b])):
                whole = len(ids) // capacity
                for j in range(whole):
                    put([(doc_id, ids, j * capacity, capacity)])
                start = whole * capacity
                rest = len(ids) - start
                if held + rest >= group * capacity:
                    cut = group * capacity - held
                    close([*waiting, (doc_id, ids, start, cut)])
                    waiting, held, start, rest = [], 0, start + cut, rest - cut
                if rest:
                    waiting.append((doc_id, ids, start, rest))
                    held += rest
            if len(rows) > 20_000:
                yield flush()
    full = held // capacity * capacity
    items, tail, so_far = [], [], 0
    for doc_id, ids, start, n in waiting:
        take = min(n, full - so_far)
        if take:
            items.append((doc_id, ids, start, take))
        if n > take:
            tail.append((doc_id, ids, start + take, n - take))
        so_far += take
    close(items)
    left = held - full
    for bit in reversed(range(left.bit_length())):
        room = left & (1 << bit)
        window = []
        while room:
            doc_id, ids, start, n = tail.pop(0)
            take = min(n, room)
            window.append((doc_id, ids, start, take))
            if n > take:
                tail.insert(0, (doc_id, ids, start + take, n - take))
            room -= take
        if window:
            put(window)
    yield flush()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, group: int = 16) -> DataFrame:
    """Pieces of documents and their places in sequences of at most `capacity` tokens. No shuffle: tasks pack what they read."""
    return common.text_rows(docs).mapInArrow(lambda it: _pack(it, tokenizer_path, end_id, capacity, group), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
