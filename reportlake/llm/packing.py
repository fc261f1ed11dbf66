"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised, cut where that helps, and packed block by block. A
block holds a bounded number of tokens, so a task never holds more than one
block, whatever its partition or its longest document; there is no shuffle.

Nulls and empty texts hold only the closing id. Repeated rows are packed as
often as they occur; an empty table gives no pieces. Columns other than the id
and the text are not read. Ids travel as text, so that none is rounded beside a
null one, which is kept as null; a cluster's pieces of null ids are told apart
by their sequence and offset only.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
WINDOWS = 256  # windows of a block
SLACK = 4  # tokens a window of a block is left short of its capacity, so that differencing can meet it
LONGEST = 512  # a longer document is cut into pieces of this length before differencing
CLOSING = 2
CACHE = 500_000
PUNCTUATION = b".,;:!?%*&$#|)(+=-"
#: What the byte-level vocabulary calls the bytes above ASCII in a lower-case word: printable ones by themselves, others from U+0122 on.
BYTE_NAMES = dict(zip([b for b in range(128, 256) if b < 161 or b == 173], [*range(0x122, 0x144)]))
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer(dict):
    """Ids of texts; each run without ASCII white space is encoded once and kept, as bytes.

    The vocabulary's pre-tokeniser never joins what white space parts, nor a
    letter with punctuation behind it, and it ignores case; so the ids of a
    text are those of its runs, and those of a run those of its letters and its
    closing punctuation. Plain lower-case words go straight to the merges,
    anything else through the whole tokeniser.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self[b""] = array("I", [CLOSING]).tobytes()
        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model.tokenize

    def __missing__(self, run: bytes) -> bytes:
        body = run.rstrip(PUNCTUATION)
        if body.isalpha() and body.islower():
            ids = array("I", [t.id for t in self.merges(body.decode())]).tobytes()
        else:
            word = body.decode()
            if word.isalpha() and word.lower() == word and is_normalized("NFC", word):
                ids = array("I", [t.id for t in self.merges(body.decode("latin-1").translate(BYTE_NAMES))]).tobytes()
            else:
                body, ids = run, array("I", self.whole.encode(run.decode(), add_special_tokens=False).ids).tobytes()
        if len(body) < len(run):
            end = run[len(body) :]
            if end not in self:
                self[end] = array("I", self.whole.encode(end.decode(), add_special_tokens=False).ids).tobytes()
            ids += self[end]
        self[run] = ids
        return ids

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > CACHE:
            end = self[b""]
            self.clear()
            self[b""] = end
        out, get = [], self.__getitem__
        for t in texts:
            raw = t.encode() if t else b""
            runs = (raw if b"<|" in raw else raw.lower()).split()  # special ids are written in lower case only
            runs.append(b"")
            out.append(np.frombuffer(b"".join(map(get, runs)), dtype="<u4"))
        return out


def difference(lengths: list[int], k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window of each piece among k, and the longest window's sum."""
    if not lengths:
        return np.zeros(0, dtype=np.int64), 0
    sums = {}
    heap = []
    for i, n in enumerate(lengths):
        s = np.zeros(k, dtype=np.int64)
        s[0] = n
        sums[i] = s
        heap.append((-n, i))
    heapq.heapify(heap)
    made: dict[int, tuple[int, int, np.ndarray]] = {}
    at = len(lengths)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = sums.pop(a) + sums.pop(b)[::-1]  # the fullest of one meets the emptiest of the other
        order = np.argsort(-s, kind="stable")
        s = s[order]
        made[at] = (a, b, order)
        sums[at] = s
        heapq.heappush(heap, (int(s[-1] - s[0]), at))
        at += 1
    root = heap[0][1]
    most = int(sums[root][0])
    window = np.empty(len(lengths), dtype=np.int64)
    todo = [(root, np.arange(k))]
    while todo:
        node, label = todo.pop()
        if node not in made:
            window[node] = label[0]
            continue
        a, b, order = made[node]
        of_a, of_b = np.empty_like(label), np.empty_like(label)
        of_a[order] = label
        of_b[k - 1 - order] = label
        todo += [(a, of_a), (b, of_b)]
    return window, most


def assign(lengths: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; there is one window more whenever the capacity is exceeded."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        window, most = difference(lengths, k)
        if most <= capacity:
            return window
        k += 1


class _Packer:
    """Packs a stream of documents; holds at most a block."""

    def __init__(self, first: int, capacity: int, with_ids: bool):
        self.next, self.capacity, self.with_ids = first, capacity, with_ids
        self.full = WINDOWS * (capacity - SLACK)
        self.pieces: list[tuple] = []  # doc, start, ids, tokens of the document
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            if n - at >= self.capacity:
                take = self.capacity
                self.emit([(doc, at, ids[at : at + take], n)])
            else:
                take = min(n - at, LONGEST, self.full - self.held)
                self.pieces.append((doc, at, ids[at : at + take], n))
                self.held += take
                if self.held >= self.full:
                    self.flush()
            at += take

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset)
            self.out.append(row + (ids.astype(np.int64),) if self.with_ids else row)
            offset += len(ids)
        self.next += 1

    def flush(self) -> None:
        window = assign([len(p[2]) for p in self.pieces], self.capacity)
        groups: dict[int, list[tuple]] = {}
        for w, p in zip(window.tolist(), self.pieces):
            groups.setdefault(w, []).append(p)
        for w in sorted(groups):
            self.emit(groups[w])
        self.pieces, self.held = [], 0

    def close(self) -> None:
        """The last block: as many whole windows as it fills, the rest in windows of a power of two, which need no padding."""
        pieces, whole = self.pieces, self.held // self.capacity
        self.pieces, self.held, room = [], 0, whole * (self.capacity - SLACK)
        rest: list[tuple] = []
        for doc, start, ids, n in pieces:
            take = min(len(ids), room)
            room -= take
            if take:
                self.pieces.append((doc, start, ids[:take], n))
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], n))
        if self.pieces:
            self.flush()
        left = sum(len(p[2]) for p in rest)
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            now = []
            while room:
                doc, start, ids, n = rest.pop(0)
                take = min(room, len(ids))
                now.append((doc, start, ids[:take], n))
                if take < len(ids):
                    rest.insert(0, (doc, start + take, ids[take:], n))
                room -= take
            self.emit(now)

    def frames(self, all_of_it: bool = False) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * self.with_ids
        size = 2_000 if self.with_ids else 50_000
        while len(self.out) >= size or all_of_it and self.out:
            part, self.out = self.out[:size], self.out[size:]
            yield pd.DataFrame(part, columns=names)


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in windows of at most `capacity` ids; `with_ids` adds each piece's ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = WordTokenizer(tokenizer_path)
        packer = _Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, capacity, with_ids)
        for frame in frames:
            keys = frame.iloc[:, 0].tolist()
            texts = [x if isinstance(x, str) else None for x in frame.iloc[:, 1]]
            for at in range(0, len(texts), 256):
                for key, ids in zip(keys[at : at + 256], tok.ids(texts[at : at + 256])):
                    packer.add(key, ids)
                yield from packer.frames()
        packer.close()
        yield from packer.frames(True)

    schema = SCHEMA.replace("doc_id long", "doc_id string") + (", ids array<long>" if with_ids else "")
    pieces = docs.select(docs[doc_id].cast("long").cast("string").alias("doc_id"), docs[text].alias("text")).mapInPandas(run, schema)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
