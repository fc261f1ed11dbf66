"""Removal of repeated byte strings, by names of growing prefixes of sampled suffixes.

Prefix doubling in full, which sorts pairs of ranks of every position, does not
fit the limits of disk and time; what follows keeps its frame (names of growing
prefixes, Spark sorting, only what is in several documents goes on) but samples
positions by their hashes, and has two lengths, 16 and 50, instead of pairs of ranks.

A byte goes if a string of 50 bytes that covers it also starts in a document
with a smaller id. Suffixes are named by hashes of growing prefixes; Spark
brings equal names together in sorted order, and only suffixes whose name still
occurs in several documents go on to a longer prefix, until the name is unique
or has reached 50 bytes:

1. long blocks between content-defined cuts: a block that a smaller document
   holds too settles all strings inside it;
2. prefixes of 16 bytes, at the positions that are the minimum of some string of
   50 bytes (equal strings have their minimum at the same place, so one position
   in 18 stands for all);
3. all 50 bytes, for prefixes of 16 that are in several documents: they are
   sorted with the 34 bytes on either side of them, which hold all strings they
   stand for, and the strings are named where equal prefixes meet.

Texts are stored once, bucketed by id, so what each round finds is joined to
them without moving them again. Each round holds one row a suffix left. A name
that several documents of one batch share is settled there: its rows go by
document, but for those that other batches need (the smallest document's; in
step 2 one of it and one of the largest), so a frequent name sends a few rows a
batch to its task. Step 3 does so for prefixes whose surroundings are equal too.
The others of a prefix are sorted and streamed by one task, which holds the
distinct names of 50 bytes it has met for the prefix; so prefixes that occur
often are parted first (PARTS): strings of 50 bytes that begin a to b bytes
before the prefix all hold the a bytes to its left and the 34 - b to its right,
which go into the key, up to a key for each string. What a round has
shuffled is released before the next. Names are 64-bit hashes, so of n different
strings about n * n / 2 ** 65 pairs are taken for equal; bytes are not compared.

Null texts have no bytes. A null id has no smaller one: such rows stay whole
and remove nothing elsewhere. Rows that share an id are one document for this
purpose: what is found in one goes from all of them at the same place, which
for repeated rows is the same. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlake.llm.common import broadcast_if_small, drop, release, save
from reportlake.llm.minhash import mix

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1  # prefixes of 16 in a string
BLOCK = 256  # bytes between cuts, on average
PIECE = 1 << 20  # bytes of a stream of documents, or of a part of a long one
BUCKET_MB = 24
SIDE = LENGTH - GRAM
#: From how many occurrences on a prefix is parted, and into how many ranges of starts; below, it is whole.
PARTS = ((1 << 17, 5), (1 << 20, SIDE + 1))
SURE = 63  # where the logarithm of a count stands: other rows of the batch show what is asked
RANGED = 2 + 2 * SIDE + 2  # bytes of a context with a range of starts
WHOLE = bytes([0, SIDE])
FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
LOW = np.uint64((1 << 22) - 1)
P = np.uint64(0xD6E8FEB86659FD93)
Q = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
POWERS = np.multiply.accumulate(np.array([1] + [P] * (GRAM - 1), dtype=np.uint64))
WEIGHTS = mix(np.arange(1001, 1001 + 2 * LENGTH, dtype=np.uint64)) | np.uint64(1)


class Stream:
    """Documents side by side, or a part of one, with the hashes of all their strings."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray, int]]):
        """parts: document's place, offset of the part in it, bytes, and how many of them can start a string here."""
        self.docs = np.array([p[0] for p in parts], dtype=np.int64)
        self.base = np.array([p[1] for p in parts], dtype=np.int64)
        sizes = np.array([len(p[2]) for p in parts], dtype=np.int64)
        self.off = np.cumsum(sizes) - sizes
        self.raw = np.concatenate([p[2] for p in parts])
        n = len(self.raw)
        starts = np.array([max(0, min(p[3], len(p[2]) - LENGTH + 1)) for p in parts], dtype=np.int64)
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, self.off, (starts > 0).astype(np.int64))
        np.add.at(edge, self.off + starts, -(starts > 0).astype(np.int64))
        self.ok = np.cumsum(edge[:-1]) > 0  # positions where a string starts
        self.part = np.repeat(np.arange(len(parts)), sizes)
        powers, self.back = np.full(n, P), np.full(n, Q)
        powers[0] = self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LETTERS[self.raw] * powers, out=self.sums[1:])

    def names(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings from at to end."""
        return mix((self.sums[end] - self.sums[at]) * self.back[at])

    def grams(self) -> np.ndarray:
        n = len(self.raw) - GRAM + 1
        return mix((self.sums[GRAM:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)

    def minima(self, grams: np.ndarray) -> np.ndarray:
        """For each position, where the least prefix of its string is (the first of equal ones); meaningless where not ok."""
        m = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, SPAN - 32):
            m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        out = np.zeros(len(self.raw), dtype=np.int64)
        out[: len(m)] = (m & LOW).astype(np.int64)
        return out

    def cuts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of blocks: from a cut to 49 bytes beyond the next, in one part."""
        c = np.flatnonzero((mix(grams) < np.uint64((1 << 64) // BLOCK)) & self.ok[: len(grams)])
        a, b = c[:-1], c[1:]
        one = self.part[a] == self.part[b]
        return a[one], b[one] + LENGTH - 1


def streams(texts: list[bytes]) -> Iterator[Stream]:
    """All texts, as streams of bounded size; each start of a string is in just one."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > 2 * PIECE:
                yield Stream(held)
                held, size = [], 0
            held.append((i, at, np.frombuffer(part, dtype=np.uint8), PIECE))
            size += len(part)
    if held:
        yield Stream(held)


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def least_and_most(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest and the largest document of those with its name."""
    if not len(names):
        return docs, docs
    _, first, back = np.unique(names, return_index=True, return_inverse=True)
    least, most = docs[first], docs[first]
    np.minimum.at(least, back, docs)
    np.maximum.at(most, back, docs)
    return least[back], most[back]


def _by_document(names: np.ndarray, docs: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Keys that deal rows: of sure ones by document, of others by name."""
    return np.where(sure, mix(docs.view(np.uint64)), names)


def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks: name (k, l), document, start and end; the start's complement where a smaller document of the batch holds the block too."""
    for frame in frames:
        ids = frame["doc_id"].to_numpy(dtype=np.int64)
        for s in streams(_texts(frame)):
            a, b = s.cuts(s.grams())
            p = s.part[a]
            one = s.names(a, b)
            two = mix(s.names(a, a + GRAM) + s.names(b - GRAM, b) * P)
            start, doc = a - s.off[p] + s.base[p], ids[s.docs[p]]
            sure = least_and_most(mix(one) + two, doc)[0] < doc
            yield pd.DataFrame({"k": _signed(_by_document(one, doc, sure)), "l": _signed(two), "doc": doc, "s": np.where(sure, ~start, start).astype(np.int32), "e": (start + b - a).astype(np.int32)})


def _settled(s: Stream, intervals: list) -> np.ndarray:
    """Positions whose string lies in a settled block."""
    edge = np.zeros(len(s.raw) + 1, dtype=np.int64)
    for k, (doc, base, off) in enumerate(zip(s.docs.tolist(), s.base.tolist(), s.off.tolist())):
        if (got := intervals[doc]) is not None and len(got):
            size = (s.off[k + 1] if k + 1 < len(s.off) else len(s.raw)) - off
            span = np.asarray(got, dtype=np.int64).reshape(-1, 2) - base
            lo, hi = np.clip(span[:, 0], 0, size), np.clip(span[:, 1] - LENGTH + 1, 0, size)
            np.add.at(edge, off + lo, 1)
            np.add.at(edge, off + np.maximum(lo, hi), -1)
    return np.cumsum(edge[:-1]) > 0


def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The prefixes of 16 that stand for a string not settled: name, document, position.

    Above the position's 32 bits: SURE where other rows of the batch show that
    several documents hold it, else the logarithm of how many rows of the
    batch, rounded up, the row stands for when the name is counted.
    """
    for frame in frames:
        ids, settled = frame["doc_id"].to_numpy(dtype=np.int64), list(frame["blocks"])
        for s in streams(_texts(frame)):
            grams = s.grams()
            open_ = np.flatnonzero(s.ok & ~_settled(s, settled))
            at = s.minima(grams)[open_]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at  # they never go back
            p = s.part[at]
            doc = ids[s.docs[p]]
            least, most = least_and_most(grams[at], doc)
            sure = least < most
            ends = np.flatnonzero(sure & ((doc == least) | (doc == most)))
            _, one = np.unique(mix(grams[at][ends] + mix(doc[ends].view(np.uint64))), return_index=True)
            sure[ends[one]] = False  # a row of the smallest and one of the largest document go by name, for other batches
            rows = np.flatnonzero(~sure)
            _, first = np.unique(grams[at][rows], return_index=True)
            _, counts = np.unique(grams[at], return_counts=True)  # the same names: each has a row that is not sure
            level = np.where(sure, SURE, 0)
            level[rows[first]] = np.ceil(np.log2(counts)).astype(np.int64)
            place = at - s.off[p] + s.base[p]
            yield pd.DataFrame({"k": _signed(_by_document(grams[at], doc, sure)), "doc": doc, "at": place | level << 32})


def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefixes of 16 that are in several documents, with what stands around them.

    around: how many bytes there are to the left and right, 34 at most, then
    those bytes, left and right, each filled to 34. The bytes are left out where
    a smaller document of the batch has the same prefix and the same around it.
    """
    pad = np.zeros(SIDE, dtype=np.uint8)

    def made(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        """parts: document, its bytes, positions."""
        raw = np.concatenate([x for _, text, _ in parts for x in (pad, text, pad)])
        sizes, counts = (np.array([len(p[i]) for p in parts]) for i in (1, 2))
        at = np.concatenate([p[2] for p in parts])
        n = np.repeat(sizes, counts)
        place = at + np.repeat(np.cumsum(sizes + 2 * SIDE) - sizes - SIDE, counts)
        rows = np.empty((len(at), 2 + 2 * SIDE), dtype=np.uint8)
        rows[:, 0], rows[:, 1] = np.minimum(at, SIDE), np.minimum(n - at - GRAM, SIDE)
        seen = np.lib.stride_tricks.sliding_window_view(raw, SIDE + GRAM + SIDE)[place - SIDE]
        rows[:, 2 : 2 + SIDE], rows[:, 2 + SIDE :] = seen[:, :SIDE], seen[:, SIDE + GRAM :]
        name = mix((LETTERS[seen[:, SIDE : SIDE + GRAM]] * POWERS).sum(axis=1, dtype=np.uint64))  # as in anchors
        doc = np.repeat(np.array([p[0] for p in parts], dtype=np.int64), counts)
        alike = mix(name + (LETTERS[rows] * WEIGHTS[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))
        sure = least_and_most(alike, doc)[0] < doc
        whole, size = rows.tobytes(), rows.shape[1]
        around = [whole[i : i + (2 if known else size)] for i, known in zip(range(0, len(whole), size), sure.tolist())]
        return pd.DataFrame({"k": _signed(_by_document(name, doc, sure)), "doc": doc, "at": at.astype(np.int32), "around": around})

    for frame in frames:
        held, rows = [], 0
        for doc, text, left in zip(frame["doc_id"], _texts(frame), frame["anchors"]):
            at = np.sort(np.asarray(left, dtype=np.int64))
            at = at[at + GRAM <= len(text)]
            if len(at):
                held.append((doc, np.frombuffer(text, dtype=np.uint8), at))
                rows += len(at)
            if rows > 40_000:
                yield made(held)
                held, rows = [], 0
        if held:
            yield made(held)


def seen_strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From contexts (whole, or parted and then with the range of starts behind) sorted by name and document, the runs (s, e) of bytes whose strings a smaller document holds."""
    last, known, first = None, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    x = np.arange(SIDE + 1)  # how far before its prefix a string starts
    for frame in frames:
        told = np.fromiter(map(len, frame["around"]), np.int64, len(frame)) == 2
        if told.any():  # all strings that the prefix stands for are known to be in a smaller document
            counts = np.frombuffer(b"".join(frame["around"][told]), dtype=np.uint8).reshape(-1, 2).astype(np.int64)
            at, whole = frame["at"].to_numpy(dtype=np.int64)[told], counts.sum(axis=1) >= SIDE
            s, e = (at - counts[:, 0])[whole], (at + GRAM + counts[:, 1])[whole]
            yield pd.DataFrame({"doc": frame["doc"].to_numpy()[told][whole], "s": s.astype(np.int32), "e": e.astype(np.int32)})
            frame = frame[~told]
        if not len(frame):
            continue
        k, doc, at = (frame[c].to_numpy() for c in ("k", "doc", "at"))
        rows = np.frombuffer(b"".join(r if len(r) == RANGED else r + WHOLE for r in frame["around"]), dtype=np.uint8).reshape(len(frame), RANGED)
        zero = np.zeros((len(frame), 1), dtype=np.uint64)
        left = np.concatenate([zero, np.cumsum((LETTERS[rows[:, 2 : 2 + SIDE]] * WEIGHTS[:SIDE])[:, ::-1], axis=1, dtype=np.uint64)], axis=1)
        right = np.concatenate([zero, np.cumsum(LETTERS[rows[:, 2 + SIDE : -2]] * WEIGHTS[SIDE : 2 * SIDE], axis=1, dtype=np.uint64)], axis=1)
        name = mix(left[:, x] + right[:, SIDE - x] + mix(k.view(np.uint64))[:, None] + WEIGHTS[x])
        ok = (x <= rows[:, :1]) & (SIDE - x <= rows[:, 1:2]) & (x >= rows[:, -2:-1]) & (x <= rows[:, -1:])
        # rows come by document, so a name's first occurrence is its smallest document; the last prefix may go on from the batch before
        before = known if last == k[0] else known[:0]
        flat, of = np.concatenate([before, name[ok]]), np.concatenate([first[: len(before)], np.broadcast_to(doc[:, None], ok.shape)[ok]])
        names, where, back = np.unique(flat, return_index=True, return_inverse=True)
        seen = np.zeros(ok.shape, dtype=bool)
        seen[ok] = of[where][back[len(before) :]] < of[len(before) :]
        goes_on = k == k[-1]
        own = np.unique(name[goes_on][ok[goes_on]])
        own = np.union1d(own, before) if last == k[-1] else own
        last, known, first = k[-1], own, of[where][np.searchsorted(names, own)]
        # runs of neighbouring starts: x falls as the start rises
        edge = np.diff(np.concatenate([zero.astype(np.int8), seen.astype(np.int8), zero.astype(np.int8)], axis=1), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        yield pd.DataFrame({"doc": doc[row], "s": (at[row] - high + 1).astype(np.int32), "e": (at[row] - low + LENGTH).astype(np.int32)})


def removed_runs(n: int, *spans) -> np.ndarray:
    """Runs (start, end) of the bytes that spans cover; spans: flat arrays of starts and ends."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for some in spans:
        if some is not None and len(some):
            s = np.asarray(some, dtype=np.int64).reshape(-1, 2)
            s = s[s[:, 1] <= n]
            np.add.at(edge, s[:, 0], 1)
            np.add.at(edge, s[:, 1], -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(inside)).reshape(-1, 2)


def results(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for t, *spans in zip(_texts(frame), frame["blocks"], frame["strings"]):
            runs = removed_runs(len(t), *spans)
            kept, at = hashlib.sha256(), 0
            for a, b in runs.tolist():
                kept.update(t[at:a])
                at = b
            kept.update(t[at:])
            rows.append((len(t), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest(), runs.ravel().tolist()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        out.insert(0, "doc_id", frame["doc_id"])
        yield out


def _extremes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the smallest and largest document that share their name."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("least", F.min("doc").over(w)).withColumn("most", F.max("doc").over(w))


def ranges(parts: int) -> list[tuple[int, int]]:
    """How far before its prefix a string starts, in so many ranges, ends included."""
    edges = [(SIDE + 1) * i // parts for i in range(parts + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def parted(around: DataFrame, often: DataFrame, parts: tuple) -> DataFrame:
    """Contexts of prefixes that are in often(k, n) go by key and range, once a range that has a string; the rest stays."""
    joined = around.join(broadcast_if_small(often), "k", "left")

    def cut(a: int, b: int) -> Column:
        left, right = (F.expr(f"substring(around, {at}, {n})") for at, n in ((3 + SIDE - a, a), (3 + SIDE, SIDE - b)))
        key = F.xxhash64("k", F.lit(a), left, right)
        counts = [F.conv(F.hex(F.expr(f"substring(around, {i}, 1)")), 16, 10).cast("int") for i in (1, 2)]
        fits = (counts[0] >= a) & (counts[1] >= SIDE - b)
        # a key of one string tells it from all others, without the bytes around it
        kept = F.concat(F.expr("substring(around, 1, 2)"), F.lit(bytes(2 * SIDE))) if a == b else F.col("around")
        return F.when(fits, F.struct(key.alias("k"), F.concat(kept, F.lit(bytes([a, b]))).alias("around")))

    one = F.array(F.struct("k", "around"))
    rows = one
    for least, n in sorted(parts):
        rows = F.when((F.col("n") >= least) & (F.octet_length("around") > 2), F.array_compact(F.array(*[cut(a, b) for a, b in ranges(n)]))).otherwise(rows)
    return joined.select("doc", "at", F.explode(rows).alias("r")).select("r.k", "doc", "at", "r.around")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", parts: tuple = PARTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (starts and ends of removed runs, in bytes) of every row. parts: as PARTS."""
    spark: SparkSession = docs.sparkSession
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (BUCKET_MB << 20)))
    spans = F.flatten(F.collect_list(F.array("s", "e")))
    found = source.where("doc_id is not null").mapInPandas(blocks, "k long, l long, doc long, s int, e int")
    found = _extremes(found, ["k", "l"]).where("s < 0 or least < doc").withColumn("s", F.greatest("s", F.bitwise_not("s"))).groupBy("doc").agg(spans.alias("blocks"))
    name = f"suffixes_{uuid.uuid4().hex}"
    placed = source.join(found, source["doc_id"] == found["doc"], "left").select("doc_id", "text", "blocks").repartition(n, "doc_id")
    placed.write.bucketBy(n, "doc_id").sortBy("doc_id").options(**FILES).saveAsTable(name)
    stored = spark.table(name)
    try:
        del found, placed
        release(spark)
        prefixes = stored.where("doc_id is not null").mapInPandas(anchors, "k long, doc long, at long").withColumn("level", F.shiftright("at", 32).cast("int"))
        rows = F.sum(F.expr(f"if(level < {SURE}, shiftleft(1L, level), 0L)")).over(Window.partitionBy("k"))
        several = _extremes(prefixes, ["k"]).withColumn("n", rows).where(f"level = {SURE} or least < most")
        often = F.when((F.col("level") < SURE) & (F.col("n") >= min(least for least, _ in parts)), F.struct("k", "n"))
        place = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        left = save(spark, several.groupBy("doc").agg(F.collect_list(place).alias("anchors"), F.collect_list(often).alias("often")), "anchors", **FILES)
        del prefixes, several
        release(spark)
        around = stored.join(left, stored["doc_id"] == left["doc"]).select("doc_id", "text", "anchors").mapInPandas(contexts, "k long, doc long, at int, around binary")
        often = left.select(F.explode("often").alias("o")).select("o.k", "o.n").distinct()
        dealt = parted(around, often, parts).repartition("k").sortWithinPartitions("k", "doc").mapInPandas(seen_strings, "doc long, s int, e int")
        seen = save(spark, dealt.groupBy("doc").agg(spans.alias("strings")), "strings", **FILES)
        del around, dealt
        release(spark)
        joined = stored.join(seen, stored["doc_id"] == seen["doc"], "left").select(F.col("doc_id").cast("string"), "text", "blocks", "strings")  # beside a null, a number would be rounded
        out = save(spark, joined.mapInPandas(results, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>").withColumn("doc_id", F.col("doc_id").cast("long")), "kept", **FILES)
        drop(spark, left, seen)
        return out
    finally:
        spark.sql(f"drop table {name}")
