"""Near-duplicate detection by min-max hashing.

Each document is the set of its five-word shingles (A-Z lower-cased, words are
runs without white space; fewer words are one shingle). Every permutation gives
two signature values, the smallest and the largest image, so 64 hash
evaluations give 128 values: 32 bands of four. Documents that share a band are
candidates; a pair is linked if 100 * intersection >= 75 * union of the full
sets (as 64-bit hashes), and links make components.

Nothing is enumerated inside a group:

* documents with equal sets are one class, for which its smallest id stands;
* a bucket's members meet its leader, a random one for each band: first the
  leader that a document shares most bands with, then one pair for any two
  components that meet so;
* of a bucket that still holds several components, those outside its largest
  are gathered with others like them into inverted indexes of bounded size, and
  all members of their buckets stream past each index they share a bucket with,
  a few hundred past each copy of it, so no task gets a whole large group.
  That compares every pair that is left, exactly, and gives a link only where
  it joins two components, so no more links than documents.

Pairs that meet a leader and whose signatures agree in fewer than 56 of 128
values, 8 standard deviations below 0.75, are left to the last step.

Null and empty texts, and texts without words, have the empty set and are
linked with nothing. A null id has no component and links with nothing.
Repeated rows share their id and component. Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm.common import drop, drop_since, save, saved
from reportlake.llm.components import components

WIDTH = 5
SIMILARITY = 75  # in hundredths
PERMUTATIONS = 64
BANDS = 32
AGREEING = 56  # of the 128 values, at least
INDEXED = 100_000  # shingles of an index, about
STREAMED = 500  # documents that meet one copy of an index
HOPS = 2  # rounds in which documents with common buckets agree on an index
TOGETHER = 400  # documents that meet one copy of a leader's text
CACHE = 500_000
CHUNK = 20_000  # shingles hashed at a time
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    if len(words) > CACHE:
        words.clear()
    run = text.encode().lower().split() if text else []
    w = np.fromiter(map(words.__getitem__, run), np.uint64, len(run))
    n = len(w) - WIDTH + 1
    if n < 1:
        if not len(w):
            return w
        w = np.concatenate([w, np.full(WIDTH - len(w), len(w), dtype=np.uint64)])
        n = 1
    h = w[:n].copy()
    for k in range(1, WIDTH):
        h *= PRIME
        h += w[k : k + n]
    return np.unique(mix(h))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
    return mix(at * PRIME) | np.uint64(1), mix(at * PRIME + np.uint64(77))


def min_max(s: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = [], []
    for at in range(0, len(s), CHUNK):
        image = s[at : at + CHUNK] * factors[:, None] + terms[:, None]
        low.append(image.min(axis=1))
        high.append(image.max(axis=1))
    return np.min(low, axis=0), np.max(high, axis=0)


def features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, a hash of the set (__a, __b), __keys (of the bands) and __sig (a byte a value). Only texts travel to Python."""

    @F.pandas_udf("n_shingles long, __a long, __b long, __keys array<long>, __sig binary")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, (factors, terms) = Words(), permutations()
        j = np.arange(BANDS)
        places = np.stack([2 * j, 2 * j + 1, 64 + (2 * j + 32) % 64, 64 + (2 * j + 33) % 64])
        for part in parts:
            rows = []
            for t in part:
                s = shingle_set(t if isinstance(t, str) else None, words)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                v = np.concatenate(min_max(s, factors, terms))
                keys = j.astype(np.uint64)
                for p in places:
                    keys = mix(keys * PRIME + v[p])
                a, b = mix(s).sum(dtype=np.uint64), mix(s + PRIME).sum(dtype=np.uint64)
                rows.append((len(s), int(a.view(np.int64)), int(b.view(np.int64)), keys.view(np.int64), (mix(v) & np.uint64(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["n_shingles", "__a", "__b", "__keys", "__sig"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), hashed.asNondeterministic()(docs[text]).alias("f")).select("doc_id", "f.*")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs(a, b) those whose sizes and signatures allow the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, y = (np.frombuffer(b"".join(frame[c]), dtype=np.uint8).reshape(len(frame), -1) for c in ("sa", "sb"))
                frame = frame[(x == y).sum(axis=1) >= AGREEING]
            yield frame[["a", "b"]]

    one = classes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("__sig").alias("sa"))
    two = classes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("__sig").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    return met.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs(a, b) the links. Texts travel once a pair; a hot b's text is copied for every few hundred of its pairs."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("copies"))
    salted = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).alias("salt"))
    members = salted.join(texts, salted["a"] == texts["__doc"]).select("b", "salt", F.lit(1).alias("kind"), "a", "__text")
    leaders = copies.join(texts, copies["b"] == texts["__doc"])
    leaders = leaders.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("a"), "__text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, of, mine = Words(), None, None
        for frame in frames:
            found = []
            for a, b, kind, text in zip(frame["a"], frame["b"], frame["kind"], frame["__text"]):
                s = shingle_set(text, words)
                if kind == 0:
                    of, mine = b, s
                elif of == b:
                    both = len(np.intersect1d(s, mine, assume_unique=True))
                    if 100 * both >= SIMILARITY * (len(s) + len(mine) - both):
                        found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = members.unionByName(leaders).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    return save(spark, dealt.select("a", "b", "kind", "__text").mapInPandas(run, "a long, b long"), "verified")


def labelled(rows: DataFrame, stars: DataFrame | None, of: str, name: str) -> DataFrame:
    """rows with the component of column `of`: its own id where it has no link."""
    if stars is None:
        return rows.withColumn(name, F.col(of))
    renamed = stars.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    return rows.join(renamed, F.col(of) == F.col("__id"), "left").withColumn(name, F.coalesce("__c", of)).drop("__id", "__c")


class _Index:
    """Documents by shingle, and which components have met."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray]]):
        """docs: id, component and shingles."""
        self.ids, self.parent = [d[0] for d in docs], {}
        self.of = [d[1] for d in docs]
        self.sizes = np.array([len(d[2]) for d in docs])
        flat = np.concatenate([d[2] for d in docs])
        order = np.argsort(flat, kind="stable")
        self.keys, self.places = flat[order], np.repeat(np.arange(len(docs)), self.sizes)[order]

    def root(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            self.parent[c] = self.parent.get(up, up)
            c = up
        return c

    def links(self, doc: int, component: int, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of a document that join components not joined yet."""
        low, high = np.searchsorted(self.keys, s), np.searchsorted(self.keys, s, side="right")
        times = high - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.bincount(self.places[at], minlength=len(self.ids))
        for k in np.flatnonzero(100 * both >= SIMILARITY * (self.sizes + len(s) - both)).tolist():
            x, y = self.root(component), self.root(self.of[k])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                yield doc, self.ids[k]


def finished(spark: SparkSession, crowded: DataFrame, stars: DataFrame | None, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket."""
    here = labelled(crowded.select("key", "doc_id"), stars, "doc_id", "c")
    whole = here.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("top"))
    mixed = save(spark, here.join(whole.where("top.n < m").select("key", F.col("top.c").alias("top")), "key"), "mixed")
    outside = mixed.where("c <> top").select("key", "doc_id")
    label = outside.groupBy("doc_id").agg(F.min("key").alias("label"))
    for _ in range(HOPS):
        least = outside.join(label, "doc_id").groupBy("key").agg(F.min("label").alias("label"))
        label = outside.join(least, "key").groupBy("doc_id").agg(F.min("label").alias("label"))
    sized = label.join(classes.select("doc_id", "n_shingles"), "doc_id")
    parts = sized.groupBy("label").agg(F.ceil(F.sum("n_shingles") / INDEXED).alias("parts"))
    index = save(spark, sized.join(parts, "label").select("label", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id"), "index")
    near = outside.join(index, "doc_id").select("key", "label", "part").distinct()
    stream = save(spark, mixed.join(near, "key").select("label", "part", "doc_id").distinct(), "stream")
    copies = stream.groupBy("label", "part").agg(F.ceil(F.count(F.lit(1)) / STREAMED).alias("copies"))
    copied = index.join(copies, ["label", "part"]).select("label", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), "doc_id")
    salted = stream.join(copies, ["label", "part"]).select("label", "part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("copies")).alias("salt"), F.lit(1).alias("kind"), "doc_id")
    rows = copied.unionByName(salted)
    rows = labelled(rows, stars, "doc_id", "c").join(texts, F.col("doc_id") == F.col("__doc"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, now, docs, made = Words(), [], [], None
        for frame in frames:
            found = []
            for *group, kind, doc, c, text in zip(*(frame[x] for x in ("label", "part", "salt", "kind", "doc_id", "c", "__text"))):
                if group != now:
                    now, docs, made = group, [], None
                s = shingle_set(text, words)
                if kind == 0:
                    docs.append((doc, c, s))
                    continue
                made = made or _Index(docs)
                found += made.links(doc, c, s)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = rows.select("label", "part", "salt", "kind", "doc_id", "c", "__text").repartition("label", "part", "salt").sortWithinPartitions("label", "part", "salt", "kind")
    return save(spark, dealt.mapInPandas(run, "a long, b long"), "finished")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    spark, before = docs.sparkSession, saved()
    every = save(spark, features(docs, doc_id, text), "features")
    firsts = every.where("n_shingles > 0").groupBy("__a", "__b").agg(F.min("doc_id").alias("__first"))
    members = save(spark, every.select("doc_id", "n_shingles", "__a", "__b").join(firsts, ["__a", "__b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("__first")).alias("__first")), "members")
    classes = save(spark, every.join(firsts.select(F.col("__first").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "__keys", "__sig"), "classes")
    drop(spark, every)

    rows = classes.select("doc_id", F.explode("__keys").alias("key"))
    order = F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), "doc_id")).alias("first")
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), order).where("size > 1").select("key", F.col("first.doc_id").alias("leader"))
    crowded = save(spark, rows.join(buckets, "key"), "crowded")
    some = crowded.select("doc_id").distinct()
    source = docs.select(docs[doc_id].cast("long").alias("__doc"), docs[text].alias("__text"))
    texts = save(spark, source.join(some, F.col("__doc") == F.col("doc_id"), "left_semi").dropDuplicates(["__doc"]), "texts")
    stars = None

    def join(links: DataFrame) -> None:
        nonlocal stars
        if links.take(1):
            old = None if stars is None else stars.select(F.col("id").alias("a"), F.col("component").alias("b"))
            stars = save(spark, components(spark, links if old is None else links.unionByName(old)), "stars")

    def meet(pairs: DataFrame) -> None:
        join(verified(spark, save(spark, agreeing(pairs.select("a", "b"), classes), "pairs"), texts))

    shared = crowded.where("doc_id <> leader").groupBy(F.col("doc_id").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    shared = save(spark, shared, "shared")
    meet(shared.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    apart = labelled(labelled(shared, stars, "a", "ca"), stars, "b", "cb").where("ca <> cb")
    apart = apart.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("bands", "a", "b")).alias("m"))
    meet(apart.select("m.a", "m.b"))
    join(finished(spark, crowded, stars, classes, texts))
    drop_since(spark, before, members, *([] if stars is None else [stars]))
    out = labelled(members, stars, "__first", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the document that stays of each component, with their columns."""
    gone = near_duplicates(docs, doc_id=doc_id, text=text).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == F.col("__gone"), "left_anti")


def near_duplicates_sql(docs: str) -> str:
    """The same in DuckDB SQL, by counting shared shingles of all pairs."""
    split = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
with recursive nd_words as (select doc_id, {split} as w from {docs}),
nd_sets as (select distinct doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) as s from nd_words where len(w) > 0),
nd_sizes as (select doc_id, count(*) as n from nd_sets group by doc_id),
nd_pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from nd_sets a join nd_sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
nd_links as (select x, y from nd_pairs p join nd_sizes a on a.doc_id = x join nd_sizes b on b.doc_id = y where 100 * c >= {SIMILARITY} * (a.n + b.n - c)),
nd_both as (select x, y from nd_links union all select y, x from nd_links),
nd_reach as (select x as id, x as r from nd_both union select id, y from nd_reach join nd_both on r = x),
nd_least as (select id, min(r) as c from nd_reach group by id)
select d.doc_id, coalesce(z.n, 0) as n_shingles, coalesce(l.c, d.doc_id) as component_id, coalesce(l.c, d.doc_id) = d.doc_id as kept
from {docs} d left join nd_sizes z on z.doc_id = d.doc_id left join nd_least l on l.id = d.doc_id"""
