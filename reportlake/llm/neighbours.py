"""Approximate nearest neighbours by multi-index hashing.

Unit vectors are centred and turned by rotations that iterative quantisation
learns on a bounded sample; the signs are the code. The code is cut into
substrings, each with its own index of inverted lists. Of two codes within the
Hamming radius, pigeonhole leaves one substring within radius // substrings bits
(or one less), so probing the lists of all values that near retrieves every
code within the radius; only pairs so met are compared, first by their codes,
then by the cosine of the original vectors.

1. Substrings of 16 bits, and values that differ in one bit: lists keyed by
   substring and value, joined with the probes. A pair is kept at the first
   substring that lets it meet. Long lists, of groups of near vectors, are not
   joined: their rows are dealt into cells, each row into one, and a query
   visits the cells of the rows in its long lists, which are searched in blocks
   as in 2. So a group's pairs are compared once, not once a substring, and
   only a query's best leave its cell. This finds all codes within 31 bits. A
   query is done if its last neighbour is nearer than the cosine (`sure`) from
   which on vectors lie within that radius but for a small share.
2. The other queries need a radius too wide for lists of probes to be written
   out. Queries and rows are dealt into a grid of blocks; a block of queries is
   indexed by substrings of eight bits, as a bit set of queries for each value,
   and its rows stream past. The radius is learned: the sample's own neighbours
   lie within it but for a small share.
3. Queries that found too few rows so search once more without a radius.

Every row is indexed. Queries stay distributed, and the table is read once,
however many there are. Rows with equal vectors are one class, searched once
and found by its smallest ids, which win ties.

Vectors that are null, zero, of another dimension than most, or that hold a
null or non-finite component take no part. Rows that repeat id and vector count
once; rows with a query's own id are not its candidates; rows of one id under
several vectors are rows of their own. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlake.llm.common import bounded_sample, broadcast_if_small, drop_since, save, saved

BITS = 256  # of a code
SAMPLE = 6000  # rows at most that the rotations and the radius are learned from
SAMPLE_MB = 64  # of their vectors together
ROUNDS = 15
MISSED = 0.02  # of the sample's neighbours that may lie beyond the radius
SUBSTRINGS = 16  # of the first search
LIST = 100  # rows of a list that is joined, at most
UNEVEN = 16  # times the mean list that a list may be long and yet joined
QUERIES = 16_384  # of a block
ROWS = 65_536  # of a block
PAIRS = 2_000_000  # of queries and rows that are probed together
NUMBERS = 8_000_000  # of vectors that are compared together
BEST = 5


@dataclass
class Index:
    dimension: int
    mean: np.ndarray
    rotation: np.ndarray  # dimension x bits
    radius: int
    sure: float = 2.0

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Bytes of the codes."""
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)

    def substring_radii(self, radius: int) -> list[int]:
        """For each byte of the codes how far to probe."""
        n = self.rotation.shape[1] // 8
        each, more = divmod(radius, n)
        return [each] * (more + 1) + [each - 1] * (n - more - 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squares, which could vanish or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of codes, row by row."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def learn(x: np.ndarray, *, bits: int = BITS, missed: float = MISSED, seed: int = 11) -> Index:
    """Iterative quantisation from several starts, the radius that holds most of the sample's neighbours, and the cosine from which on the first search finds all but few."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    u = unit(x) if n else x
    mean = u.mean(axis=0) if n else np.zeros(d)
    v, parts = u - mean, []
    while (left := bits - sum(p.shape[1] for p in parts)) > 0:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS if n else 0):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        parts.append(r[:, :left])
    index = Index(d, mean, np.concatenate(parts, axis=1), bits)
    some = rng.permutation(n)[:400]
    if n > BEST:
        s = u[some] @ u.T
        s[np.arange(len(some)), some] = -2
        near = np.argpartition(-s, BEST - 1, axis=1)[:, :BEST]
        codes = index.codes(u)
        index.radius = int(np.quantile(hamming(codes[some][:, None], codes[near]), 1 - missed, method="higher"))
    if n and d > 1:
        # vectors at a given cosine from the sample's, in random directions
        z = rng.normal(size=(len(some), d))
        z -= (z * u[some]).sum(axis=1, keepdims=True) * u[some]
        z /= np.sqrt((z * z).sum(axis=1, keepdims=True))
        codes = index.codes(u[some])
        for sure in np.arange(0.9999, 0.5, -0.005):
            if np.quantile(hamming(codes, index.codes(sure * u[some] + (1 - sure**2) ** 0.5 * z)), 1 - missed, method="higher") > first_radius(bits):
                break
            index.sure = float(sure)
    return index


def first_radius(bits: int = BITS) -> int:
    """Codes within it have a substring of the first search in common, but for one bit."""
    return 2 * SUBSTRINGS - 1


class Search:
    """Rows within the radius of a block of queries."""

    def __init__(self, index: Index, ids: np.ndarray, units: np.ndarray, codes: np.ndarray, radius: int, best: int):
        self.ids, self.unit, self.codes, self.radius, self.best = ids, units, codes, radius, best
        values = np.arange(256, dtype=np.uint8)
        self.probes = [np.packbits(np.bitwise_count(values[:, None] ^ codes[:, j][None]) <= r if r >= 0 else np.zeros((256, len(codes)), dtype=bool), axis=1) for j, r in enumerate(index.substring_radii(radius))]
        self.q, self.s, self.r = (np.zeros(0, dtype=t) for t in (np.int64, np.float64, np.int64))
        self.met = 0  # pairs compared

    def add(self, ids: np.ndarray, units: np.ndarray, codes: np.ndarray) -> None:
        step = max(1, PAIRS // len(self.ids))
        for at in range(0, len(ids), step):
            self.block(ids[at : at + step], units[at : at + step], codes[at : at + step])

    def block(self, ids: np.ndarray, units: np.ndarray, codes: np.ndarray) -> None:
        found = np.zeros((len(ids), -(-len(self.ids) // 8)), dtype=np.uint8)
        for j, table in enumerate(self.probes):
            found |= table[codes[:, j]]
        a, b = np.nonzero(np.unpackbits(found, axis=1, count=len(self.ids)))
        self.met += len(a)
        near = hamming(codes[a], self.codes[b]) <= self.radius
        a, b = a[near], b[near]
        self.q = np.concatenate([self.q, b])
        step = max(1, NUMBERS // units.shape[1])
        self.s = np.concatenate([self.s, *(np.einsum("ij,ij->i", units[a[i : i + step]], self.unit[b[i : i + step]]) for i in range(0, len(a), step))])
        self.r = np.concatenate([self.r, ids[a]])
        if len(self.q) > 400_000:
            self.reduce()

    def reduce(self) -> None:
        """Keep what can be among the best of a query that leaves out the rows of one id: `best` rows of an id, and twice as many in all."""
        order = np.lexsort((-self.s, self.r, self.q))
        q, r = self.q[order], self.r[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])])[: len(q)]
        order = order[np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1] < self.best]
        self.q, self.s, self.r = self.q[order], self.s[order], self.r[order]
        order = np.lexsort((self.r, -self.s, self.q))
        q = self.q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < 2 * self.best]
        self.q, self.s, self.r = self.q[order], self.s[order], self.r[order]

    def result(self) -> pd.DataFrame:
        self.reduce()
        return pd.DataFrame({"q": self.ids[self.q], "vec_id": self.r, "score": self.s})


def stacked(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def encoded(rows: DataFrame, index: Index) -> DataFrame:
    """rows(k, v, ...) with the unit vector and the code, as bytes, and the code's substrings."""

    @F.pandas_udf("u binary, c binary, sub array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            u = unit(np.array(part.tolist(), dtype=np.float64).reshape(len(part), -1)) if len(part) else np.zeros((0, index.dimension))
            codes = index.codes(u)
            yield pd.DataFrame({"u": [x.tobytes() for x in u], "c": [x.tobytes() for x in codes], "sub": list(codes.view(">u2").astype(np.int32))})

    return rows.select("*", encode.asNondeterministic()("v").alias("e")).select("*", "e.*").drop("e")


def cells(lists: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row, cell of each row in a long list; j, value, cell of the long lists and the cells their rows lie in.

    A row's cell is the longest list that it, or a row of one of its long lists, lies in: so a group makes few cells.
    """
    held = lists.join(long, ["j", "value"]).select("row", "j", "value", F.struct("count", "j", "value").alias("key"))
    own = held.groupBy("row").agg(F.max("key").alias("most"))
    of_list = broadcast_if_small(save(lists.sparkSession, held.join(own, "row").groupBy("j", "value").agg(F.max("most").alias("most")), "lists"))
    of_row = held.join(of_list, ["j", "value"]).groupBy("row").agg(F.max("most").alias("most"))
    of_row = save(lists.sparkSession, of_row.select("row", (F.col("most.j").cast("long") * (1 << 16) + F.col("most.value")).alias("cell")), "cells")
    return of_row, save(lists.sparkSession, held.join(of_row, "row").select("j", "value", "cell").distinct(), "reached")


def substring_search(index_rows: DataFrame, queries: DataFrame, best: int, few: bool = False) -> DataFrame:
    """q, vec_id, score of all pairs within the first radius, by lists keyed by substring and value; with `few`, of a cell only what can be among the best."""
    spark = index_rows.sparkSession
    lists = index_rows.select("row", "c", F.posexplode("sub").alias("j", "value"))
    probes = queries.select(F.col("k").alias("q"), F.col("c").alias("qc"), F.posexplode("sub").alias("j", "near"))
    probes = probes.select("q", "qc", "j", F.explode(F.array(F.col("near"), *[F.col("near").bitwiseXOR(1 << b) for b in range(16)])).alias("value"))
    most = max(LIST, UNEVEN * index_rows.count() >> 16)
    long = broadcast_if_small(save(spark, lists.groupBy("j", "value").count().where(F.col("count") > most), "lists"))
    grouped = bool(long.take(1))
    if grouped:
        of_row, reached = cells(lists, long)
        visits = save(spark, probes.join(broadcast_if_small(reached), ["j", "value"]).select("q", "cell").distinct(), "visits")
        lists, probes = (x.join(long, ["j", "value"], "left_anti") for x in (lists, probes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a, b = stacked(frame["c"], "u1"), stacked(frame["qc"], "u1")
                apart = np.bitwise_count(a ^ b).reshape(len(frame), SUBSTRINGS, -1).sum(axis=2)
                first = (apart <= 1).argmax(axis=1)  # the first substring that lets the pair meet
                frame = frame[(apart.sum(axis=1) <= first_radius()) & (first == frame["j"].to_numpy())]
            yield frame[["q", "row"]]

    met = probes.join(lists, ["j", "value"]).select("q", "row", "j", "c", "qc").mapInPandas(run, "q long, row long")
    if grouped:  # pairs that a cell holds are found there
        met = met.join(of_row, "row", "left").join(visits, ["q", "cell"], "left_anti")

    def cosines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame["score"] = np.einsum("ij,ij->i", stacked(frame["u"], "f8"), stacked(frame["qu"], "f8"))
                yield frame[["q", "vec_id", "score"]]

    both = met.join(index_rows.select("row", F.col("k").alias("vec_id"), "u"), "row").join(queries.select(F.col("k").alias("q"), F.col("u").alias("qu")), "q")
    found = both.select("q", "vec_id", "u", "qu").mapInPandas(cosines, "q long, vec_id long, score double")
    if not grouped:
        return found
    blocks = of_row.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("n_rows")).join(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("n_queries")), "cell")
    blocks = broadcast_if_small(save(spark, blocks, "blocks"))
    rows = index_rows.join(of_row.join(blocks, "cell"), "row")
    asked = queries.join(visits.join(blocks, "cell"), queries["k"] == visits["q"])
    bits = Index(0, np.zeros(0), np.zeros((0, BITS)), first_radius())  # only their number counts here
    return found.unionByName(in_blocks(rows, asked, bits, first_radius(), best if few else 1 << 40))


def block_search(index_rows: DataFrame, queries: DataFrame, index: Index, radius: int, best: int) -> DataFrame:
    """q, vec_id, score of the best pairs within the radius, block of queries by block of rows."""
    n_rows, n_queries = max(1, -(-index_rows.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    one = {"cell": F.lit(0).cast("long"), "n_rows": F.lit(n_rows), "n_queries": F.lit(n_queries)}
    return in_blocks(index_rows.withColumns(one), queries.withColumns(one), index, radius, best)


def in_blocks(index_rows: DataFrame, queries: DataFrame, index: Index, radius: int, best: int) -> DataFrame:
    """q, vec_id, score of the best pairs within the radius, of queries and rows that share a cell, dealt into n_queries by n_rows blocks a cell."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = queries.select("cell", F.pmod(F.xxhash64("k"), F.col("n_queries")).cast("int").alias("of"), every("n_rows").alias("block"), F.lit(0).alias("kind"), "k", "u", "c")
    right = index_rows.select("cell", every("n_queries").alias("of"), F.pmod(F.xxhash64("row"), F.col("n_rows")).cast("int").alias("block"), F.lit(1).alias("kind"), "k", "u", "c")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, found = None, [], None
        for frame in frames:
            for place, group in frame.groupby(["cell", "of", "block"], sort=False):
                if place != now:
                    if found is not None:
                        yield found.result()
                    now, held, found = place, [], None
                rows = group[group["kind"] == 1]
                if len(rows) < len(group):
                    held.append(group[group["kind"] == 0])
                if len(rows) and held:
                    if found is None:
                        asked = pd.concat(held)
                        found = Search(index, asked["k"].to_numpy(), stacked(asked["u"], "f8"), stacked(asked["c"], "u1"), radius, best)
                    found.add(rows["k"].to_numpy(), stacked(rows["u"], "f8"), stacked(rows["c"], "u1"))
        if found is not None:
            yield found.result()

    dealt = left.unionByName(right).repartition("cell", "of", "block").sortWithinPartitions("cell", "of", "block", "kind")
    return dealt.mapInPandas(run, "q long, vec_id long, score double")


def ranked(pairs: DataFrame, members: DataFrame, best: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best rows of every query of each class, without those of its own id."""
    of_id = Window.partitionBy("q", "vec_id").orderBy(F.desc("score"))
    of_class = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    few = pairs.withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= best)
    few = few.withColumn("n", F.row_number().over(of_class)).where(F.col("n") <= 2 * best)
    own = few.join(members, "q").where("query_id <> vec_id")
    last = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best).select("q", "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", best: int = BEST) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows."""
    spark: SparkSession = vectors.sparkSession
    before = saved()
    rows = vectors.select(vectors[vec_id].cast("long").alias("k"), vectors[embedding].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("k is not null and v is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return empty
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where((F.size("v") == sizes["d"]) & finite).dropDuplicates(["k", "v"])
    sample = bounded_sample(rows, "k", min(SAMPLE, max(1, SAMPLE_MB * (1 << 17) // sizes["d"]))).select("v").toPandas()["v"]
    if not len(sample):
        return empty
    index = learn(np.array(sample.tolist(), dtype=np.float64))
    order = Window.partitionBy("v").orderBy("k")
    # of rows with equal vectors no query needs more than these
    classes = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= best + 1)
    index_rows = save(spark, encoded(classes.select("k", "v"), index).select("k", "u", "c", "sub", F.xxhash64("k", "v").alias("row")), "rows")
    # a query's id may ask under several vectors; each is searched, and the query gets the best of all
    numbered = rows.where("asks").select(F.col("k").alias("query_id"), "v", F.xxhash64("v").alias("q"))
    members = save(spark, numbered.select("q", "query_id"), "members")
    queries = save(spark, encoded(numbered.groupBy("q").agg(F.first("v").alias("v")), index).select(F.col("q").alias("k"), "u", "c", "sub"), "queries")

    def enough(found: DataFrame, least: float) -> DataFrame:
        """Classes all of whose queries have their full number of neighbours, none of them further than that."""
        each = found.groupBy("q", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
        return each.groupBy("q").agg(F.min("n").alias("n"), F.min("last").alias("last"), F.count(F.lit(1)).alias("queries")).join(members.groupBy("q").agg(F.count(F.lit(1)).alias("queries")), ["q", "queries"]).where((F.col("n") >= best) & (F.col("last") >= least)).select("q")

    found = save(spark, ranked(substring_search(index_rows, queries, best, few=True), members, best), "near")
    done = save(spark, enough(found, index.sure), "done")
    out = found.join(done, "q", "left_semi")
    for radius in (index.radius, BITS):
        queries = save(spark, queries.join(done, queries["k"] == done["q"], "left_anti"), "queries")
        if not queries.take(1):
            break
        found = save(spark, ranked(block_search(index_rows, queries, index, radius, best), members, best), "found")
        done = save(spark, enough(found, -2.0), "done")
        out = out.unionByName(found.join(done, "q", "left_semi") if radius < BITS else found)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best)
    out = save(spark, out.select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop_since(spark, before, out)
    return out
