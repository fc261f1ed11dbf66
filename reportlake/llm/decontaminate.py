"""Benchmark decontamination by SimHash, in DataFrame functions only.

A benchmark item and every window of a document of the item's size in words
are multisets of five-word shingles, and the item is found in the window if
100 * sum of minima >= 75 * sum of maxima over their shingle counts. The sum of
minima is at most the number of positions of a window whose shingle the item
has, so a start is left out only where no item of that size has enough
positions to reach the similarity; every other window is made. Each window's and
item's SimHash (a sign for each of 64 bits, summed over its weighted shingles)
is cut into eight blocks; of two fingerprints within the Hamming radius, one
block differs in at most radius // 8 bits. So windows meet items by size, block
and block value alone, with the items under all such variants of their blocks,
which retrieves every item within the radius; a pair is kept at the first block
that lets it meet. Candidates are then verified exactly. Of equally similar
windows the first wins.

Words are runs without white space, with A-Z lower-cased. Texts of fewer than
five words are one shingle: an item so short is found only in a document that
holds nothing else. Texts without words, and nulls, match nothing. Repeated
documents are judged alike, repeated items each by their own id; empty tables
give no rows. A null id is kept as it is. Columns other than the ids and the
texts are not read.

What is made of the benchmark, and the documents that can hold an item, are
broadcast only where they are measured to be small; beyond that joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import broadcast_if_small, save

WIDTH = 5
SIMILARITY = 75  # in hundredths
BLOCKS = 8
RADIUS = 23  # of 64 bits: a similarity of 0.75 puts about 11 bits apart


def words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[ \\x09-\\x0D]+"), lambda w: w != "")


def shingles(hashes: Column) -> Column:
    """Hashes of five words in a row, from the words' hashes; fewer words are one shingle."""
    at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - WIDTH, F.lit(0)))
    return F.when(F.size(hashes) > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)])))


def _hashed(df: DataFrame) -> DataFrame:
    """Of rows with a column __text, its shingles as __s instead."""
    # outer explodes follow: a filter inferred from an inner one would be pushed down here, with the words' expression inside the loop over shingles
    split = df.where(F.col("__text").rlike("[^ \\x09-\\x0D]")).withColumn("__w", F.transform(words(F.col("__text")), lambda w: F.xxhash64(w))).drop("__text")
    return split.withColumn("__s", shingles(F.col("__w"))).drop("__w")


def fingerprint(bag: str) -> Column:
    """SimHash of a column of arrays of shingle hashes; each occurrence weighs one. In SQL, which is parsed at once where 64 expressions would be built one by one."""
    bits = [f"if(2 * aggregate({bag}, 0, (n, h) -> n + cast(shiftrightunsigned(h, {b}) & 1 as int)) > size({bag}), shiftleft(1L, {b}), 0L)" for b in range(64)]
    return F.expr(" | ".join(bits))


def _block(print_: Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, k * 8).bitwiseAND(255).cast("int")


def variants(radius: int) -> list[int]:
    """The 8-bit values within radius // 8 bits of nothing: what a block may differ by."""
    return [v for v in range(256) if v.bit_count() <= radius // BLOCKS]


def _minima(a: Column, b: Column) -> Column:
    """Sum over the shingles of both bags of the smaller count."""

    def count(bag: Column, h: Column) -> Column:
        return F.size(F.filter(bag, lambda x: x == h))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))


def starts(at: Column, m: Column, n: Column, need: Column) -> Column:
    """Every start of a window of m of n shingles that holds `need` or more of the sorted positions, once each."""
    last = F.greatest(n - m, F.lit(0))

    def run(i: Column) -> Column:
        # windows that hold the positions from i on, but not the one before i
        low = F.greatest(F.get(at, i + need - 1) - m + 1, F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.lit(0))
        high = F.least(F.get(at, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), run))


def windows(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, __m, start and __bag of every window of the size __m of an item that holds enough shingles of some item of that size to be similar."""
    shared = bench.select("item_id", "__m", F.explode_outer(F.array_distinct("__s")).alias("__h"))
    shared = broadcast_if_small(shared)
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    bags = _hashed(source)
    placed = bags.select("doc_id", F.size("__s").alias("__n"), F.posexplode_outer("__s").alias("__p", "__h")).join(shared, "__h")
    held = placed.groupBy("doc_id", "item_id", "__m", "__n").agg(F.array_sort(F.collect_set("__p")).alias("__ps"))
    # sum of minima <= positions held, so 100 * minima >= similarity * (both - minima) asks for this many
    both = F.least("__m", "__n") + F.col("__m")
    need = F.greatest(F.ceil(similarity * both / (100 + similarity)).cast("int"), F.lit(1))
    held = held.withColumn("__need", need).where(F.size("__ps") >= F.col("__need"))
    made = held.select("doc_id", "__m", "__n", starts(F.col("__ps"), F.col("__m"), F.col("__n"), F.col("__need")).alias("__at")).where(F.size("__at") > 0)
    sized = made.groupBy("doc_id", "__m", "__n").agg(F.array_distinct(F.flatten(F.collect_list("__at"))).alias("__at"))
    by_doc = sized.groupBy("doc_id").agg(F.collect_list(F.struct("__m", "__n", "__at")).alias("__of")).withColumnRenamed("doc_id", "__doc")
    by_doc = broadcast_if_small(save(docs.sparkSession, by_doc, "held"))
    # documents that hold nothing go before any word of theirs is hashed again
    some = _hashed(source.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__doc"))).drop("__doc"))
    of = some.select("doc_id", "__s", F.inline("__of")).where(F.size("__s") == F.col("__n"))
    one = of.select("doc_id", "__m", "__s", F.explode("__at").alias("start"))
    return one.select("doc_id", "__m", "start", F.slice("__s", F.col("start") + 1, F.col("__m")).alias("__bag"))


def _first_block(a: Column, b: Column, radius: int) -> Column:
    """The first block in which two fingerprints are near."""
    return F.coalesce(*[F.when(F.bit_count(_block(a.bitwiseXOR(b), k)) <= radius // BLOCKS, k) for k in range(BLOCKS)])


def find(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", similarity: int = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (in words), overlap (sum of minima) and total (sum of maxima) of each document's most similar window to an item that it holds."""
    bench = _hashed(items.select(items[item_id].alias("item_id"), items[text].alias("__text"))).distinct()
    bench = save(docs.sparkSession, bench.select("*", F.size("__s").alias("__m"), fingerprint("__s").alias("__fi")), "items")
    prints = bench.select("item_id", "__m", "__fi")
    near = F.explode(F.array(*[F.lit(v) for v in variants(radius)]))
    index = prints.select("*", near.alias("__d")).select("*", F.posexplode(F.array(*[_block(F.col("__fi"), k) for k in range(BLOCKS)])).alias("__k", "__v"))
    index = index.select("item_id", "__m", "__fi", "__k", F.col("__v").bitwiseXOR(F.col("__d")).alias("__v"))
    made = windows(docs, bench, doc_id=doc_id, text=text, similarity=similarity).withColumn("__f", fingerprint("__bag"))
    probes = made.select("*", F.posexplode(F.array(*[_block(F.col("__f"), k) for k in range(BLOCKS)])).alias("__k", "__v"))
    met = probes.join(broadcast_if_small(index), ["__m", "__k", "__v"])
    apart = F.bit_count(F.col("__f").bitwiseXOR(F.col("__fi")))
    close = met.where((apart <= radius) & (F.col("__k") == _first_block(F.col("__f"), F.col("__fi"), radius))).select("doc_id", "item_id", "start", "__bag")
    whole = broadcast_if_small(bench.select(F.col("item_id").alias("__i"), F.col("__s").alias("__item")))
    checked = close.join(whole, F.col("item_id").eqNullSafe(F.col("__i")))
    checked = checked.select("doc_id", "item_id", "start", _minima(F.col("__bag"), F.col("__item")).alias("overlap"), (F.size("__bag") + F.size("__item")).alias("__both"))
    similar = checked.where(100 * F.col("overlap") >= similarity * (F.col("__both") - F.col("overlap")))
    most = F.min(F.struct((-F.col("overlap") / (F.col("__both") - F.col("overlap"))).alias("s"), "start", "overlap", (F.col("__both") - F.col("overlap")).alias("total")))
    best = similar.groupBy("doc_id", "item_id").agg(most.alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.overlap").cast("long").alias("overlap"), F.col("b.total").cast("long").alias("total"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with their columns."""
    key = options.get("doc_id", "doc_id")
    held = find(docs, items, **options).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, docs[key].eqNullSafe(F.col("__held")), "left_anti")


def find_sql(docs: str, items: str, similarity: int = SIMILARITY) -> str:
    """The same in DuckDB SQL without fingerprints: every window that shares a shingle with an item is counted."""
    split = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '')"
    shingled = "list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))"
    return f"""
with dc_docs as (select doc_id, {shingled} as s from (select doc_id, {split} as w from {docs}) where len(w) > 0),
dc_items as (select item_id, {shingled} as s from (select item_id, {split} as w from {items}) where len(w) > 0),
dc_counts as (select item_id, m, h, count(*) as c from (select item_id, len(s) as m, unnest(s) as h from dc_items) group by all),
dc_placed as (select doc_id, len(s) as n, unnest(s) as h, generate_subscripts(s, 1) - 1 as p from dc_docs),
dc_held as (select d.doc_id, i.item_id, i.m, d.n, d.p, d.h, i.c from dc_placed d join dc_counts i on d.h = i.h),
dc_win as (select doc_id, item_id, m, n, h, c, unnest(generate_series(greatest(0, p - m + 1), least(p, greatest(n - m, 0)))) as start from dc_held),
dc_min as (select doc_id, item_id, m, n, start, least(count(*), any_value(c)) as fewer from dc_win group by doc_id, item_id, m, n, start, h),
dc_over as (select doc_id, item_id, start, sum(fewer) as overlap, any_value(m + least(m, n)) - sum(fewer) as total from dc_min group by doc_id, item_id, start)
select doc_id, item_id, cast(start as bigint) as start, cast(overlap as bigint) as overlap, cast(total as bigint) as total
from dc_over where 100 * overlap >= {similarity} * total
qualify row_number() over (partition by doc_id, item_id order by overlap / total desc, start) = 1"""
