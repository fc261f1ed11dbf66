"""Line dedup by site-relative frequency, in DataFrame functions only.

For each site, the share of its pages that hold a line is the line's ratio;
lines above the boilerplate ratio go from all pages of that site. A line counts
once a page, however often the page repeats it. Lines are parted by line feeds
and compared without surrounding spaces, tabs and carriage returns; blank lines
are never boilerplate. A line that fewer than `least` pages hold is none either:
below that a share says nothing (of ten pages, one line is a tenth). A page all
of whose lines are boilerplate is left empty.

Null texts have no lines and stay null; empty texts stay empty. A null site is
a site of its own. Pages are rows: repeated rows are pages of their own. Empty
tables give no rows. Columns of the input keep their names and places; working columns
have names that begin with two underscores.

Lines stand for themselves as two 64-bit hashes while they are counted; texts
never move: a site's boilerplate (at most lines a page / ratio of them, on
average) is joined to its pages, by broadcast where it is measured to be small,
and is laid out by a hash of the line, so that a line is looked up among few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import broadcast_if_small, save

RATIO = 0.05
LEAST = 3
CELLS = 64  # into which a site's boilerplate is dealt


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    stripped = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(stripped != "", F.struct(F.xxhash64(stripped).alias("a"), F.xxhash64(stripped, F.lit(1)).alias("b")))


def boilerplate(docs: DataFrame, *, text: str = "text", site: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Each site's boilerplate: __site, __key, and the counts that make it so."""
    rows = docs.select(docs[site].alias("__site"), docs[text].alias("__text"))
    pages = rows.groupBy("__site").agg(F.count(F.lit(1)).alias("__pages"))
    # a page's own repeats go before anything is shuffled; what is shuffled are partial counts by line
    held = rows.select("__site", F.explode(F.array_distinct(F.transform(_lines(F.col("__text")), _key))).alias("__key")).where("__key is not null")
    counts = held.groupBy("__site", "__key").agg(F.count(F.lit(1)).alias("__holding")).where(F.col("__holding") >= least)
    joined = counts.join(broadcast_if_small(pages), counts["__site"].eqNullSafe(pages["__site"])).drop(pages["__site"])
    return joined.where(F.col("__holding") > ratio * F.col("__pages"))


def _cell(key: Column) -> Column:
    return F.pmod(key["a"], F.lit(CELLS)).cast("int")


def clean(docs: DataFrame, *, text: str = "text", site: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The rows with cleaned texts, and __n_lines and __n_removed."""
    found = save(docs.sparkSession, boilerplate(docs, text=text, site=site, ratio=ratio, least=least), "boilerplate")
    cells = found.groupBy("__site", _cell(F.col("__key")).alias("__cell")).agg(F.collect_set("__key").alias("__in"))
    dealt = F.map_from_entries(F.collect_list(F.struct("__cell", "__in")))
    sites = cells.groupBy("__site").agg(dealt.alias("__by"))
    sites = sites.select("__site", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.element_at("__by", c)).alias("__drop"))
    sites = broadcast_if_small(sites)
    lines = _lines(docs[text])
    joined = docs.join(sites, docs[site].eqNullSafe(sites["__site"]), "left")
    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    goes = lambda k: F.coalesce(F.array_contains(F.get("__drop", _cell(k)), k), F.lit(False))
    kept = F.filter(keyed, lambda x: ~goes(x["key"]))
    cut = joined.withColumn("__kept", F.when(F.col("__drop").isNotNull(), F.transform(kept, lambda x: x["line"])).otherwise(lines))
    return cut.select(
        *[(F.array_join("__kept", "\n").alias(c) if c == text else docs[c]) for c in docs.columns],
        F.when(docs[text].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("__n_lines"),
        F.when(docs[text].isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long").alias("__n_removed"),
    )


def clean_sql(docs: str, ratio: float = RATIO, least: int = LEAST) -> str:
    """The same in DuckDB SQL, over a relation with text and source: all columns and n_lines, n_removed. Rows are pages."""
    return f"""
with ld_docs as materialized (select *, row_number() over () as ld_row from {docs}),
ld_lines as (select ld_row, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from ld_docs),
ld_keys as (select *, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') as k from ld_lines),
ld_pages as (select source, count(*) as pages from ld_docs group by source),
ld_held as (select source, k, count(distinct ld_row) as holding from ld_keys where k <> '' group by source, k),
ld_drop as (select h.source, h.k from ld_held h join ld_pages p on h.source is not distinct from p.source where h.holding >= {least} and h.holding > {ratio}::double * p.pages),
ld_kept as (select l.ld_row, count(*) as n_lines, count(d.k) as n_removed, string_agg(l.line, chr(10) order by l.pos) filter (where d.k is null) as text
  from ld_keys l left join ld_drop d on l.source is not distinct from d.source and l.k = d.k group by l.ld_row)
select d.* exclude (ld_row) replace (case when d.text is null then null else coalesce(k.text, '') end as text), coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed
from ld_docs d left join ld_kept k on d.ld_row = k.ld_row"""
