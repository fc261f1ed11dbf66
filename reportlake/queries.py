"""The engine's queries over the test tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake import oracle
from reportlake.functions import units
from reportlake.functions.numbers import with_numbers
from reportlake.functions.scores import score
from reportlake.functions.text import collapse, flat_sentences, lines, plain_words, unit_token_wide
from reportlake.operators import fuse, hits
from reportlake.operators.normalise import candidates
from reportlake.plans import analytics
from reportlake.plans.catalogue import DEFAULT, by_code, dimension, strings, unit_dimension
from reportlake.plans.pipeline import EXTRACTORS, chosen, extract_kpis, prepared, raw_hits
from reportlake.sources import results as sinks
from reportlake.sources.storage import shared_path, stored
from reportlake.sources.samples import SPARK, reports, scaled, written

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def named(name: str, f):
    f.__name__ = name
    return query(f)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(reports(spark, sf_dir))


def shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("doc_id", "code", "raw_value", "raw_unit", "confidence", *more)


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(raw_hits(reports(spark, sf_dir)), DEFAULT)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(reports(spark, sf_dir)).where("source IS NOT NULL")


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_kpis(reports(spark, sf_dir))


def plain(results: DataFrame) -> DataFrame:
    return results.withColumn("source", F.concat_ws(",", "source"))


@query
def num_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(written(SPARK)).alias("raw"))
    return with_numbers(rows, "raw", F.lit(False), "number")


@query
def num_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(scaled(SPARK)).alias("raw"))
    return with_numbers(rows, "raw", F.lit(True), "number")


@query
def text_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with white space collapsed, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapse(F.col("text"))).alias("digest"))


@query
def text_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in lower case without accents, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain_words(F.col("text"))).alias("digest"))


@query
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", lines(F.col("text")).alias("ls"))
    return found.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.aggregate("ls", F.lit(0).cast("long"), lambda n, s: n + F.length(s)).alias("chars"))


@query
def kpi_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a table."""
    return dimension(spark).select("ord", "code", F.concat_ws("|", "synonyms").alias("synonyms"), F.concat_ws("|", "units").alias("units"))


@query
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fixed width, one a result."""
    return sinks.console(final(spark, sf_dir)).select("doc_id", "ord", "line")


def with_allowed(df: DataFrame) -> DataFrame:
    return df.withColumn("allowed", by_code(DEFAULT, F.col("code"), lambda k: strings(k.units)))


@query
def unit_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_allowed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(oracle.code_pick()).alias("code"), F.expr(oracle.unit_pick()).alias("raw_unit")))
    canonical, raw = F.get("allowed", F.lit(0)), F.col("raw_unit")
    return rows.select("l_orderkey", "l_linenumber", "raw_unit", canonical.alias("unit"), units.factor(raw, canonical).alias("factor"), units.match(raw, F.col("allowed")).alias("matched"))


@query
def score_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_allowed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(oracle.code_pick()).alias("code"), F.expr(oracle.source_pick()).alias("source"), F.expr(oracle.unit_pick()).alias("unit"), F.expr("CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END").alias("value"), (F.col("l_discount") * 10).alias("confidence")))
    s = score(F.col("value"), F.col("unit"), F.col("allowed"), F.col("confidence"), F.col("source"))["score"]
    return rows.select("l_orderkey", "l_linenumber", "source", F.round(s, 9).alias("score"))


def pattern_query(only: str | None):
    return lambda spark, sf_dir: shown(hits.rows(ready(spark, sf_dir), hits.pattern_hits(F.col("flat"), DEFAULT, only)))


for _name in ("value_unit", "bracket_unit_value", "unit_value", "bracket_unit_near_value"):
    named(f"regex_{_name}", pattern_query(_name))
named("regex_extract", pattern_query(None))


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = ready(spark, sf_dir).select("doc_id", flat_sentences(F.col("flat")).alias("ss"))
    one = F.transform("ss", lambda s, i: F.struct(i.cast("long").alias("pos"), s.alias("sentence"), F.concat_ws(" ", s, F.get("ss", i + 1)).alias("window_text")))
    return split.select("doc_id", F.inline_outer(one)).where("pos IS NOT NULL")


def sentence_query(strong: bool, weak: bool):
    return lambda spark, sf_dir: shown(hits.rows(ready(spark, sf_dir), hits.sentence_hits(F.col("flat"), DEFAULT, strong, weak)))


named("nlp_strong", sentence_query(True, False))
named("nlp_weak", sentence_query(False, True))
named("nlp_extract", sentence_query(True, True))


@query
def plain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark, sf_dir).select("doc_id", F.explode(hits.row_lines(F.col("text"))).alias("line"))


@query
def plain_filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", hits.row_lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    return found.select("doc_id", F.size("ls").cast("long").alias("row_lines"), F.aggregate("ls", F.lit(0).cast("long"), lambda n, s: n + F.length(s)).alias("chars"))


@query
def plain_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(hits.rows(ready(spark, sf_dir), hits.line_hits(F.col("text"), DEFAULT)))


@query
def grid_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ready(spark, sf_dir).select("doc_id", F.posexplode(F.filter("tables", lambda t: F.size(t) > 1)).alias("table_no", "t")).select("doc_id", F.col("table_no").cast("long").alias("table_no"), hits.header_roles(F.col("t")).alias("r"))
    return found.select("doc_id", "table_no", F.col("r.kpi").alias("kpi_at"), F.col("r.unit").alias("unit_at"), F.col("r.value").alias("value_at"))


@query
def grid_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(hits.rows(ready(spark, sf_dir), hits.cell_hits(F.col("tables"), DEFAULT)), "reported_unit")


def norm_query(source: str):
    only = tuple(e for e in EXTRACTORS if e.name == source)
    return lambda spark, sf_dir: candidates(raw_hits(reports(spark, sf_dir), extractors=only), DEFAULT).select("doc_id", "code", "value", "unit")


for _name in ("regex", "table_grid", "table_plain", "nlp"):
    named(f"norm_{_name}", norm_query(_name))


def stub(results: DataFrame) -> DataFrame:
    """Answers of a stub client to the reports that miss something, as JSON."""
    open_ = fuse.missing(results).select("doc_id").distinct()
    raw = F.expr("CASE CAST(doc_id AS BIGINT) % 4 WHEN 0 THEN '1.5 million' WHEN 1 THEN concat(doc_id, ',000') WHEN 2 THEN 'unknown' END")
    unit = {"total_ghg_emissions": "tCO2e", "energy_consumption": "kWh"}
    answer = F.to_json(F.struct(*[F.struct(raw.alias("raw_value"), F.lit(unit.get(k.code)).cast("string").alias("raw_unit")).alias(k.code) for k in DEFAULT]))
    return open_.select("doc_id", F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("content"))


@query
def norm_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.answered(stub(final(spark, sf_dir)), DEFAULT).select("doc_id", "code", "value", "unit")


def scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "code", "source", "value", "unit", F.round("score.score", 6).alias("score"))


@query
def candidates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of all extractors, brought together in one scan."""
    return scored(cands(spark, sf_dir))


@query
def fuse_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).select("doc_id", "code", "source", "value", "unit", F.round("score", 6).alias("score"))


@query
def fuse_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion in relational form: every report with every indicator, by a join."""
    return plain(fuse.shaped(fuse.complete(best(spark, sf_dir), reports(spark, sf_dir), dimension(spark)))).select("doc_id", "code", "value", "unit", "confidence", "source")


@query
def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.missing(final(spark, sf_dir)).select("doc_id", "code")


@query
def llm_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = stored(final(spark, sf_dir), "results")  # read twice
    filled = fuse.backfill(results, fuse.answered(stub(results), DEFAULT))
    return plain(filled).select("doc_id", "code", "value", "unit", "confidence", "source", "status")


@query
def kpi_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(final(spark, sf_dir)).select("doc_id", "code", "value", "unit", "confidence", "source", "status", "reported")


def analysis(f):
    return lambda spark, sf_dir: f(plain(final(spark, sf_dir)))


named("completeness_by_doc", analysis(analytics.completeness))
named("source_usage", analysis(analytics.source_usage))
named("confidence_hist", analysis(analytics.confidence_histogram))
named("extraction_summary", analysis(analytics.summary))
named("confidence_by_kpi", analysis(analytics.confidence_by_kpi))
named("results_head", analysis(lambda r: analytics.head(r).select("doc_id", "code", "value")))


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv_flat(final(spark, sf_dir), path)
    return sinks.read_csv(spark, path)


@query
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of each report, read again."""
    shape = "pdf_path string, kpis array<struct<code:string,value:double,unit:string,confidence:double,source:array<string>>>"
    read = sinks.as_json(final(spark, sf_dir)).select("doc_id", F.from_json("json", shape).alias("j"))
    total = F.aggregate(F.filter("j.kpis", lambda k: k["value"].isNotNull()), F.lit(None).cast("double"), lambda n, k: F.coalesce(n, F.lit(0.0)) + k["value"])
    return read.select("doc_id", F.size("j.kpis").cast("long").alias("kpis"), total.alias("total"))


@query
def kpi_cross_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name an indicator, by a join with the catalogue as a table: the form for large catalogues."""
    each = ready(spark, sf_dir).select("doc_id", F.explode(lines(F.col("text"))).alias("line"))
    dim = F.broadcast(dimension(spark))  # the catalogue is configuration: three rows here
    named_ = each.join(dim, F.exists("synonyms", lambda s: F.contains(F.lower("line"), s)))
    return named_.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("lines"))


@query
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit conversion by a join with the conversion table."""
    found = hits.rows(ready(spark, sf_dir), hits.pattern_hits(F.col("flat"), DEFAULT))
    dim = F.broadcast(unit_dimension(spark))  # thirteen fixed rows
    return found.join(dim, unit_token_wide(F.col("raw_unit")) == dim["token"], "left").select("doc_id", "code", "raw_unit", "canonical", F.coalesce("factor", F.lit(1.0)).alias("factor"))


ORACLES = dict(oracle.SQL)
