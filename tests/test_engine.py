import json

import pytest
from pyspark.sql import functions as F

from reportlake.functions import units
from reportlake.functions.scores import score
from reportlake.functions.text import lines, plain_words, sentences, unfenced
from reportlake.operators import fuse, hits
from reportlake.operators.normalise import candidates
from reportlake.plans import analytics
from reportlake.plans.catalogue import DEFAULT, Kpi, dimension, strings
from reportlake.plans.pipeline import extract_kpis, prepared, raw_hits
from reportlake.sources import reports as readers
from reportlake.sources import results as sinks

SCHEMA = "doc_id string, text string, tables array<array<array<string>>>"
HEAD = ["Metric", "Unit", "2031"]
#: Made-up reports and, for each, the values of emissions, energy and water, and the extractor they come from.
CASES = {
    "glassworks": ("Kilns ran day and night. By the weighbridge, ghg emissions (tCO2e) were 8,150 for the furnace hall.\nGas and power together made energy use (MWh) 31,900 at year's end.\nCooling took water use (m3) to 77,040 from the canal.", [], [8150.0, 31900.0, 77040.0], "regex"),
    "dairy": ("Milk and cheese", [[HEAD, ["Water withdrawal of the dairy", "m3", "64,200"], ["Energy consumption, ovens", "MWh", "5,310"], ["Greenhouse gas emissions", "tCO2e", "990"]]], [990.0, 5310.0, 64200.0], "table_grid"),
    "laundry": ("Energy use (MWh) 1,870\nWater use (m3)  25,600\nGhg emissions (tCO2e) 412", [], [412.0, 1870.0, 25600.0], "table_plain"),
    "clerks": ("", [[["Indicator", "Value"], *[["Water use (m3)", v] for v in ("7.250", "7 250", "18,400,000", "18 400 000", "18.400.000")]]], [None, None, 18400000.0], "table_grid"),
    "foundry": ("", [[["Value", "Unit", "Metric"], ["40,700", "M W h", "Energy use of the foundry"], ["15,020", "t CO2e", "Greenhouse gas emissions"], ["9,990", "m³", "Water use"]]], [15020.0, 40700.0, 9990.0], "table_grid"),
    "fax": ("Page 3 of a fax. Wat er u se (m3) of 3,300; en er gy use (MWh) of 760; g h g emis sions (tCO2e) of 205 as far as legible", [], [205.0, 760.0, 3300.0], "regex"),
    "camp": ("A camp site writes home. The stoves cause ghg emissions of 61 tCO2e.\nHeating is dear: energy use stood at 540 MWh in winter.\nShowers are long, so water use was 12,800 m³ by the gauge.", [], [61.0, 540.0, 12800.0], "regex"),
    "torn": ("", [[HEAD, ["Ghg emissions", None, "2,080"], ["Energy use", "", "6,400"], ["Swans", "-", ""], ["Water use", "m3", "51,000"]]], [2080.0, 6400.0, 51000.0], "table_grid"),
    "blank": ("The pages were left empty.", [], [None] * 3, ""),
    "null": (None, None, [None] * 3, ""),
}
SAMPLES = [(name, text, tables) for name, (text, tables, _, _) in CASES.items()]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, SCHEMA)


def one(spark, text=None, tables=None):
    return spark.createDataFrame([("d", text, tables)], SCHEMA)


def got(df):
    return {(r.code): (r.raw_value, r.raw_unit, r.confidence) for r in df.collect()}


def by(spark, text, of, kpis=DEFAULT):
    return got(prepared(one(spark, text)).select("doc_id", F.inline(of(kpis))))


def test_goldens(samples):
    rows = extract_kpis(samples).orderBy("doc_id", "ord").collect()
    for name, (_, _, values, source) in CASES.items():
        mine = [r for r in rows if r.doc_id == name]
        assert [r.value for r in mine] == values, name
        assert {s for r in mine for s in r.source} == ({source} if source else set()), name
        assert all(r.status == "Not Reported" and r.reported == (r.value is not None) for r in mine)
        assert all(r.confidence == 0.0 and r.unit is None for r in mine if r.value is None)


def test_winner_is_independent_of_partitions(samples):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(extract_kpis(samples)) == key(extract_kpis(samples.repartition(7)))


def test_plan_has_one_shuffle_and_no_python(spark, samples):
    stored = spark.range(5).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("text"), F.array().cast("array<array<array<string>>>").alias("tables"))
    plan = extract_kpis(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Range (") == 1  # completion needs no second scan
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Arrow" not in plan


def test_patterns(spark):
    of = lambda only=None: lambda kpis: hits.pattern_hits(F.col("flat"), kpis, only)
    text = "First (MWh) of 7, later 12 MWh."
    assert by(spark, text, of())["energy_consumption"][:2] == ("12", "MWh")  # the first pattern wins wherever it matches
    assert by(spark, text, of("bracket_unit_value"))["energy_consumption"][:2] == ("7,", "MWh")
    assert by(spark, "MWh 15. (MWh) 3", of("unit_value"))["energy_consumption"][:2] == ("15.", "MWh")
    assert by(spark, "Energy (MWh) was about 15.;", of())["energy_consumption"][:2] == ("15", "MWh")
    assert by(spark, "In 2031 86,200 tCO2e", of())["total_ghg_emissions"][:2] == ("2031 86,200", "tCO2e")
    assert by(spark, "5 kWh and 3 gwh", of())["energy_consumption"][:2] == ("5", "kWh")
    assert by(spark, "12 MWh", of(), (Kpi("energy_consumption"),)) == {}
    assert by(spark, "(MWh) " + "x" * 121 + "9", of()) == {}


def test_sentences(spark):
    of = lambda kpis: hits.sentence_hits(F.col("flat"), kpis)
    assert by(spark, "Water use is in m3. It was 1 200 last year.", of) == {}  # the first number is the unit's own 3
    assert by(spark, "Energy use in MWh was 1 200 in all.", of)["energy_consumption"] == ("1 200", None, 0.4)
    assert by(spark, "Energy use (MWh) in 2024 rose.", of) == {}
    assert by(spark, "Energy use (MWh) was 99 more.", of) == {}
    assert by(spark, "Energy use (MWh) was 31,900, in all.", of) == {}
    assert by(spark, "Energy use rose. It was 700 MWh.", of)["energy_consumption"] == ("700", "MWh", 0.55)
    assert by(spark, "Energy use (MWh) in 2024. Energy use (MWh): 5000.", of)["energy_consumption"][0] == "5000."


def test_lines(spark):
    of = lambda kpis: hits.line_hits(F.col("text"), kpis)
    assert by(spark, "Ghg emissions (tCO2e) 86,200", of)["total_ghg_emissions"] == ("86,200", "tCO2e", 0.85)
    assert by(spark, "Energy use (MWh) reached 5", of) == {}
    assert by(spark, "Energy use | MWh | none\nEnergy use | MWh | 7\nEnergy use | MWh | 8", of)["energy_consumption"][0] == "7"
    assert by(spark, "Water use | m³ | 9", of)["water_withdrawal"][:2] == ("9", None)
    assert by(spark, "Energy use  -5", of)["energy_consumption"][0] == "-5"
    assert by(spark, "Energy use MWh 5", of) == {}


def grid(spark, *tables):
    return got(prepared(one(spark, "", list(tables))).select("doc_id", F.inline(hits.cell_hits(F.col("tables"), DEFAULT))))


def test_tables(spark):
    row = ["Total energy consumption", "MWh", "1", "2"]
    assert grid(spark, [["Metric", "Einheit", "2022", "2023"], row])["energy_consumption"][0] == "1"
    assert grid(spark, [["KPI", "Unit", "2022", "Value"], row])["energy_consumption"][0] == "2"
    assert grid(spark, [["a", "b", "c", "d"], row])["energy_consumption"][0] == "1"
    assert grid(spark, [HEAD, ["Energy use", "MWh", "1"], ["Energy use", "MWh", "2"]])["energy_consumption"][0] == "2"
    assert grid(spark, [HEAD, ["Energy use", "MWh", "1"]], [HEAD, ["Energy use", "MWh", "2"]])["energy_consumption"][0] == "1"
    assert grid(spark, [HEAD, ["Prélèvement total d'eau", "m³", "4"]])["water_withdrawal"][:2] == ("4", "m³")
    assert grid(spark, [HEAD, ["GHG emissions (tCO2e)", "tCO2e", "4"]])["total_ghg_emissions"][1] == "tCO2e"
    assert grid(spark, [HEAD]) == grid(spark, [HEAD, ["Energy use", "MWh"]]) == grid(spark, [HEAD, ["Energy use", "MWh", None]]) == {}


def cand(spark, *rows):
    df = spark.createDataFrame([("d", 0, c, s, v, u, r, 0.5) for c, s, v, u, r in rows], "doc_id string, ord int, code string, source string, raw_value string, raw_unit string, reported_unit string, confidence double")
    return [(r.value, r.unit) for r in candidates(df, DEFAULT).collect()]


def test_normalise(spark):
    e = "energy_consumption"
    assert cand(spark, (e, "regex", "500", "kWh", None)) == [(0.5, "MWh")]
    assert cand(spark, (e, "nlp", "500", "kWh", None)) == [(500.0, "kWh")]
    assert cand(spark, (e, "regex", "x", "kWh", None)) == [(None, "MWh")]
    assert cand(spark, (e, "regex", "3", "barrels", None)) == [(3.0, "MWh")]
    assert cand(spark, (e, "table_grid", "3", None, None), (e, "table_grid", "x", None, None), (e, "table_grid", "3", "M W h", "GWh")) == [(3.0, "MWh"), (None, None), (3.0, "GWh")]
    assert cand(spark, (e, "table_plain", "1.2 million", "m w\th", None)) == [(None, "MWh")]
    assert cand(spark, (e, "llm", "1.2 million", "", None)) == [(1200000.0, None)]
    assert cand(spark, ("other", "nlp", "7", "MWh", None)) == [(7.0, None)]


def test_scores(spark):
    want = {("table_grid", 0.9): (0.945, 0.6615, 0.2835), ("table_plain", 0.85): (0.85, 0.595, 0.255), ("regex", 0.6): (0.57, None, 0.171), ("nlp", 0.55): (0.495, 0.3465, 0.1485), ("llm", 0.75): (0.6375, 0.44625, 0.19125)}
    df = spark.createDataFrame([(s, c, v, u) for s, c in want for v, u in ((1.0, "MWh"), (1.0, None), (None, "MWh"))], "source string, confidence double, value double, unit string")
    rows = df.select("source", score(F.col("value"), F.col("unit"), strings(("MWh",)), F.col("confidence"), F.col("source"))["score"].alias("s")).collect()
    for (s, _), expected in want.items():
        for value, e in zip([r.s for r in rows if r.source == s], expected):
            assert e is None or abs(value - e) < 1e-12


def test_units(spark):
    df = spark.createDataFrame([("GWh", "MWh"), ("MWH", "MWh"), (None, "MWh"), ("x", "MWh"), ("m³", "m3"), ("million m3", "m3"), ("kWh", None)], "raw string, canonical string")
    assert [r.f for r in df.select(units.factor(F.col("raw"), F.col("canonical")).alias("f")).collect()] == [1000.0, 1.0, 1.0, 1.0, 1.0, 1e6, 1.0]


def test_text(spark):
    df = spark.createDataFrame([("  Größe É  x-1 ", "a.  b! c", "a\n\n b \x85c")], "w string, s string, l string")
    r = df.select(plain_words(F.col("w")).alias("w"), sentences(F.col("s")).alias("s"), lines(F.col("l")).alias("l"), unfenced(F.lit('```json\n{"a":1}\n```')).alias("u")).first()
    assert r.w == "gro e e x 1" and r.s == ["a.", "b!", "c"] and r.l == ["a", "b", "c"] and r.u == '{"a":1}'


def test_fusion(spark, samples):
    cands = candidates(raw_hits(samples), DEFAULT)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(fuse.best(cands)) == key(fuse.best_by_window(cands))
    joined = fuse.shaped(fuse.complete(fuse.best(cands), samples, dimension(samples.sparkSession)))
    assert key(joined) == key(extract_kpis(samples))


def test_client(spark, samples, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(messages):
        import json
        import uuid

        asked, text = (m["content"] for m in messages)
        assert [m["role"] for m in messages] == ["system", "user"]
        (calls / uuid.uuid4().hex).write_text(json.dumps([asked, text]))
        if "pages" in text:
            raise RuntimeError("down")
        return '```json\n{"energy_consumption": {"raw_value": "7 thousand", "raw_unit": "kWh"}, "water_withdrawal": {"raw_value": 12}, "total_ghg_emissions": {"raw_value": null}}\n```'

    reports = one(spark, "Energy.").unionByName(samples.where("doc_id in ('blank', 'clerks', 'torn')")).unionByName(spark.createDataFrame([("half", "Water use (m3) 5", [])], SCHEMA))
    found = extract_kpis(reports, llm=client)
    rows = {(r.doc_id, r.code): r for r in found.collect()}
    assert rows["d", "energy_consumption"].value == 7000.0 and rows["d", "energy_consumption"].source == ["llm"]
    assert rows["d", "water_withdrawal"].value == 12.0 and rows["d", "total_ghg_emissions"].value is None
    assert rows["blank", "energy_consumption"].value is None and rows["clerks", "water_withdrawal"].source == ["table_grid"]
    assert rows["half", "water_withdrawal"].value == 5.0 and rows["half", "energy_consumption"].value == 7000.0
    made = [json.loads(f.read_text()) for f in calls.iterdir()]
    assert sorted(t for _, t in made) == ["Energy.", "The pages were left empty.", "The pages were left empty.", "Water use (m3) 5"]  # a failed call is tried again; a report without text or gaps is not asked about
    asked = {t: p for p, t in made}
    assert "water_withdrawal" not in asked["Water use (m3) 5"] and "- energy_consumption, in MWh" in asked["Water use (m3) 5"] and all(k.code in asked["Energy."] for k in DEFAULT)
    found.count(), found.collect()
    assert len(list(calls.iterdir())) == 4  # answers are kept
    bad = fuse.answered(spark.createDataFrame([("a", "no json"), ("b", None), ("c", "```\n{}\n```")], "doc_id string, content string"), DEFAULT)
    assert bad.count() == 0


def test_client_asks_with_any_key_and_without_gaps(spark):
    docs = spark.createDataFrame([(2**60 + 1, "x", ["energy_consumption"]), (None, "y", []), (3, None, ["energy_consumption"])], "doc_id long, text string, codes array<string>").coalesce(1)
    assert {r.doc_id: r.content for r in fuse.ask(docs, lambda m: m[1]["content"], DEFAULT).collect()} == {2**60 + 1: "x", None: None, 3: None}


def test_chat_client(monkeypatch):
    from types import SimpleNamespace as Some

    from reportlake.sources.chat import chat_client

    asked = []
    done = Some(choices=[Some(message=Some(content="{}"))])
    make = lambda key: Some(chat=Some(completions=Some(create=lambda **options: asked.append((key, options)) or done)))
    client = chat_client("small", max_tokens=50, make=make)
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert client([]) is None and asked == []
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert client([{"role": "user", "content": "x"}]) == "{}" and asked[0] == ("k", {"model": "small", "messages": [{"role": "user", "content": "x"}], "temperature": 0.0, "max_tokens": 50})


def test_sinks(spark, samples, tmp_path):
    found = extract_kpis(samples)
    sinks.write_csv_flat(found, str(tmp_path / "flat"))
    sinks.write_csv(found, str(tmp_path / "each"))
    key = lambda df: sorted(map(str, df.select("doc_id", *sinks.FIELDS).collect()))
    assert key(sinks.read_csv(spark, str(tmp_path / "flat"))) == key(sinks.read_csv_by_report(spark, str(tmp_path / "each")))
    text = (next((tmp_path / "each" / "doc_id=blank").glob("*.csv"))).read_text()
    assert text.splitlines()[0] == "code,value,unit,confidence,source"
    docs = {r.doc_id: json.loads(r.json) for r in sinks.as_json(found).collect()}
    assert [k["code"] for k in docs["camp"]["kpis"]] == [k.code for k in DEFAULT] and docs["blank"]["kpis"][0]["value"] is None
    assert "61.000" in sinks.console(found).where("doc_id = 'camp' and ord = 0").first().line


def test_analytics(samples):
    flat = extract_kpis(samples).withColumn("source", F.concat_ws(",", "source"))
    assert {r.doc_id: r.kpis_found for r in analytics.completeness(flat).collect()}["clerks"] == 1
    assert {r.source: r.n for r in analytics.source_usage(flat).collect()}["none"] == 8
    assert sum(r.n for r in analytics.confidence_histogram(flat).collect()) == 30
    s = analytics.summary(flat).first()
    assert (s.files, s.results, s.missing_values) == (10, 30, 8)


def test_readers(spark, tmp_path):
    for folder, n in (("a", 5), ("b", 7)):
        (tmp_path / "t" / folder).mkdir(parents=True)
        (tmp_path / "t" / folder / "my report.txt").write_text(f"Energy use  {n} MWh\nmore")
    (tmp_path / "t" / "a" / "broken.txt").write_bytes(b"\xff\xfe Energy use (MWh) 9")
    rows = {r.doc_id.removeprefix("file:"): r for r in readers.read_text(spark, str(tmp_path / "t" / "*")).collect()}
    a, b, broken = (rows[str(tmp_path / "t" / x)] for x in ("a/my report.txt", "b/my report.txt", "a/broken.txt"))
    assert a.name == b.name == "my report" and "\n" in a.text and a.error is None and (broken.text, broken.error) == ("", "not UTF-8")
    found = extract_kpis(readers.read_text(spark, str(tmp_path / "t" / "*"))).where("code = 'energy_consumption'").collect()
    assert sorted(map(str, (r.value for r in found))) == ["5.0", "7.0", "None"]
    shown = {json.loads(r.json)["pdf_path"].removeprefix("file:") for r in sinks.as_json(extract_kpis(readers.read_text(spark, str(tmp_path / "t" / "*")))).collect()}
    assert shown == set(rows)
    (tmp_path / "t" / "bad.pdf").write_bytes(b"not a pdf")
    r = readers.read_pdf(spark, str(tmp_path / "t")).first()
    assert r.text == "" and r.tables == [] and r.error and r.name == "bad"
    spark.createDataFrame(SAMPLES[:2], SCHEMA).write.parquet(str(tmp_path / "p"))
    assert extract_kpis(readers.read_tables(spark, str(tmp_path / "p"))).count() == 6
    (tmp_path / "l.jsonl").write_text('{"doc_id": "x/y.pdf", "text": "Energy use (MWh) 3", "tables": [[["Metric", null]]]}\n{oops\n{"doc_id": 4}\n')
    rows = readers.read_tables(spark, str(tmp_path / "l.jsonl")).collect()
    assert [(r.doc_id, r.name, r.error is None) for r in rows] == [("x/y.pdf", "y", True), (None, None, False), ("4", "4", True)]
    assert rows[0].tables == [[["Metric", None]]] and "oops" in rows[1].error


class Page:
    def __init__(self, text, tables):
        self.text, self.tables = text, tables

    def extract_text(self):
        if isinstance(self.text, Exception):
            raise self.text
        return self.text

    def extract_tables(self):
        if isinstance(self.tables, Exception):
            raise self.tables
        return self.tables


class Pages:
    def __init__(self, *pages):
        self.pages = pages

    def __enter__(self):
        return self

    def __exit__(self, *error):
        return False


def test_pdf(spark, monkeypatch):
    import sys
    from types import SimpleNamespace

    import pandas as pd

    grid = [HEAD, ["Energy use", "MWh", "6,400"]]
    books = {
        b"good": Pages(Page("Page one\nWater use (m3) 51", [grid, []]), Page(None, None), Page("Page three", [[["a"], ["b"]]])),
        b"page": Pages(Page("Ghg emissions (tCO2e) 8", []), Page(ValueError("torn"), []), Page("Energy use (MWh) 9", [])),
        b"grid": Pages(Page("Energy use (MWh) 9", [grid]), Page("x", ValueError("lines"))),
    }
    opened = []
    monkeypatch.setitem(sys.modules, "pdfplumber", SimpleNamespace(open=lambda f: opened.append(1) or books[f.read()]))
    frame = pd.DataFrame({"doc_id": ["p/a.pdf", "q/a.pdf", "g", "none"], "name": ["a", "a", "g", "none"], "content": [b"good", b"page", b"grid", b"?"]})
    rows = next(readers.parse_pdf(iter([frame]))).set_index("doc_id")
    assert len(opened) == 4 and rows["text"].tolist() == ["Page one\nWater use (m3) 51\n\n\n\nPage three", "Ghg emissions (tCO2e) 8\n\n\n\nEnergy use (MWh) 9", "Energy use (MWh) 9\n\nx", ""]
    assert rows["tables"].tolist() == [[grid, [["a"], ["b"]]], [], [], []]
    assert [e and e.split(":")[0] for e in rows["error"]] == [None, "page", "tables", "KeyError"]
    found = extract_kpis(spark.createDataFrame([(k, r.text, r.tables) for k, r in rows.iterrows()], SCHEMA)).where("value is not null")
    assert {(r.doc_id, r.code[:5], r.value) for r in found.collect()} == {("p/a.pdf", "energ", 6400.0), ("p/a.pdf", "water", 51.0), ("q/a.pdf", "total", 8.0), ("q/a.pdf", "energ", 9.0), ("g", "energ", 9.0)}


def test_catalogue_from_json(spark, tmp_path, capsys):
    from reportlake import cli
    from reportlake.plans.catalogue import load

    path = tmp_path / "kpis.json"
    path.write_text(json.dumps({"energy_consumption": {"units": ["MWh", "kWh"], "synonyms": ["power drawn"]}, "waste": {"units": ["t"]}, "other": {}}))
    kpis = load(str(path))
    assert [k.code for k in kpis] == ["energy_consumption", "waste", "other"] and kpis[0].units == ("MWh", "kWh") and kpis[1].names == ("waste",) and kpis[2].units == ()
    assert kpis[0].grid_synonyms == DEFAULT[1].grid_synonyms and kpis[1].grid_synonyms == ()
    found = {r.code: r.value for r in extract_kpis(one(spark, "Power drawn (MWh) 44\nWaste (t) 12"), kpis).collect()}
    assert found == {"energy_consumption": 44.0, "waste": 12.0, "other": None}
    (tmp_path / "a.txt").write_text("Waste (t) 12")
    assert cli.main([str(tmp_path / "a.txt"), "--format", "text", "--schema", str(path)]) == 0
    out = json.loads(capsys.readouterr().out.strip())
    assert out["pdf_path"].endswith("/a.txt") and [(k["code"], k["value"]) for k in out["kpis"]] == [("energy_consumption", None), ("waste", 12.0), ("other", None)]


def test_stream_equals_batch(spark, samples, tmp_path):
    from reportlake.streaming import incremental

    samples.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    incremental.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(streamed.select(*sinks.flat(extract_kpis(samples)).columns)) == key(sinks.flat(extract_kpis(samples)))


def test_cli(spark, tmp_path, capsys):
    from reportlake import cli

    (tmp_path / "a.txt").write_text("Energy use (MWh) 5")
    assert cli.main([str(tmp_path / "a.txt"), "--format", "text"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["kpis"][1]["value"] == 5.0


def test_queries_equal_their_sql(spark):
    import duckdb

    from reportlake.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert QUERIES.keys() == ORACLES.keys()
    for name in ("num_locale", "unit_norm", "regex_extract", "nlp_extract", "plain_extract", "grid_extract", "kpi_results", "llm_backfill"):
        mine = QUERIES[name](spark, sf)
        columns = sorted(mine.columns)
        key = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))  # noqa: B023, E731
        assert key(mine.toPandas()) == key(con.sql(ORACLES[name]).df()), name


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_a_report_is_shuffled(samples):
    plan = plan_of(extract_kpis(samples))
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")  # hits are not rows before the shuffle
    repeated = extract_kpis(samples.unionByName(samples)).where("doc_id = 'dairy'")
    assert sorted(r.value for r in repeated.collect()) == [990.0, 5310.0, 64200.0]


def test_results_of_the_histogram_are_made_once(samples):
    flat = extract_kpis(samples).withColumn("source", F.concat_ws(",", "source"))
    found = analytics.confidence_histogram(flat)
    found.collect()
    assert "ReusedExchange" in plan_of(found)


def test_one_source_runs_one_extractor(spark):
    from reportlake.queries import QUERIES

    plan = plan_of(QUERIES["norm_regex"](spark, "/root/testdata/sf0.001"))
    assert "table_plain" not in plan.split("Generate")[1] and "table_grid" not in plan.split("Generate")[1]


def test_tasks_of_reports_do_not_grow_with_the_table(spark, tmp_path):
    from reportlake.sources.samples import DEAL, reports

    spark.range(400_000).selectExpr("id AS o_orderkey", "CAST(hash(id) AS DOUBLE) AS o_totalprice").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    made = reports(spark, str(tmp_path))
    size = sum(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("*.parquet"))
    assert size > 8 * DEAL and made.rdd.getNumPartitions() >= size // DEAL


def test_any_case_is_that_of_the_sql(spark):
    of = lambda kpis: hits.pattern_hits(F.col("flat"), kpis)
    assert by(spark, "5 cubıc meters, m3", of) == {}  # a dotless i is no i
    assert by(spark, "7 CUBIC METERſ", of)["water_withdrawal"][:2] == ("7", "CUBIC METERſ")
    assert by(spark, "7 KWH", of)["energy_consumption"][:2] == ("7", "KWH")


def test_strip_and_lines_of_every_character(spark):
    from reportlake.functions.text import collapse, strip

    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string").repartition(4)
    x = F.concat("c", F.lit("a"), "c", "c", F.lit("b"), "c")
    for r in df.select("c", strip(x).alias("s"), collapse(x).alias("f"), lines(x).alias("l")).collect():
        text = f"{r.c}a{r.c}{r.c}b{r.c}"
        assert r.s == text.strip() and r.f == (" ".join(text.split()) if r.c.isspace() else text) and r.l == [s.strip() for s in text.splitlines() if s.strip()], hex(ord(r.c))
