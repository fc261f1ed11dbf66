"""What is extracted: indicators, unit conversions, sources and schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kpi:
    code: str
    units: tuple[str, ...] = ()  # the first is canonical; the order is the order in which patterns try them
    synonyms: tuple[str, ...] = ()
    grid_synonyms: tuple[str, ...] = ()  # more names, for table cells only

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(s.lower() for s in self.synonyms or (self.code.replace("_", " "),))


# Names of indicators and units, in English, German and French.
DEFAULT = (
    Kpi(
        "total_ghg_emissions",
        ("tCO2e", "tCO2", "tons CO2e", "tonnes CO2e"),
        ("total ghg emissions", "ghg emissions", "greenhouse gas emissions"),
        ("total ghg emissions", "ghg emissions total", "treibhausgasemissionen gesamt", "emissions totales de ges"),
    ),
    Kpi(
        "energy_consumption",
        ("MWh", "kWh", "GWh"),
        ("total energy consumption", "energy consumption", "energy use"),
        ("total energy consumption", "energy consumption total", "gesamtenergieverbrauch", "consommation totale d energie"),
    ),
    Kpi(
        "water_withdrawal",
        ("m3", "m³", "cubic meters"),
        ("total water withdrawal", "water withdrawal", "water use"),
        ("total water withdrawal", "water withdrawal total", "gesamtwasserentnahme", "prelevement total d eau"),
    ),
)

# Token of a unit, canonical unit, factor.
CONVERSIONS = (
    ("tco2e", "tCO2e", 1.0),
    ("tco2", "tCO2e", 1.0),
    ("t_co2e", "tCO2e", 1.0),
    ("tonsco2e", "tCO2e", 1.0),
    ("tonnesco2e", "tCO2e", 1.0),
    ("mwh", "MWh", 1.0),
    ("kwh", "MWh", 0.001),
    ("gwh", "MWh", 1000.0),
    ("m3", "m3", 1.0),
    ("m³", "m3", 1.0),
    ("cubicmeters", "m3", 1.0),
    ("thousandm3", "m3", 1000.0),
    ("millionm3", "m3", 1000000.0),
)

# Weight in the score, priority among equal scores, confidence of a hit.
SOURCES = {
    "table_grid": (1.05, 4, 0.9),
    "table_plain": (1.0, 3, 0.85),
    "regex": (0.95, 2, 0.6),
    "nlp": (0.9, 1, 0.4),
    "llm": (0.85, 0, 0.75),
}
NLP_WITH_UNIT = 0.15  # more confidence for a value with its unit
NOT_REPORTED = "Not Reported"

HIT = "struct<ord:int,code:string,source:string,raw_value:string,raw_unit:string,reported_unit:string,confidence:double>"
RESULTS = "doc_id string, code string, value double, unit string, confidence double, source array<string>, status string"
RESULTS_CSV = "code string, value double, unit string, confidence double, source string"


def load(path: str) -> tuple[Kpi, ...]:
    """Indicators from a JSON file {code: {units, synonyms}}, in its order."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    known = {k.code: k.grid_synonyms for k in DEFAULT}
    return tuple(Kpi(c, tuple(m.get("units") or ()), tuple(m.get("synonyms") or ()), known.get(c, ())) for c, m in found.items())


def dimension(spark: SparkSession, kpis: tuple[Kpi, ...] = DEFAULT):
    """The indicators as a table (ord, code, synonyms, units)."""
    return spark.createDataFrame([(i, k.code, list(k.names), list(k.units)) for i, k in enumerate(kpis)], "ord int, code string, synonyms array<string>, units array<string>")


def unit_dimension(spark: SparkSession):
    return spark.createDataFrame(list(CONVERSIONS), "token string, canonical string, factor double")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def by_code(kpis: tuple[Kpi, ...], code: Column, of) -> Column:
    """of(kpi), chosen by the row's code; null for an unknown one."""
    out = F
    for k in kpis:
        out = out.when(code == k.code, of(k))
    return out
