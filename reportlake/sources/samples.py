"""Reports made from the `orders` table, in nine layouts; the same in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    text: str
    number: str  # a whole number with commas
    array: str

    def fmt(self, x: str) -> str:
        return self.number.format(x)

    def arr(self, *items: str) -> str:
        return self.array.format(", ".join(items))


SPARK = Dialect("STRING", "format_number({}, 0)", "array({})")
DUCK = Dialect("VARCHAR", "format('{{:,}}', {})", "[{}]")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def joined(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def figures(d: Dialect) -> dict[str, str]:
    """SQL of the three figures of a report over orders."""
    n = "CAST(floor(o_totalprice) AS BIGINT)"
    return {"g": d.fmt(n), "e": d.fmt(f"({n} * 3 + 7)"), "w": d.fmt(f"({n} * 11 + 13)")}


def columns(d: Dialect, g: str, e: str, w: str) -> dict[str, str]:
    """SQL of doc_id, text and tables over orders, from its three figures."""
    dots, blanks = f"replace({g}, ',', '.')", f"replace({g}, ',', ' ')"
    nl = "chr(10)"
    texts = [
        joined(q("Season log of a ferry line. Across nine boats, greenhouse gas emissions (tCO2e) came to "), g, q(" by October. "), nl, q("Shore power pushed energy use (MWh) up to "), e, q(", a fifth above plan. "), nl, q("Tank cleaning put water use (m3) at "), w, q(" for the harbour.")),
        joined(q("Mill, sheet 4 of 7"), nl, q("GHG emissions tCO2e "), g, nl, q("Energy use MWh "), e, nl, q("Water use m3 "), w),
        joined(q("Appendix of a brewery"), nl, q("Greenhouse gas emissions (tCO2e) "), g, nl, q("Energy consumption (MWh) "), e, nl, q("Water withdrawal (m3)  "), w),
        joined(q("Three clerks copy one ledger"), nl, q("Water withdrawal (m3) "), g, nl, q("Water withdrawal (m3) "), dots, nl, q("Water withdrawal (m3) "), blanks),
        joined(q("What | In | How much"), nl, q("Water use | m³ | "), w, nl, q("Greenhouse gas emissions | t CO2e | "), g, nl, q("Energy use | M W h | "), e),
        joined(q("The orchard had a dry year. Pumps ran long, and energy use (MWh) climbed to "), e, q(". "), nl, q("Ghg emissions (tCO2e) fell a little, to "), g, q(", since two tractors were sold. "), nl, q("The river board allows water withdrawal (m3) of "), w, q(" in all.")),
        joined(q("Scan 12. Wat er with drawal (m3) of "), w, q("; En ergy con sumption (MWh) of "), e, q("; and Green house gas emis sions (tCO2e) of "), g, q(" at the quay.")),
        joined(q("A bakery of two ovens. They burnt "), e, q(" kWh of power. By the meter, water use was "), w, q(" cubic meters. The baker guesses at 1.5 million tons CO2e.")),
        joined(q("Notes from a quarry. Blasting and haulage cause greenhouse gas emissions of "), g, q(" tCO2e. "), nl, q("Energy use is metered in MWh! The meter stood at "), e, q(" in spring. "), nl, q("To lay the dust, water withdrawal was "), w, q(" m³.")),
    ]
    row = lambda *cells: d.arr(*cells)
    none = f"CAST(NULL AS {d.text})"
    ghg, energy, water = q("Greenhouse gas emissions"), q("Yearly energy consumption"), q("Water withdrawal")
    grid_ghg, grid_energy, grid_water = q("GHG emissions, total"), q("Energy consumption total (all mills)"), q("Water withdrawal, total")
    year = row(q("Indicator"), q("2031"), q("Unit"), q("2030"))
    table = {
        1: [d.arr(year, row(grid_water, w, q("m3"), q("8")), row(grid_ghg, g, q("tCO2e"), q("9")), row(grid_energy, e, q("MWh"), none))],
        2: [d.arr(row(q("Metric"), q("Value")), row(joined(water, q(" (m3)")), w), row(joined(energy, q(" (MWh)")), e), row(joined(ghg, q(" (tCO2e)")), g))],
        3: [d.arr(row(q("Indicateur"), q("Valeur")), row(q("Prélèvement total d'eau (m3)"), g), row(q("Water use (m3)"), dots), row(q("Water withdrawal (m3)"), blanks))],
        4: [d.arr(row(q("Einheit"), q("Wert"), q("Kennzahl")), row(q("m³"), w, q("Gesamtwasserentnahme")), row(q("M W h"), e, q("Gesamtenergieverbrauch")), row(q("t CO2e"), g, q("Émissions totales de GES")))],
        7: [d.arr(row(q("a"), q("b"), q("c")), row(q("Loaves"), q("-"), q("")), row(water, none, w)), d.arr(row(q("Metric"), q("Unit"), q("Value")), row(water, q("m3"), q("1")), row(energy, q(""), q("none yet")), row(ghg, q("tCO2e"), g))],
    }
    kind = f"{d.text}[][][]" if d is DUCK else "ARRAY<ARRAY<ARRAY<STRING>>>"
    empty = f"CAST({d.arr()} AS {kind})"
    pick = lambda options: "CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in options.items())
    return {
        "doc_id": f"CAST(o_orderkey AS {d.text})",
        "text": pick(dict(enumerate(texts))) + " END",
        "tables": pick({k: d.arr(*v) for k, v in table.items()}) + f" ELSE {empty} END",
    }


DEAL = 1 << 17  # bytes of the narrow rows, as Spark estimates them from the file, that a task makes reports from


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    # a few megabytes become many texts: the narrow rows are dealt to all cores before they grow, in tasks that do not grow with the table
    size = int(str(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    orders = orders.repartition(max(spark.sparkContext.defaultParallelism, -(-size // DEAL)), "o_orderkey")
    orders = orders.selectExpr("o_orderkey", *[f"{sql} AS {name}" for name, sql in figures(SPARK).items()])
    return orders.selectExpr(*[f"{sql} AS {name}" for name, sql in columns(SPARK, "g", "e", "w").items()])


def reports_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns(DUCK, **figures(DUCK)).items()) + " FROM orders"


#: A number as nine kinds of reports write it, and with words for scale.
def written(d: Dialect) -> str:
    n = "CAST(floor(o_totalprice) AS BIGINT)"
    g = d.fmt(n)
    styles = [g, f"replace({g}, ',', '.')", f"replace({g}, ',', ' ')", joined(q("2024 "), g), joined(g, q(".5")), joined(f"replace({g}, ',', '')", q("..")), joined(q("-"), f"CAST({n} % 1000 AS {d.text})", q(".5")), q("N/A"), joined(g, q(","))]
    return "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(styles)) + " END"


def scaled(d: Dialect) -> str:
    m = f"CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS {d.text})"
    styles = [joined(m, q(" million")), joined(q("1."), m, q(" Million")), joined(m, q(" billion")), joined(m, q("k")), joined(m, q(" thousand")), joined(q("1,2 million")), joined(m, q("K.")), q("about million"), m]
    return "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(styles)) + " END"
