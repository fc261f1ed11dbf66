"""Hits: what an extractor finds for an indicator in a report.

Every extractor is an expression over one report that gives an array of hits,
at most one an indicator: the catalogue is compiled into literals, so there is
no join, no shuffle and no pattern that changes from row to row. What is used
more than once is bound to a name (`let`), as expressions over elements of an
array are not shared; and what is quick to test is tested before a pattern.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import SPACE, alternatives, any_case, contains_any, first, flat_sentences, let, letter, lines, plain_words, strip, swap, token, unit_token
from reportlake.functions.units import same_unit
from reportlake.plans.catalogue import HIT, NLP_WITH_UNIT, SOURCES, Kpi

# The pattern of a number, and how far it may stand from a unit in brackets.
VALUE = r"([0-9][0-9,.\s]*(?:million|thousand|k)?)"
NEAR = 120  # characters between a unit in brackets and its value

# Verbs of narrative lines, and cues in table headers.
VERBS = ("reported", "announced", "increased", "decreased", "reached")
NARRATIVE = rf"\b({'|'.join(VERBS)})\b"
KPI_CUES = ("kpi", "metric", "kennzahl", "indicateur", "indicator")
UNIT_CUES = ("unit", "einheit", "unite")
VALUE_CUES = ("wert", "valeur", "value")


def hit(ord_: int, kpi: Kpi, source: str, raw_value: Column, raw_unit: Column, confidence: float, reported_unit: Column | None = None) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(F.lit(ord_).alias("ord"), F.lit(kpi.code).alias("code"), F.lit(source).alias("source"), raw_value.alias("raw_value"), raw_unit.alias("raw_unit"), (empty if reported_unit is None else reported_unit).alias("reported_unit"), F.lit(confidence).alias("confidence")).cast(HIT)


def found(hits: list[Column]) -> Column:
    return F.filter(F.array(*hits) if hits else F.array().cast(f"array<{HIT}>"), lambda h: h.isNotNull())


def rows(df: DataFrame, hits: Column) -> DataFrame:
    """doc_id and the hits, one row each.

    Outer, and filtered after: from a plain explode the optimiser infers a
    filter on the array, which would be computed a second time for it.
    """
    return df.select("doc_id", F.inline_outer(hits)).where("code IS NOT NULL")


# ---- patterns anchored at a unit


# The same number in any case of its words. What it takes before them it need not give back, for nothing that may follow begins so.
RUN = r"[0-9][0-9,.\s]*"
SCALED = "|".join(map(any_case, ("million", "thousand", "k")))
NUMBER = rf"({RUN}+(?:{SCALED})?)"


def patterns(units: tuple[str, ...]) -> dict[str, tuple[str, int, int]]:
    """For each pattern its text and its groups for value and unit."""
    u = alternatives(units)
    before = rf"({RUN}(?:{SCALED})?)" if any(re.match(r"[0-9,.\s]", x) for x in units) else NUMBER
    starts = "|".join(dict.fromkeys(letter(x[0]) for x in units if x)) if all(units) else ""
    return {
        "value_unit": (rf"{before}\s*({u})", 1, 2),
        "bracket_unit_value": (rf"\(({u})\)\s*(?:{any_case('of')}|{any_case('is')}|=|:)?\s*{NUMBER}", 2, 1),
        "unit_value": (rf"(?={starts})(?<!\()({u})\s*{NUMBER}", 2, 1),
        "bracket_unit_near_value": (rf"\(({u})\)(.{{0,{NEAR}}}?){NUMBER}", 3, 1),
    }


def pattern_hits(flat: Column, kpis: tuple[Kpi, ...], only: str | None = None) -> Column:
    """For each indicator the leftmost match of the first pattern that matches anywhere.

    A search for the units as plain text comes before the patterns, which all
    need one. The text is searched once for a match; its groups are then read
    from the match alone. White space in flat text is single blanks.
    """
    low = swap(F.lower(flat), "ſ", "s")  # the one other letter that patterns take for one of a unit's and that has no lower case
    return let(F.struct(flat.alias("flat"), low.alias("low")), lambda t: _pattern_hits(t["flat"], t["low"], kpis, only))


def _pattern_hits(flat: Column, low: Column, kpis: tuple[Kpi, ...], only: str | None) -> Column:
    out = []
    for i, k in enumerate(kpis):
        if k.units:
            units = tuple(u.lower() for u in k.units)
            bracketed = contains_any(low, [f"({u}" for u in units])
            chain = []
            for name, (p, value, unit) in patterns(k.units).items():
                if only in (None, name):
                    match = _match(i, k, flat, p, value, unit, name == "bracket_unit_near_value")
                    chain.append(F.when(bracketed, match) if name.startswith("bracket") else match)
            out.append(F.when(contains_any(low, units), F.coalesce(*chain)))
    return found(out)


def _match(i: int, k: Kpi, flat: Column, p: str, value: int, unit: int, bare_end: bool) -> Column:
    def read(m: Column) -> Column:
        raw = F.trim(F.regexp_extract(m, p, value))
        raw = F.regexp_replace(raw, "[.,;]+$", "") if bare_end else raw
        return F.when(m != "", hit(i, k, "regex", raw, F.trim(F.regexp_extract(m, p, unit)), SOURCES["regex"][2]))

    return let(F.regexp_extract(flat, p, 0), read)


# ---- windows of two sentences


def sentence_hits(flat: Column, kpis: tuple[Kpi, ...], strong: bool = True, weak: bool = True) -> Column:
    """For each indicator the first sentence that names it and holds, with the next one, an acceptable value."""
    both = lambda split: F.struct(split.alias("split"), F.transform(split, F.lower).alias("low"))
    return let(let(flat_sentences(flat), both), lambda t: _sentence_hits(t["split"], t["low"], kpis, strong, weak))


def _sentence_hits(split: Column, low: Column, kpis: tuple[Kpi, ...], strong: bool, weak: bool) -> Column:
    none, base = F.lit(None).cast(HIT), SOURCES["nlp"][2]

    def judged(i: int, k: Kpi):
        with_unit = patterns(k.units)["value_unit"][0]

        def alone(raw: Column) -> Column:
            v = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
            junk = F.endswith(raw, F.lit(",")) | let(v, lambda x: F.coalesce(x.between(1000.0, 2100.0) | (x < 100.0), F.lit(False)))
            return F.when((raw != "") & ~junk, hit(i, k, "nlp", raw, F.lit(None).cast("string"), base))

        def in_window(window: Column) -> Column:
            units = tuple(u.lower() for u in k.units)

            def read(m: Column) -> Column:
                strong_hit = hit(i, k, "nlp", F.trim(F.regexp_extract(m, with_unit, 1)), F.trim(F.regexp_extract(m, with_unit, 2)), base + NLP_WITH_UNIT)
                chain = F.when(m != "", strong_hit if strong else none)
                return chain.when(contains_any(F.lower(window), units), let(F.trim(F.regexp_extract(window, NUMBER, 1)), alone)) if weak else chain

            return let(F.regexp_extract(window, with_unit, 0), read)

        def of(s: Column, at: Column) -> Column:
            window = swap(F.concat_ws(" ", s, F.get(split, at + 1)), "\u00a0\u202f\u2007\u2060", " ")
            return F.when(contains_any(F.get(low, at), k.names), let(window, in_window))

        return of

    return found([first(F.transform(split, judged(i, k)), lambda h: h.isNotNull()) for i, k in enumerate(kpis)])


# ---- lines that read like table rows


def is_row(line: Column) -> Column:
    return F.contains(line, F.lit("|")) | (F.contains(line, F.lit("(")) & F.contains(line, F.lit(")"))) | line.rlike(rf"(?U){SPACE}{{2,}}")


def narrative(low: Column) -> Column:
    return contains_any(low, VERBS) & low.rlike(NARRATIVE)


def row_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda s: is_row(s) & ~let(F.lower(s), narrative))


def line_hits(text: Column, kpis: tuple[Kpi, ...]) -> Column:
    """For each indicator the first row-like line that names it and ends in a number."""
    names = tuple(dict.fromkeys(n for k in kpis for n in k.names))
    both = F.transform(lines(text), lambda s: F.struct(s.alias("line"), F.lower(s).alias("low")))
    rows = F.filter(both, lambda s: contains_any(s["low"], names) & is_row(s["line"]) & ~narrative(s["low"]))
    return let(rows, lambda rows: _line_hits(rows, kpis))


def _line_hits(rows: Column, kpis: tuple[Kpi, ...]) -> Column:
    number = r"(?U)(-?\d[\d,.\s]*+)$"

    def judged(i: int, k: Kpi):
        def unit(compact: Column) -> Column:
            out = F
            for u in k.units:
                out = out.when(F.contains(compact, F.lit(token(u))), u)
            return out.otherwise(F.lit(None))

        def of(s: Column) -> Column:
            raw_unit = let(F.replace(s["low"], F.lit(" "), F.lit("")), unit) if k.units else F.lit(None).cast("string")
            read = lambda raw: F.when(raw != "", hit(i, k, "table_plain", strip(raw), raw_unit, SOURCES["table_plain"][2]))
            return F.when(contains_any(s["low"], k.names), let(F.regexp_extract(s["line"], number, 1), read))

        return of

    return found([first(F.transform(rows, judged(i, k)), lambda h: h.isNotNull()) for i, k in enumerate(kpis)])


# ---- tables of cells


def last_index(header: Column, cues: tuple[str, ...]) -> Column:
    at = F.filter(F.transform(header, lambda h, i: F.when(contains_any(h, cues), i)), lambda i: i.isNotNull())
    return F.array_max(at)


def roles(header: Column) -> Column:
    """Columns of name, unit and value, from normalised headers: the last with a cue; for the value else the first year."""
    n = F.size(header)
    marked = F.transform(header, lambda h, i: F.struct(i.cast("int").alias("i"), contains_any(h, VALUE_CUES).alias("cue"), h.rlike(r"^20\d{2}$").alias("year")))
    value = F.aggregate(marked, F.lit(None).cast("int"), lambda acc, m: F.when(m["cue"] | (m["year"] & acc.isNull()), m["i"]).otherwise(acc))
    return F.struct(
        F.coalesce(last_index(header, KPI_CUES), F.lit(0)).cast("int").alias("kpi"),
        F.coalesce(last_index(header, UNIT_CUES), F.when(n > 1, 1).otherwise(0)).cast("int").alias("unit"),
        F.coalesce(value, F.when(n > 2, 2).otherwise(n - 1)).cast("int").alias("value"),
    )


def header_roles(table: Column) -> Column:
    return let(F.transform(F.get(table, F.lit(0)), lambda c: plain_words(F.coalesce(c, F.lit("")))), roles)


def cell_hits(tables: Column, kpis: tuple[Kpi, ...]) -> Column:
    """For each indicator the first table's last row that names it."""
    per_table = F.transform(F.filter(tables, lambda t: F.size(t) > 1), lambda t: _table_hits(t, kpis))
    return let(per_table, lambda all_: _first_of(all_, kpis))


def _first_of(per_table: Column, kpis: tuple[Kpi, ...]) -> Column:
    def of(code: str) -> Column:
        last = F.transform(per_table, lambda hits: F.try_element_at(F.filter(hits, lambda h: h["code"] == code), F.lit(-1)))
        return first(last, lambda h: h.isNotNull())

    return found([of(k.code) for k in kpis])


def _table_hits(table: Column, kpis: tuple[Kpi, ...]) -> Column:
    """Hits of a table's rows, in their order."""

    none = F.lit(None).cast(HIT)

    def named(c: Column, words: Column) -> Column:
        in_name = let(F.regexp_extract(c["name"], r"\(([^)]+)\)", 1), lambda x: F.when(x != "", strip(x)))
        raw_unit = F.coalesce(F.when((c["unit"] != "") & ~c["unit"].rlike(r"(?U)\d"), c["unit"]), in_name)
        chain = F
        for i, k in enumerate(kpis):
            names = [w for w in (_plain(s) for s in (*k.names, *k.grid_synonyms)) if w]
            chain = chain.when(contains_any(words, names), let(raw_unit, with_unit(i, k, c["value"])))
        return chain.otherwise(none) if kpis else none

    def with_unit(i: int, k: Kpi, value: Column):
        def of(raw: Column) -> Column:
            kept, final = raw, F.when(raw != "", let(unit_token(raw), lambda t: same_unit(t, k.units)))
            if len(k.units) == 1:
                kept, final = F.when(final.isNull(), F.lit(k.units[0])).otherwise(raw), F.coalesce(final, F.lit(k.units[0]))
            return hit(i, k, "table_grid", value, kept, SOURCES["table_grid"][2], final)

        return of

    def row_hit(row: Column, r: Column) -> Column:
        cell = lambda role: strip(F.coalesce(F.get(row, r[role]), F.lit("")))
        cells = F.struct(cell("kpi").alias("name"), cell("unit").alias("unit"), cell("value").alias("value"))
        filled = lambda c: F.when((c["name"] != "") & (c["value"] != ""), let(plain_words(c["name"]), lambda words: named(c, words))).otherwise(none)
        return F.when(F.greatest(r["kpi"], r["unit"], r["value"]) >= F.size(row), none).otherwise(let(cells, filled))

    rows = F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0)))
    hits = let(header_roles(table), lambda r: F.transform(rows, lambda row: row_hit(row, r)))
    return F.filter(hits, lambda h: h.isNotNull())


def _plain(s: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", s.strip().lower()) if unicodedata.category(c) != "Mn")
    return re.sub("[^a-z0-9]+", " ", bare).strip()
