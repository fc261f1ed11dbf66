"""The queries in DuckDB SQL: one chain of named steps, of which each query selects the end it needs."""

from __future__ import annotations

import re

from reportlake.functions.numbers import FLOAT, GROUPED, ONE_MARK, SCALE_WORDS, WHOLE
from reportlake.operators.hits import KPI_CUES, NARRATIVE, NEAR, UNIT_CUES, VALUE, VALUE_CUES, _plain
from reportlake.plans.catalogue import CONVERSIONS, DEFAULT, NLP_WITH_UNIT, NOT_REPORTED, SOURCES
from reportlake.functions.text import token
from reportlake.sources.samples import DUCK, q, reports_sql, scaled, written

KPI_ROWS = "(VALUES " + ", ".join(f"({i}, {q(k.code)})" for i, k in enumerate(DEFAULT)) + ") AS k(ord, code)"


def per_code(of) -> str:
    return "CASE code " + " ".join(f"WHEN {q(k.code)} THEN {of(k)}" for k in DEFAULT) + " END"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def any_in(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def token_sql(u: str) -> str:
    return f"replace(replace(lower({u}), ' ', ''), '³', '3')"


def patterns(units) -> list[tuple[str, str, int, int]]:
    u = "|".join(map(re.escape, units))
    return [
        ("value_unit", rf"(?i){VALUE}\s*({u})", 1, 2),
        ("bracket_unit_value", rf"(?i)\(({u})\)\s*(?:of|is|=|:)?\s*{VALUE}", 2, 1),
        ("unit_value", rf"(?i)(?:^|[^(])({u})\s*{VALUE}", 2, 1),
        ("bracket_unit_near_value", rf"(?i)\(({u})\)(.{{0,{NEAR}}}?){VALUE}", 3, 1),
    ]


def pattern_rows(only: str | None = None) -> str:
    """Hits of unit patterns in flat(doc_id, flat)."""
    out = []
    for i, k in enumerate(DEFAULT):
        used = [p for p in patterns(k.units) if only in (None, p[0])]
        value = "CASE " + " ".join(f"WHEN regexp_matches(flat, {q(p)}) THEN " + (f"regexp_replace(trim(regexp_extract(flat, {q(p)}, {v})), '[.,;]+$', '')" if n == "bracket_unit_near_value" else f"trim(regexp_extract(flat, {q(p)}, {v}))") for n, p, v, _ in used) + " END"
        unit = "CASE " + " ".join(f"WHEN regexp_matches(flat, {q(p)}) THEN trim(regexp_extract(flat, {q(p)}, {u}))" for _, p, _, u in used) + " END"
        out.append(f"SELECT doc_id, {i} AS ord, {q(k.code)} AS code, 'regex' AS source, {value} AS raw_value, {unit} AS raw_unit, CAST(NULL AS VARCHAR) AS reported_unit, {SOURCES['regex'][2]}::DOUBLE AS confidence FROM flat")
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE raw_value IS NOT NULL"


def sentence_rows(strong: bool = True, weak: bool = True) -> str:
    out = []
    base = SOURCES["nlp"][2]
    for i, k in enumerate(DEFAULT):
        p = patterns(k.units)[0][1]
        raw = f"trim(regexp_extract(win, {q('(?i)' + VALUE)}, 1))"
        v = f"TRY_CAST(replace({raw}, ',', '') AS DOUBLE)"
        junk = f"({raw} LIKE '%,' OR coalesce({v} BETWEEN 1000 AND 2100 OR {v} < 100, false))"
        ok = f"NOT regexp_matches(win, {q(p)}) AND {any_in('lower(win)', [u.lower() for u in k.units])} AND {raw} <> '' AND NOT {junk}"
        kind = "CASE " + f"WHEN regexp_matches(win, {q(p)}) THEN {1 if strong else 'NULL'} " + (f"WHEN {ok} THEN 2 " if weak else "") + "END"
        out.append(f"""SELECT doc_id, {i} AS ord, {q(k.code)} AS code, 'nlp' AS source, CASE kind WHEN 1 THEN trim(regexp_extract(win, {q(p)}, 1)) ELSE {raw} END AS raw_value,
CASE kind WHEN 1 THEN trim(regexp_extract(win, {q(p)}, 2)) END AS raw_unit, CAST(NULL AS VARCHAR) AS reported_unit, CASE kind WHEN 1 THEN {base}::DOUBLE + {NLP_WITH_UNIT}::DOUBLE ELSE {base}::DOUBLE END AS confidence
FROM (SELECT *, {kind} AS kind FROM wins WHERE {any_in('lower(s)', k.names)}) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1""")
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in out)


def line_rows() -> str:
    out = []
    number = r"(-?\d[\d,.\s]*)\s*$"
    for i, k in enumerate(DEFAULT):
        unit = "CASE " + " ".join(f"WHEN contains(replace(lower(line), ' ', ''), {q(token(u))}) THEN {q(u)}" for u in k.units) + " END"
        out.append(f"""SELECT doc_id, {i} AS ord, {q(k.code)} AS code, 'table_plain' AS source, trim(regexp_extract(line, {q(number)}, 1)) AS raw_value, {unit} AS raw_unit, CAST(NULL AS VARCHAR) AS reported_unit, {SOURCES['table_plain'][2]}::DOUBLE AS confidence
FROM row_lines WHERE {any_in('lower(line)', k.names)} AND regexp_matches(line, {q(number)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1""")
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in out)


def normal(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def last_cue(cues) -> str:
    return f"list_max(list_filter(list_transform(generate_series(1, len(h)), lambda i: CASE WHEN {any_in('h[i]', cues)} THEN i END), lambda i: i IS NOT NULL)) - 1"


def grid_steps() -> str:
    first_year = "list_min(list_filter(list_transform(generate_series(1, len(h)), lambda i: CASE WHEN regexp_matches(h[i], '^20\\d{2}$') THEN i END), lambda i: i IS NOT NULL)) - 1"
    code = "CASE " + " ".join(f"WHEN {any_in('words', [_plain(s) for s in (*k.names, *k.grid_synonyms)])} THEN {q(k.code)}" for k in DEFAULT) + " END"
    final = per_code(lambda k: f"list_filter({listed(k.units)}, lambda u: {token_sql('u')} = {token_sql('raw_unit')})[1]")
    return f"""
grids AS (SELECT doc_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS table_no FROM reports),
headers AS (SELECT *, list_transform(t[1], lambda c: {normal("coalesce(c, '')")}) AS h FROM grids WHERE len(t) > 1),
roles AS (SELECT *, coalesce({last_cue(KPI_CUES)}, 0) AS kpi_at, coalesce({last_cue(UNIT_CUES)}, CASE WHEN len(h) > 1 THEN 1 ELSE 0 END) AS unit_at,
  coalesce({last_cue(VALUE_CUES)}, {first_year}, CASE WHEN len(h) > 2 THEN 2 ELSE len(h) - 1 END) AS value_at FROM headers),
grid_rows AS (SELECT doc_id, table_no, kpi_at, unit_at, value_at, unnest(t[2:]) AS r, generate_subscripts(t[2:], 1) AS row_no FROM roles),
grid_cells AS (SELECT doc_id, table_no, row_no, trim(coalesce(r[kpi_at + 1], '')) AS name, trim(coalesce(r[unit_at + 1], '')) AS unit, trim(coalesce(r[value_at + 1], '')) AS raw_value FROM grid_rows WHERE greatest(kpi_at, unit_at, value_at) < len(r)),
grid_named AS (SELECT *, {normal('name')} AS words, CASE WHEN unit <> '' AND NOT regexp_matches(unit, '\\d') THEN unit WHEN regexp_matches(name, '\\(([^)]+)\\)') THEN trim(regexp_extract(name, '\\(([^)]+)\\)', 1)) END AS raw_unit FROM grid_cells WHERE name <> '' AND raw_value <> ''),
grid_coded AS (SELECT *, {code} AS code FROM grid_named),
grid_last AS (SELECT * FROM grid_coded WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, table_no, code ORDER BY row_no DESC) = 1),
grid_first AS (SELECT * FROM grid_last QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY table_no) = 1),
grid_hits AS (SELECT doc_id, {per_code(lambda k: str(DEFAULT.index(k)))} AS ord, code, 'table_grid' AS source, raw_value, raw_unit, {final} AS reported_unit, {SOURCES['table_grid'][2]}::DOUBLE AS confidence FROM grid_first)"""


def numbers(source: str, raw: str, scale: str) -> str:
    """Steps that add `number` to the rows of `source`; scale words count where `scale` holds."""
    words = "CASE WHEN contains(low, 'million') THEN 1e6 WHEN contains(low, 'billion') THEN 1e9 WHEN contains(low, 'thousand') THEN 1e3 WHEN low LIKE '%k' THEN 1e3 ELSE 1 END"
    return f"""
{source}_1 AS (SELECT *, lower(trim({raw})) AS low FROM {source}),
{source}_2 AS (SELECT *, regexp_replace(trim(CASE WHEN {scale} THEN regexp_replace(low, '{SCALE_WORDS}', '', 'g') ELSE {raw} END), '\\.+$', '') AS s FROM {source}_1),
{source}_3 AS (SELECT *, replace(s, ' ', '') AS t, regexp_replace(s, '[ ,.]', '', 'g') AS c FROM {source}_2),
{source}_n AS (SELECT * EXCLUDE (low, s, t, c), CASE WHEN regexp_matches(t, {q(GROUPED)}) THEN TRY_CAST(regexp_replace(t, '[.,]', '', 'g') AS DOUBLE) WHEN regexp_matches(t, {q(WHOLE)}) THEN TRY_CAST(t AS DOUBLE)
  WHEN regexp_matches(t, {q(ONE_MARK)}) THEN TRY_CAST(replace(t, ',', '.') AS DOUBLE) WHEN regexp_matches(c, {q(FLOAT)}) THEN TRY_CAST(replace(c, '_', '') AS DOUBLE) END * CASE WHEN {scale} THEN CAST({words} AS DOUBLE) ELSE 1::DOUBLE END AS number FROM {source}_3)"""


def factor_sql(raw: str, canonical: str) -> str:
    t = token_sql(f"regexp_replace({raw}, '\\s+', '', 'g')")
    known = " ".join(f"WHEN {t} = {q(a)} AND {canonical} = {q(b)} THEN {f}::DOUBLE" for a, b, f in CONVERSIONS)
    return f"CASE WHEN {raw} IS NULL OR {raw} = '' OR {canonical} IS NULL OR {t} = {token_sql(canonical)} THEN 1::DOUBLE {known} ELSE 1::DOUBLE END"


WEIGHT = "CASE source " + " ".join(f"WHEN {q(s)} THEN {w}::DOUBLE" for s, (w, _, _) in SOURCES.items()) + " ELSE 1::DOUBLE END"
PRIORITY = "CASE source " + " ".join(f"WHEN {q(s)} THEN {p}" for s, (_, p, _) in SOURCES.items()) + " ELSE -1 END"


def score_sql(value: str, unit: str, allowed: str, confidence: str) -> str:
    uq = f"CASE WHEN {unit} <> '' THEN CASE WHEN list_contains({allowed}, {unit}) THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE 0::DOUBLE END"
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {confidence} * (0.7::DOUBLE * CASE WHEN {value} IS NOT NULL THEN 1::DOUBLE ELSE 0::DOUBLE END + 0.3::DOUBLE * {uq}) * {WEIGHT}))"


def normal_steps(source: str, out: str) -> str:
    """Steps that turn hits in `source` into candidates in `out`."""
    match = f"list_filter(allowed, lambda u: {token_sql('u')} = {token_sql('raw_unit')})[1]"
    wide = "list_filter(allowed, lambda u: " + token_sql("u") + " = " + token_sql("regexp_replace(raw_unit, '\\s+', '', 'g')") + ")[1]"
    return f"""{numbers(source, 'raw_value', "source IN ('regex', 'nlp', 'llm')")},
{out}_a AS (SELECT *, {per_code(lambda k: listed(k.units))} AS allowed FROM {source}_n),
{out}_v AS (SELECT *, CASE WHEN source = 'regex' THEN number * {factor_sql('raw_unit', 'allowed[1]')} ELSE number END AS value,
  CASE source WHEN 'regex' THEN allowed[1] WHEN 'table_grid' THEN coalesce(CASE WHEN list_contains(allowed, reported_unit) THEN reported_unit END, {match}, CASE WHEN number IS NOT NULL THEN allowed[1] END) WHEN 'table_plain' THEN {wide} ELSE {match} END AS unit FROM {out}_a),
{out} AS (SELECT *, {score_sql('value', 'unit', 'allowed', 'confidence')} AS score FROM {out}_v)"""


def stub_sql() -> str:
    """What the stub client answers, as JSON read by hand: values from the report's id."""
    return "CASE CAST(doc_id AS BIGINT) % 4 WHEN 0 THEN '1.5 million' WHEN 1 THEN concat(doc_id, ',000') WHEN 2 THEN 'unknown' END"


STEPS = f"""
reports AS ({reports_sql()}),
flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM reports),
regex_hits AS ({pattern_rows()}),
split AS (SELECT doc_id, list_filter(string_split(regexp_replace(flat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM flat),
sents AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM split),
wins AS (SELECT *, concat_ws(' ', s, lead(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS win FROM sents),
nlp_hits AS ({sentence_rows()}),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM reports),
all_lines AS (SELECT doc_id, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
row_lines AS (SELECT * FROM all_lines WHERE line <> '' AND (contains(line, '|') OR regexp_matches(line, '\\s{{2,}}') OR (contains(line, '(') AND contains(line, ')'))) AND NOT regexp_matches(lower(line), {q(NARRATIVE)})),
plain_hits AS ({line_rows()}),{grid_steps()},
hits AS (SELECT * FROM grid_hits UNION ALL SELECT * FROM plain_hits UNION ALL SELECT * FROM regex_hits UNION ALL SELECT * FROM nlp_hits),{normal_steps('hits', 'cands')},
chosen AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY score DESC, {PRIORITY} DESC) = 1),
results AS (SELECT r.doc_id, k.ord, k.code, c.value, c.unit, coalesce(c.confidence, 0::DOUBLE) AS confidence, coalesce(c.source, '') AS source, {q(NOT_REPORTED)} AS status, c.value IS NOT NULL AS reported
  FROM reports r CROSS JOIN {KPI_ROWS} LEFT JOIN chosen c ON c.doc_id = r.doc_id AND c.code = k.code),
answers AS (SELECT doc_id, k.ord, k.code, 'llm' AS source, {stub_sql()} AS raw_value, CASE k.ord WHEN 0 THEN 'tCO2e' WHEN 1 THEN 'kWh' END AS raw_unit, CAST(NULL AS VARCHAR) AS reported_unit, {SOURCES['llm'][2]}::DOUBLE AS confidence
  FROM (SELECT DISTINCT doc_id FROM results WHERE value IS NULL) CROSS JOIN {KPI_ROWS} WHERE {stub_sql()} IS NOT NULL),{normal_steps('answers', 'llm_cands')},
filled AS (SELECT r.doc_id, r.ord, r.code, CASE WHEN r.value IS NULL AND a.code IS NOT NULL THEN a.value ELSE r.value END AS value, CASE WHEN r.value IS NULL AND a.code IS NOT NULL THEN a.unit ELSE r.unit END AS unit,
  CASE WHEN r.value IS NULL AND a.code IS NOT NULL THEN a.confidence ELSE r.confidence END AS confidence, CASE WHEN r.value IS NULL AND a.code IS NOT NULL THEN 'llm' ELSE r.source END AS source, r.status FROM results r LEFT JOIN llm_cands a ON a.doc_id = r.doc_id AND a.code = r.code)"""


def chain(select: str, more: str = "") -> str:
    return f"WITH {STEPS.strip()}{', ' + more if more else ''}\n{select}"


HITS = "doc_id, code, raw_value, raw_unit, confidence"
CANDS = "doc_id, code, source, value, unit, round(score, 6) AS score"


def num_sql(text: str, scale: str) -> str:
    rows = f"nums AS (SELECT o_orderkey, {text} AS raw FROM orders)"
    return f"WITH {rows},{numbers('nums', 'raw', scale)} SELECT o_orderkey, raw, number FROM nums_n"


RAW_UNITS = ("tCO2e", "t CO2e", "TCO2", "tons CO2e", "tonnes  CO2e", "MWh", "kwh", "GWh", "m3", "m³", "cubic meters", "thousand m3", "barrels", "")


def unit_pick(d=DUCK) -> str:
    return f"CASE l_orderkey % {len(RAW_UNITS)} " + " ".join(f"WHEN {i} THEN {q(u)}" for i, u in enumerate(RAW_UNITS)) + " END"


def code_pick() -> str:
    return "CASE l_linenumber % 3 " + " ".join(f"WHEN {i} THEN {q(k.code)}" for i, k in enumerate(DEFAULT)) + " END"


def source_pick() -> str:
    return "CASE l_partkey % 5 " + " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(SOURCES)) + " END"


UNIT_SQL = f"""WITH a AS (SELECT l_orderkey, l_linenumber, {code_pick()} AS code, {unit_pick()} AS raw_unit FROM lineitem), b AS (SELECT *, {per_code(lambda k: listed(k.units))} AS allowed FROM a)
SELECT l_orderkey, l_linenumber, raw_unit, allowed[1] AS unit, {factor_sql('raw_unit', 'allowed[1]')} AS factor, CASE WHEN raw_unit <> '' THEN list_filter(allowed, lambda u: {token_sql('u')} = {token_sql('raw_unit')})[1] END AS matched FROM b"""
SCORE_SQL = f"""WITH a AS (SELECT l_orderkey, l_linenumber, {code_pick()} AS code, {source_pick()} AS source, {unit_pick()} AS unit, CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END AS value, l_discount * 10 AS confidence FROM lineitem), b AS (SELECT *, {per_code(lambda k: listed(k.units))} AS allowed FROM a)
SELECT l_orderkey, l_linenumber, source, round({score_sql('value', 'unit', 'allowed', 'confidence')}, 9) AS score FROM b"""

CONSOLE = """rpad(code, CAST(greatest(24, length(code)) AS INTEGER), ' ') || ' ' || lpad(v, CAST(greatest(18, length(v)) AS INTEGER), ' ') || ' ' || rpad(u, CAST(greatest(8, length(u)) AS INTEGER), ' ') || ' ' || lpad(printf('%.2f', confidence), 5, ' ') || ' ' || rpad(source, CAST(greatest(14, length(source)) AS INTEGER), ' ') || ' ' || status"""
SQL = {
    "text_flat": "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents",
    "text_folded": f"SELECT doc_id, md5({normal('text')}) AS digest FROM documents",
    "text_lines": "WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, len(ls) AS n_lines, CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS chars FROM c",
    "kpi_catalogue": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(k.code)}, {q('|'.join(k.names))}, {q('|'.join(k.units))})" for i, k in enumerate(DEFAULT)) + ") AS t(ord, code, synonyms, units)",
    "console_report": chain(f"SELECT doc_id, ord, {CONSOLE} AS line FROM shown", "shown AS (SELECT *, coalesce(printf('%.3f', value), 'None') AS v, coalesce(unit, 'None') AS u FROM results)"),
    "num_locale": num_sql(written(DUCK), "false"),
    "num_scaled": num_sql(scaled(DUCK), "true"),
    "unit_norm": UNIT_SQL,
    "score_calc": SCORE_SQL,
    **{f"regex_{n}": chain(f"SELECT {HITS} FROM picked", f"picked AS ({pattern_rows(n)})") for n in ("value_unit", "bracket_unit_value", "unit_value", "bracket_unit_near_value")},
    "regex_extract": chain(f"SELECT {HITS} FROM regex_hits"),
    "sentence_split": chain("SELECT doc_id, pos - 1 AS pos, s AS sentence, win AS window_text FROM wins"),
    "nlp_strong": chain(f"SELECT {HITS} FROM picked", f"picked AS ({sentence_rows(weak=False)})"),
    "nlp_weak": chain(f"SELECT {HITS} FROM picked", f"picked AS ({sentence_rows(strong=False)})"),
    "nlp_extract": chain(f"SELECT {HITS} FROM nlp_hits"),
    "plain_filter": chain("SELECT doc_id, line FROM row_lines"),
    "plain_filter_documents": f"""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM c)
SELECT doc_id, count(*) AS row_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM t WHERE line <> '' AND (contains(line, '|') OR regexp_matches(line, '\\s{{2,}}') OR (contains(line, '(') AND contains(line, ')'))) AND NOT regexp_matches(lower(line), {q(NARRATIVE)}) GROUP BY doc_id""",
    "plain_extract": chain(f"SELECT {HITS} FROM plain_hits"),
    "grid_header": chain("SELECT doc_id, table_no - 1 AS table_no, CAST(kpi_at AS INTEGER) AS kpi_at, CAST(unit_at AS INTEGER) AS unit_at, CAST(value_at AS INTEGER) AS value_at FROM roles"),
    "grid_extract": chain(f"SELECT {HITS}, reported_unit FROM grid_hits"),
    **{f"norm_{s}": chain(f"SELECT doc_id, code, value, unit FROM cands WHERE source = '{s}'") for s in ("regex", "table_grid", "table_plain", "nlp")},
    "norm_llm": chain("SELECT doc_id, code, value, unit FROM llm_cands"),
    "candidates_union": chain(f"SELECT {CANDS} FROM cands"),
    "fuse_best": chain(f"SELECT {CANDS} FROM chosen"),
    "fuse_complete": chain("SELECT doc_id, code, value, unit, confidence, source FROM results"),
    "missing_codes": chain("SELECT doc_id, code FROM results WHERE value IS NULL"),
    "llm_backfill": chain("SELECT doc_id, code, value, unit, confidence, source, status FROM filled"),
    "kpi_results": chain("SELECT doc_id, code, value, unit, confidence, source, status, reported FROM results"),
    "completeness_by_doc": chain("SELECT doc_id, count(value) AS kpis_found, count(*) AS kpis FROM results GROUP BY doc_id"),
    "source_usage": chain("SELECT CASE WHEN source = '' THEN 'none' ELSE source END AS source, count(*) AS n FROM results GROUP BY 1"),
    "confidence_hist": chain("SELECT CAST(least(floor((confidence - lo) / ((hi - lo) / 10)) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM results, (SELECT min(confidence) AS lo, max(confidence) AS hi FROM results) GROUP BY 1"),
    "extraction_summary": chain("SELECT count(DISTINCT doc_id) AS files, count(*) AS results, round(avg(confidence), 3) AS avg_confidence, count(*) - count(value) AS missing_values, round(avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100, 2) AS pct_missing FROM results"),
    "confidence_by_kpi": chain("SELECT code, round(avg(confidence), 6) AS avg_confidence, count(value) AS found FROM results GROUP BY code"),
    "results_head": chain("SELECT doc_id, code, value FROM results ORDER BY doc_id, code LIMIT 5"),
    "csv_roundtrip": chain("SELECT doc_id, code, value, unit, confidence, nullif(source, '') AS source FROM results"),
    "json_results": chain("SELECT doc_id, count(*) AS kpis, sum(value) AS total FROM results GROUP BY doc_id"),
    "kpi_cross_match": chain(f"SELECT doc_id, k.code, count(*) AS lines FROM all_lines CROSS JOIN {KPI_ROWS} WHERE line <> '' AND {per_code(lambda k: any_in('lower(line)', k.names))} GROUP BY doc_id, k.code"),
    "lookup_join": chain(f"SELECT doc_id, h.code, raw_unit, d.canonical, coalesce(d.factor, 1::DOUBLE) AS factor FROM regex_hits h LEFT JOIN (VALUES {', '.join(f'({q(a)}, {q(b)}, {f}::DOUBLE)' for a, b, f in CONVERSIONS)}) AS d(token, canonical, factor) ON d.token = " + token_sql("regexp_replace(raw_unit, '\\s+', '', 'g')")),
}
