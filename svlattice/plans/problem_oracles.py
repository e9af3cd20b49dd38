r"""Packed fields, schema drift, refused lines and percentiles as DuckDB SQL.

Items and values are matched by patterns of whole tokens (a quoted or bracketed span is part of its token), where the
Spark expressions replace spans and split. Percentiles are exact: they equal the sketches' while a group holds no more values
than the sketches keep, which is so of single days at the scale of the correctness check. Of the whole time the exact
numbers are checked, and that all ranks are within their bound.
"""

from __future__ import annotations

QUOTED = """(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')"""
BRACKETED = r"(?:\[[^\[]*\[|\][^\]]*\])"


def _plain(v: str) -> str:
    """A trimmed value without the marks of its quoted start."""
    return f"""CASE WHEN regexp_full_match(trim({v}), '(?s)"(?:[^"]|"")*".*') THEN replace(regexp_extract(trim({v}), '(?s)^"((?:[^"]|"")*)"(.*)$', 1), '""', '"')||regexp_extract(trim({v}), '(?s)^"((?:[^"]|"")*)"(.*)$', 2)
      WHEN regexp_full_match(trim({v}), '(?s)''(?:[^'']|'''')*''.*') THEN replace(regexp_extract(trim({v}), '(?s)^''((?:[^'']|'''')*)''(.*)$', 1), '''''', '''')||regexp_extract(trim({v}), '(?s)^''((?:[^'']|'''')*)''(.*)$', 2) ELSE trim({v}) END"""


_VALUE = f"(?: *{QUOTED})?[^;|\\t,]*"
#: info(id, item_no, item_key, has_value, val_no, val) of sv_event; ids are (ord, file_id).
INFO = f"""ii AS (SELECT ord, file_id, list_filter(list_transform(regexp_extract_all(info_raw, '[^=;|\\t]*={_VALUE}(?:,{_VALUE})*|[^;|\\t]+'), lambda x: trim(x)), lambda x: x <> '') AS xs FROM sv_event WHERE info_raw IS NOT NULL),
ij AS (SELECT ord, file_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS item_no FROM ii),
ik AS (SELECT *, contains(x, '=') AS has_value, CASE WHEN contains(x, '=') THEN trim(x[:strpos(x, '=') - 1]) ELSE x END AS item_key,
  CASE WHEN contains(x, '=') THEN list_filter(regexp_extract_all(x[strpos(x, '=') + 1:], '(?: *{QUOTED})?[^,]*'), lambda y: trim(y) <> '') ELSE [''] END AS vs FROM ij),
il AS (SELECT *, CASE WHEN len(vs) = 0 THEN [''] ELSE vs END AS ws FROM ik),
im AS (SELECT ord, file_id, item_no, item_key, has_value, unnest(ws) AS v, generate_subscripts(ws, 1) AS val_no FROM il),
info AS (SELECT ord, file_id, item_no, item_key, has_value, val_no, {_plain("v")} AS val FROM im)"""

_BARE = f"regexp_replace(format_raw, '(^|[:;|])( *){QUOTED}', '\\1', 'g')"
SEPARATOR = f"regexp_extract({_BARE}, '[:;|]', 0)"


def _per_separator(make) -> str:
    return f"CASE sep {' '.join(f'WHEN {s!r} THEN {make(s)}' for s in ':;|')} END"


def _cut_format(s: str) -> str:
    return f"regexp_extract_all(format_raw||'{s}', '((?: *{QUOTED})?[^{s}]*)[{s}]', 1)"


def _cut_sample(s: str) -> str:
    value = f"(?: *{QUOTED})?(?:{BRACKETED}|[^{s},])*"
    return f"regexp_extract_all(sample_raw||'{s}', '({value}(?:,{value})*)[{s}]', 1)"


_VALUES = f"regexp_extract_all(c||',', '((?: *{QUOTED})?(?:{BRACKETED}|[^,])*),', 1)"


def _sample(table: str, columns: str) -> str:
    """CTEs to xs(columns, ks, cs): keys and cells of a table with format_raw and sample_raw."""
    return f"""x0 AS (SELECT {columns}, format_raw, sample_raw, coalesce({SEPARATOR}, '') AS sep FROM {table}),
xs AS (SELECT {columns}, sample_raw, format_raw, coalesce({_per_separator(_cut_format)}, [format_raw]) AS ks, coalesce({_per_separator(_cut_sample)}, [sample_raw]) AS cs FROM x0)"""


P1 = f"""WITH {INFO}, {_sample("svcf_event", "ord").replace("x0 AS", "s0 AS").replace("FROM x0", "FROM s0").replace("xs AS", "ss AS")}, {_sample("sv_event", "ord")},
sc AS (SELECT ord, unnest(cs) AS c, generate_subscripts(cs, 1) AS item_no FROM ss WHERE sample_raw IS NOT NULL),
sd AS (SELECT ord, item_no, {_VALUES} AS vs FROM sc), sv AS (SELECT ord, item_no, unnest(vs) AS v, generate_subscripts(vs, 1) AS val_no FROM sd),
fk AS (SELECT ord, unnest(ks) AS v, generate_subscripts(ks, 1) AS item_no FROM xs WHERE format_raw IS NOT NULL)
SELECT ord, 'info' AS fld, item_no, item_key, val_no, val FROM info UNION ALL SELECT ord, 'format', item_no, '', 1, {_plain("v")} FROM fk UNION ALL SELECT ord, 'sample', item_no, '', val_no, {_plain("v")} FROM sv"""

_WORDS = r"regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '[. ]+$', ''), ' +$', '')"
P2 = rf"""WITH {INFO}, {_sample("sv_event", "ord, file_id")},
fk AS (SELECT ord, file_id, unnest(ks) AS k, unnest(list_transform(generate_series(1, len(ks)), lambda i: CASE WHEN sample_raw IS NOT NULL THEN cs[i] END)) AS c FROM xs WHERE format_raw IS NOT NULL),
fv AS (SELECT file_id, k, unnest(coalesce({_VALUES}, [NULL])) AS v FROM fk),
al AS (SELECT file_id, 'info' AS fld, item_key AS k, has_value, val FROM info UNION ALL SELECT file_id, 'format', {_plain("k")}, true, {_plain("v")} FROM fv),
kinds AS (SELECT file_id, fld, k, CASE WHEN NOT bool_or(has_value) THEN 'flag' WHEN count(val) FILTER (val NOT IN ('', '.')) = 0 THEN NULL WHEN bool_and(regexp_full_match(val, '[+-]?[0-9]+')) FILTER (val NOT IN ('', '.')) THEN 'integer'
  WHEN bool_and(regexp_full_match(val, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')) FILTER (val NOT IN ('', '.')) THEN 'float' ELSE 'string' END AS kind FROM al GROUP BY ALL),
decl AS (SELECT file_id, lower(regexp_extract(line, '^##(INFO|FORMAT)=<', 1)) AS fld, regexp_extract(line, '[<,]\s*ID=([^,>"]+)', 1) AS k, arg_min({_WORDS.format("regexp_extract(line, 'Description=" + chr(34) + "([^" + chr(34) + "]*)', 1)")}, line_no) AS words FROM vcf_header
  WHERE regexp_matches(line, '^##(INFO|FORMAT)=<') AND {_WORDS.format("regexp_extract(line, 'Description=" + chr(34) + "([^" + chr(34) + "]*)', 1)")} <> '' GROUP BY 1, 2, 3),
sk AS (SELECT kinds.*, words FROM kinds LEFT JOIN decl USING (file_id, fld, k)),
prev AS (SELECT file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY produced_at, file_id) AS before FROM call_file WHERE series_id IS NOT NULL),
gone AS (SELECT p.file_id, o.fld, o.k, o.kind, o.words FROM prev p JOIN sk o ON o.file_id = p.before WHERE NOT EXISTS (SELECT 1 FROM sk n WHERE n.file_id = p.file_id AND n.fld = o.fld AND n.k = o.k)),
new_ AS (SELECT p.file_id, n.fld, n.k, n.kind, n.words FROM prev p JOIN sk n ON n.file_id = p.file_id WHERE p.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sk o WHERE o.file_id = p.before AND n.fld = o.fld AND n.k = o.k)),
ren AS (SELECT g.file_id, g.fld, g.k AS old_key, n.k AS new_key, g.kind AS k1, n.kind AS k2 FROM gone g JOIN new_ n USING (file_id, fld, words)),
both_ AS (SELECT p.file_id, o.fld, o.k AS old_key, o.k AS new_key, o.kind AS k1, n.kind AS k2 FROM prev p JOIN sk o ON o.file_id = p.before JOIN sk n ON n.file_id = p.file_id AND n.fld = o.fld AND n.k = o.k UNION ALL SELECT * FROM ren)
SELECT file_id, fld, 'renamed' AS drift, old_key, new_key FROM ren UNION ALL SELECT file_id, fld, 'retyped', old_key, new_key FROM both_ WHERE k1 <> k2
UNION ALL SELECT file_id, fld, 'removed', k, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = gone.file_id AND ren.fld = gone.fld AND ren.old_key = gone.k)
UNION ALL SELECT file_id, fld, 'added', '', k FROM new_ WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = new_.file_id AND ren.fld = new_.fld AND ren.new_key = new_.k)"""

#: j(line_id, file_id, line_no, l, cols, quotes, reason)
JUDGED = r"""r AS (SELECT line_id, file_id, line_no, regexp_replace(line, '\r$', '') AS l FROM vcf_line WHERE line IS NOT NULL),
c AS (SELECT *, len(l) - len(replace(l, '"', '')) AS quotes, regexp_extract_all(l||chr(9), '((?:"[^"]*"|[^\t"])*)\t', 1) AS cols FROM r WHERE l <> '' AND NOT starts_with(l, '#')),
j AS (SELECT *, CASE WHEN quotes % 2 = 1 THEN 'quote' WHEN NOT (len(cols) IN (8, 10) OR (len(cols) = 13 AND file_id IN (SELECT file_id FROM call_file WHERE lower(caller) = 'svaba'))) THEN 'columns'
  WHEN NOT (regexp_full_match(cols[2], '[0-9]+') AND try_cast(cols[2] AS HUGEINT) BETWEEN 1 AND 9223372036854775807) THEN 'pos'
  WHEN NOT regexp_full_match(cols[6], '\.|([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'qual'
  WHEN NOT regexp_full_match(cols[5], '[ACGTNacgtn]+\.?|\.[ACGTNacgtn]*|<[A-Za-z0-9_:]+>|[ACGTNacgtn]+(\[[^\[\]]+:[0-9]+\[|\][^\[\]]+:[0-9]+\])|(\[[^\[\]]+:[0-9]+\[|\][^\[\]]+:[0-9]+\])[ACGTNacgtn]+') THEN 'alt' END AS reason FROM c)"""
_OFFSET = lambda n: f"strlen(array_to_string(cols[1:{n - 1}], chr(9))) + 1"
#: Tabs outside quotes, also where a mark stays open: the line up to the last mark, whose columns are whole, and the rest.
_QUOTED_TABS = """CASE WHEN quotes % 2 = 1 THEN len(regexp_extract_all(regexp_replace(l, '"[^"]*$', ''), '(?:"[^"]*"|[^\\t"])*\\t')) + 1 ELSE len(cols) END"""
P3_REFUSED = f"""WITH {JUDGED} SELECT line_id, file_id, line_no, reason, ({_QUOTED_TABS})::INTEGER AS n_columns,
  (CASE reason WHEN 'quote' THEN strlen(l[:len(l) - strpos(reverse(l), '"')]) WHEN 'columns' THEN strlen(l) WHEN 'pos' THEN {_OFFSET(2)} WHEN 'qual' THEN {_OFFSET(6)} ELSE {_OFFSET(5)} END)::INTEGER AS reason_at FROM j WHERE reason IS NOT NULL"""
P3_LOADED = f"""WITH {JUDGED} SELECT line_id, file_id, line_no, cols[1] AS chrom, cols[2]::BIGINT AS pos, cols[3] AS sv_id, cols[4] AS ref_seq, cols[5] AS alt, try_cast(cols[6] AS DOUBLE) AS qual, cols[7] AS filter_raw, cols[8] AS info_raw,
  cols[9] AS format_raw, CASE WHEN len(cols) > 9 THEN cols[len(cols)] END AS sample_raw, CASE WHEN len(cols) > 9 THEN array_to_string(cols[10:], chr(9)) END AS samples FROM j WHERE reason IS NULL"""

_FINITE = r"""CASE WHEN regexp_full_match(qual, '\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') THEN try_cast(trim(qual) AS DOUBLE) END"""


def _percentiles(by: str) -> str:
    """Of each group and measure the values at the ranks, lower ones where a rank falls between two."""
    at = ", ".join(f"vs[greatest(1, ceil({r} * len(vs)))::BIGINT] AS p{round(r * 100):02d}" for r in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"""WITH f AS (SELECT file_id, max(caller) AS caller FROM call_file GROUP BY 1), r AS (SELECT caller, svtype, loaded_at::DATE AS day, {_FINITE} AS q, support::DOUBLE AS s, svlen::DOUBLE AS l FROM sv_event LEFT JOIN f USING (file_id)),
      m AS (SELECT {by}, 'qual' AS measure, q AS v FROM r UNION ALL SELECT {by}, 'support', s FROM r UNION ALL SELECT {by}, 'svlen', l FROM r),
      g AS (SELECT {by}, measure, coalesce(list(v ORDER BY v) FILTER (v IS NOT NULL AND isfinite(v)), []) AS vs FROM m GROUP BY ALL)
      SELECT {by}, measure, len(vs) AS n, {at}, 2.296::DOUBLE / pow(400, 0.9723) AS rank_error FROM g"""


ORACLES: dict[str, str] = {
    "p1_found": P1, "p2_found": P2, "p3_refused": P3_REFUSED, "p3_loaded": P3_LOADED,
    "p3_found": f"WITH {JUDGED} SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p4_percentiles": _percentiles("caller, svtype, day"), "p4_within": f"SELECT caller, svtype, measure, n, true AS within FROM ({_percentiles('caller, svtype')})",
}
