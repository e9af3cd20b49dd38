"""Breakend passes, corrected records and merged rows as DuckDB SQL: the sequential passes record by record."""

from __future__ import annotations

from svlattice.plans.oracles import CALLS, EVENTS, FIRST_FAILURE, MERGED, PAIRS, SUPPORT, _cell, _info, _int, _pair_sides, _strict

T = 3  # the tolerance of mates

#: What becomes of a pair by its role and two forms; R: both, linked; I: both; M: the one of the smaller chromosome.
RULES = """rules(role, f1, f2, rule) AS (VALUES ('mate','t[p[','t[p[','R'), ('mate','t]p]','t]p]','I'), ('mate','[p[t','[p[t','I'), ('mate',']p]t',']p]t','R'), ('mate','t[p[','t]p]','IM'),
  ('mate','t[p[','[p[t','I'), ('mate','t[p[',']p]t','M'), ('mate','t]p]','[p[t','R'), ('mate','t]p]',']p]t','I'), ('mate','[p[t',']p]t','I'),
  ('special','t[p[','t]p]','I'), ('special','t[p[','[p[t','I'), ('special','t[p[',']p]t','R'), ('special','t]p]','[p[t','R'), ('special','t]p]',']p]t','I'), ('special','[p[t',']p]t','I'))"""

_MATE = f"x.c = r.d AND x.d = r.c AND abs(x.p - r.q) <= {T} AND abs(x.q - r.p) <= {T}"
_SAME = "x.c = r.c AND x.p = r.p AND x.d = r.d AND x.q = r.q"
_NEAR = f"x.c = r.c AND x.d = r.d AND abs(x.p - r.p) <= {T} AND abs(x.q - r.q) <= {T}"
_NONE = "[]::STRUCT(c VARCHAR, p BIGINT, d VARCHAR, q BIGINT, o BIGINT, b BIGINT)[]"


def _best(near: str, i: str, j: str) -> str:
    """The order number of the held record that comes first by its offsets."""
    return f"list_sort(list_transform(list_filter(s.w, lambda x: {near}), lambda x: {{'i': x.p - r.{i}, 'j': x.q - r.{j}, 'o': x.o, 'b': x.b}}))[1]"


def _run(name: str, rows: str, near: str, i: str, j: str, begun: str, replaced: bool) -> str:
    """A recursive table over `rows` (file_id, i, ord, c, p, d, q): the held records w after each and its hit."""
    held = f"list_filter(s.w, lambda x: NOT ({_SAME}))" if replaced else "s.w"
    return f"""{name} AS (SELECT file_id, 0::BIGINT AS i, {_NONE} AS w, NULL::BIGINT AS hit, NULL::BIGINT AS ord, NULL::BIGINT AS b FROM (SELECT DISTINCT file_id FROM {rows})
  UNION ALL SELECT r.file_id, r.i, CASE WHEN {_best(near, i, j)} IS NOT NULL THEN list_filter(s.w, lambda x: x.o <> {_best(near, i, j)}.o)
    ELSE list_append({held}, {{'c': r.c, 'p': r.p, 'd': r.d, 'q': r.q, 'o': r.ord, 'b': {begun}}}) END, {_best(near, i, j)}.o, r.ord, {"r.b" if name == "sp" else "r.ord"}
  FROM {name} s JOIN {rows} r ON r.file_id = s.file_id AND r.i = s.i + 1)"""


def _roles(records: str) -> str:
    """CTEs to roles(file_id, role, first_ord, second_ord, rank, rank2)."""
    return f"""d AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS i, ord, chrom AS c, pos AS p, mate_chrom AS d, mate_pos AS q FROM {records} WHERE route = 'diff' AND chrom IS NOT NULL AND pos IS NOT NULL AND mate_chrom IS NOT NULL AND mate_pos IS NOT NULL),
{_run("mt", "d", _MATE, "q", "p", "r.ord", True)},
{_run("qu", "d", _MATE, "q", "p", f"coalesce(list_filter(s.w, lambda x: {_SAME})[1].b, r.ord)", False)},
lf AS (SELECT file_id, unnest(w) AS x FROM (SELECT file_id, arg_max(w, i) AS w FROM qu GROUP BY file_id)),
le AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY x.b, x.o) AS i, x.o AS ord, x.c, x.p, x.d, x.q, x.b FROM lf),
{_run("sp", "le", _NEAR, "p", "q", "r.b", False)},
sg AS (SELECT file_id, unnest(w) AS x FROM (SELECT file_id, arg_max(w, i) AS w FROM sp GROUP BY file_id)),
roles AS (SELECT file_id, 'mate' AS role, hit AS first_ord, ord AS second_ord, ord AS rank, 0::BIGINT AS rank2 FROM mt WHERE hit IS NOT NULL UNION ALL SELECT file_id, 'special', hit, ord, b, ord FROM sp WHERE hit IS NOT NULL
  UNION ALL SELECT file_id, 'single', x.o, x.o, x.b, x.o FROM sg)"""


ROLES = _roles("v")


def _has(key: str) -> str:
    return f"regexp_matches(';'||info_raw||';', ';{key}[=;]')"


def _shown(key: str) -> str:
    return f"CASE WHEN regexp_matches(';'||info_raw||';', ';{key}=[^;=]*;') THEN regexp_extract(';'||info_raw||';', '(?s)^.*;{key}=([^;=]*);', 1) WHEN {_has(key)} THEN 'None' ELSE '.' END"


_NATURAL = "array_to_string(list_transform(regexp_extract_all({0}, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '')"
_ZERO = f"coalesce({_int('{0}')}, 0)"
_TYPE = "string_split(svtype, ':')[1]"
_GIVEN = f"CASE WHEN {_has('SVLEN')} THEN {_shown('SVLEN')} END"

#: out(branch, rank, rank2, rank3, out_type, out_end, out_len, out_chr2, out_rtid, out_alt, and the caller columns of v)
CORRECTED = f"""{CALLS}, {_pair_sides()}, pr AS ({PAIRS}), {ROLES}, {RULES},
ev AS (SELECT v.*, {_strict("STRAND")} AS plain_strand, nullif(regexp_extract(';'||info_raw||';', '(?si)^.*;strand=([^;=]*);', 1), '') AS strand, {SUPPORT} AS support_text, {_strict("END")} AS end_text, {_strict("CHR2")} AS chr2_text FROM v),
kept AS (SELECT 0 AS branch, ord AS rank, 0::BIGINT AS rank2, 0::BIGINT AS rank3, ord, 'BND' AS out_type, coalesce(mate_pos::VARCHAR, '.') AS out_end, '.' AS out_len, coalesce(mate_chrom, '.') AS out_chr2, NULL::VARCHAR AS rtid, NULL::VARCHAR AS new_alt
  FROM ev WHERE route = 'same' AND ord NOT IN (SELECT first_ord FROM pr UNION ALL SELECT second_ord FROM pr)),
made AS (SELECT 1, CASE kind WHEN 'DEL' THEN 0 WHEN 'DUP' THEN 1 ELSE 2 END::BIGINT, first_ord, 0::BIGINT, base_ord, kind, end_pos::VARCHAR, abs(end_pos - start_pos)::VARCHAR, chrom, NULL::VARCHAR, '<'||kind||'>' FROM pr),
both_ AS (SELECT r.*, a.sv_id AS id1, b.sv_id AS id2, rule, CASE WHEN {_NATURAL.format("a.chrom")} <= {_NATURAL.format("b.chrom")} THEN first_ord ELSE second_ord END AS small FROM roles r JOIN ev a ON a.ord = first_ord JOIN ev b ON b.ord = second_ord
  JOIN rules ON rules.role = r.role AND ((f1 = a.bnd_form AND f2 = b.bnd_form) OR (f1 = b.bnd_form AND f2 = a.bnd_form)) WHERE r.role <> 'single'),
rows_ AS (SELECT role, rank, rank2, 0 AS no, first_ord AS ord, CASE WHEN rule = 'R' THEN id2 END AS rtid FROM both_ WHERE rule <> 'M' UNION ALL SELECT role, rank, rank2, 1, second_ord, CASE WHEN rule = 'R' THEN id1 END FROM both_ WHERE rule <> 'M'
  UNION ALL SELECT role, rank, rank2, 2, small, NULL FROM both_ WHERE contains(rule, 'M') UNION ALL SELECT role, rank, rank2, 0, first_ord, NULL FROM roles WHERE role = 'single'),
tra AS (SELECT CASE role WHEN 'mate' THEN 2 WHEN 'special' THEN 3 ELSE 4 END, rank, rank2, no::BIGINT, ord, 'TRA', coalesce(mate_pos::VARCHAR, '.'), '.', coalesce(mate_chrom, '.'), rtid, NULL::VARCHAR FROM rows_ JOIN ev USING (ord)),
other AS (SELECT 5, ord, 0::BIGINT, 0::BIGINT, ord, CASE WHEN {_TYPE} IN ('INV','INS','DEL','TRA','DUP') THEN {_TYPE} ELSE svtype END,
  CASE WHEN {_TYPE} = 'INS' THEN (CASE WHEN pos <> 0 AND {_ZERO.format(f"({_GIVEN})")} <> 0 THEN pos + {_ZERO.format(f"({_GIVEN})")} ELSE pos END)::VARCHAR ELSE {_shown("END")} END,
  CASE WHEN {_TYPE} = 'TRA' THEN '.' ELSE coalesce({_GIVEN}, CASE WHEN {_TYPE} IN ('DEL','DUP','INV') THEN CASE WHEN pos <> 0 AND {_ZERO.format("end_text")} <> 0 THEN abs({_ZERO.format("end_text")} - pos)::VARCHAR ELSE '.' END END, '.') END,
  CASE WHEN {_has("CHR2")} THEN {_shown("CHR2")} ELSE chrom END, NULL::VARCHAR, NULL::VARCHAR FROM ev WHERE route = 'other'),
al AS (SELECT * FROM kept UNION ALL SELECT * FROM made UNION ALL SELECT * FROM tra UNION ALL SELECT * FROM other),
out_ AS (SELECT al.* EXCLUDE (rtid, new_alt), ev.* EXCLUDE (ord), coalesce(rtid, {_shown("RTID")}) AS out_rtid, coalesce(new_alt, alt) AS out_alt FROM al JOIN ev USING (ord))"""

_BOTH = f"CASE WHEN {_cell('DR')} IS NOT NULL AND {_cell('DV')} IS NOT NULL THEN {_cell('DR')}||','||{_cell('DV')} END"
_AD = f"coalesce(nullif(coalesce({_cell('AD')}, {_BOTH}), ''), '.,.')"
_LENGTH = f"coalesce(abs({_int('out_len')})::VARCHAR, out_len)"
_END = "CASE WHEN out_type = 'INS' AND regexp_full_match(out_len, '[0-9]+') THEN (pos + out_len::BIGINT)::VARCHAR ELSE out_end END"
_SUPPORT = f"coalesce(support_text, CASE WHEN {_has('SUPPORT')} THEN {_shown('SUPPORT')} END, CASE WHEN format_raw <> 'GT' THEN string_split({_cell('PR')}, ',')[2] END, '.')"
_dot = lambda c: f"coalesce({c}::VARCHAR, '.')"
_INFO = f"""concat_ws(';', 'SVTYPE='||out_type, 'END='||out_end, 'SVLEN='||{_LENGTH}, 'CHR2='||out_chr2, 'SUPPORT='||{_SUPPORT}, 'SVMETHOD=svlattice', 'RTID='||out_rtid, 'AF='||({_shown("AF")}), 'STRAND='||coalesce(strand, '.'), 'RNAMES='||coalesce({_strict("RNAMES")}, '.'))"""
_SAMPLE = f"""concat_ws(':', coalesce({_cell("GT")}, '.'), {_AD}, {_dot(f"abs({_int('out_len')})")}, coalesce(strand, '.'), {_dot("qual")}, {_dot("out_type")}, {_dot("sv_id")}, {_dot("file_name")}, {_dot("ref_seq")}, {_dot("alt")},
  coalesce(CASE WHEN out_chr2 <> '.' AND ({_END}) <> '.' THEN chrom||'_'||pos||'-'||out_chr2||'_'||({_END}) END, '.'))"""
LINES = f"""SELECT file_id, branch, rank, rank2, rank3, concat_ws(chr(9), {", ".join(_dot(c) for c in ("chrom", "pos", "sv_id", "ref_seq", "out_alt", "qual", "filter_raw"))}, {_INFO}, 'GT:AD:LN:ST:QV:TY:ID:SC:REF:ALT:CO', {_SAMPLE}) AS line
  FROM out_ LEFT JOIN (SELECT file_id, file_name FROM call_file) USING (file_id)"""

#: The merged rows: laid(cluster_id, ord, base, s) with each member's sample by its representative's keys, info(cluster_id, text) without SOURCES.
ROWS = f"""{MERGED}, fl AS (SELECT base, row_number() OVER (ORDER BY base) - 1 AS place, regexp_replace(base, '(.)\\.[^.]*$', '\\1') AS shown FROM (SELECT DISTINCT svcf_name AS base FROM call_file WHERE svcf_name IS NOT NULL)),
rep AS (SELECT merged.cluster_id, e.* FROM merged JOIN e USING (ord)),
mem AS (SELECT cluster_id, e.ord, string_split(source_file, '/')[-1] AS base, string_split(format_raw, ':') AS ks, string_split(sample_raw, ':') AS ss,
  list_min(list_filter(list_transform(['ALT', 'CO', 'REF'], lambda y: list_position(string_split(format_raw, ':'), y)), lambda y: y > 0)) AS taker FROM members JOIN e USING (ord)),
laid AS (SELECT mem.cluster_id, mem.ord, mem.base, regexp_replace(array_to_string(list_transform(string_split(rep.format_raw, ':'), lambda k: coalesce(CASE WHEN NOT list_contains(ks, k) THEN NULL WHEN taker IS NULL OR list_position(ks, k) < taker THEN ss[list_position(ks, k)]
  WHEN list_position(ks, k) = taker AND len(ss) >= taker - 1 THEN coalesce(array_to_string(ss[taker:], ':'), '') END, '.')), ':'), ':\\.:\\.$', '') AS s FROM mem JOIN rep USING (cluster_id)),
items AS (SELECT cluster_id, unnest(string_split(coalesce(info_raw, '.'), ';')) AS x, generate_subscripts(string_split(coalesce(info_raw, '.'), ';'), 1) AS i FROM rep),
uniq AS (SELECT cluster_id, CASE WHEN contains(x, '=') THEN x[:strpos(x, '=') - 1] ELSE x END AS k, min(i) AS i, arg_max(CASE WHEN contains(x, '=') THEN x[strpos(x, '=') + 1:] ELSE 'True' END, i) AS val FROM items GROUP BY ALL)"""


def _line(sources: str, samples: str) -> str:
    """Of rep joined with those: the row's text."""
    head = ", ".join(_dot(c) for c in ("chrom", "pos", "sv_id", "ref_seq", "alt", "qual", "filter_raw"))
    info = f"(SELECT string_agg(k||'='||CASE WHEN k = 'SOURCES' THEN {sources} ELSE val END, ';' ORDER BY i) FROM uniq WHERE uniq.cluster_id = rep.cluster_id)"
    return f"concat_ws(chr(9), {head}, CASE WHEN contains({info}, 'SOURCES') THEN {info} ELSE {info}||';SOURCES='||{sources} END, {_dot('format_raw')}, {samples})"


_SOURCES = "src AS (SELECT cluster_id, string_agg(shown, ',' ORDER BY place) AS sources FROM (SELECT DISTINCT cluster_id, place, shown FROM laid JOIN fl USING (base)) GROUP BY 1)"
_MISSING = "'0/0:'||rtrim(repeat('.:', len(string_split(format_raw, ':')) - 1), ':')"

ORACLES: dict[str, str] = {
    "breakend_roles": f"WITH RECURSIVE {CALLS}, {ROLES} SELECT role, first_ord, second_ord FROM roles",
    "breakend_roles_filtered": f"WITH RECURSIVE {CALLS}, {FIRST_FAILURE}, kv AS (SELECT v.* FROM v JOIN f USING (ord) WHERE rule IS NULL), {_roles('kv')} SELECT role, first_ord, second_ord FROM roles",
    "dropped_breakends": f"WITH {CALLS} SELECT ord, alt FROM v WHERE route = 'diff' AND (mate_chrom IS NULL OR mate_pos IS NULL)",
    "typed_events": f"WITH {EVENTS} SELECT ord, svtype FROM e WHERE svtype IN ('INS','DEL','INV','DUP','TRA','BND')",
    "event_sequences": f"WITH {EVENTS} SELECT ord, coalesce({_info('SVSEQ')}, {_info('SEQ')}, CASE WHEN len(alt) > 1 AND NOT starts_with(alt, '<') THEN alt END) AS seq FROM e",
    "header_contigs": r"""WITH h AS (SELECT file_id, line_no, regexp_extract(line, '[<,]ID=([^,>]+)', 1) AS contig_id, regexp_extract(line, '[<,]length=([^,>]+)', 1) AS length FROM vcf_header WHERE starts_with(line, '##contig'))
      SELECT contig_id, arg_max(length, [file_id, line_no]) AS length FROM h WHERE contig_id <> '' AND length <> '' GROUP BY 1""",
    "header_sources": "SELECT file_id::VARCHAR AS path, arg_max(string_split(string_split(line, '=')[2], ' ')[1], line_no) AS source, bool_or(contains(lower(line), 'svaba')) AS svaba FROM vcf_header WHERE starts_with(line, '##source=') GROUP BY 1",
    "format_problems": r"""WITH r AS (SELECT file_id::VARCHAR AS path, regexp_replace(line, '\r$', '') AS line FROM vcf_line WHERE line IS NOT NULL), c AS (SELECT *, string_split(line, chr(9)) AS cols FROM r WHERE NOT starts_with(line, '#') AND trim(line) <> ''),
      p AS (SELECT path, line, CASE WHEN contains(line, ' ') THEN 'space' WHEN len(cols) < 8 THEN 'columns' WHEN NOT regexp_full_match(cols[2], '[+-]?[0-9]+') OR try_cast(cols[2] AS BIGINT) IS NULL THEN 'pos'
        WHEN cols[6] <> '.' AND NOT regexp_full_match(lower(cols[6]), '[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)') THEN 'qual' END AS problem FROM c)
      SELECT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT path, NULL, 'no header' FROM r GROUP BY path HAVING NOT bool_or(starts_with(line, '#'))""",
    "display_names": r"""SELECT file_id, regexp_replace(regexp_extract(svcf_name, '[^/]*$'), '(.)\.[^.]*$', '\1') AS shown, CASE WHEN len(svcf_name) > 30 THEN svcf_name[:15]||'...'||svcf_name[-10:] ELSE svcf_name END AS short,
      CASE WHEN len(file_name) > 12 THEN file_name[:15]||'...'||file_name[-10:] ELSE file_name END AS shorter FROM call_file""",
    "merged_order": f"""WITH RECURSIVE {MERGED}, m AS (SELECT cluster_id, svtype, start_chrom FROM merged JOIN e USING (ord)) SELECT cluster_id, (CASE svtype WHEN 'TRA' THEN 0 WHEN 'BND' THEN 1 WHEN 'INS' THEN 2 WHEN 'DEL' THEN 3 WHEN 'DUP' THEN 4 ELSE 5 END)::INTEGER AS kind,
      min(cluster_id) OVER (PARTITION BY svtype, start_chrom) AS first FROM m""",
    "corrected_branches": f"WITH RECURSIVE {CORRECTED} SELECT file_id, branch, rank, rank2, rank3, ord, out_type, out_end, out_len, out_chr2, out_rtid FROM out_",
    "corrected_lines": f"WITH RECURSIVE {CORRECTED} {LINES}",
    "merged_caller_rows": f"""WITH RECURSIVE {ROWS}, {_SOURCES}, sm AS (SELECT cluster_id, string_agg(s, chr(9) ORDER BY place NULLS LAST, laid.ord) AS samples FROM laid LEFT JOIN fl USING (base) GROUP BY 1)
      SELECT cluster_id, {_line("sources", "samples")} AS line FROM rep JOIN src USING (cluster_id) JOIN sm USING (cluster_id)""",
    "merged_sample_rows": f"""WITH RECURSIVE {ROWS}, {_SOURCES}, firsts AS (SELECT cluster_id, place, arg_min(s, laid.ord) AS s FROM laid JOIN fl USING (base) GROUP BY 1, 2),
      sm AS (SELECT cluster_id, string_agg(coalesce(s, {_MISSING}), chr(9) ORDER BY fl.place) AS samples FROM rep CROSS JOIN fl LEFT JOIN firsts USING (cluster_id, place) GROUP BY 1)
      SELECT cluster_id, {_line("sources", "samples")} AS line FROM rep JOIN src USING (cluster_id) JOIN sm USING (cluster_id)""",
}
