"""The queries of `calls` and `problems` as DuckDB SQL, written from the described behaviour, not from the Spark expressions.

Order-dependent operators are recursive queries that go through the records one by one: an oracle, not a plan.
"""

from __future__ import annotations


def _info(key: str, raw: str = "info_raw") -> str:
    return f"nullif(regexp_extract(';'||{raw}, '(?s)^.*;{key}=([^;]*)', 1), '')"


def _strict(key: str, raw: str = "info_raw") -> str:
    return f"nullif(regexp_extract(';'||{raw}||';', '(?s)^.*;{key}=([^;=]*);', 1), '')"


def _int(text: str) -> str:
    return f"(CASE WHEN regexp_full_match({text}, '[+-]?[0-9]+') THEN try_cast({text} AS BIGINT) END)"


DECIMAL = r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"


def _num(text: str) -> str:
    return f"(CASE WHEN regexp_full_match({text}, '{DECIMAL}') THEN try_cast({text} AS DOUBLE) END)"


def _whole(text: str) -> str:
    return f"try_cast(trunc({_num(text)}) AS BIGINT)"


def _cell(key: str) -> str:
    return f"(CASE WHEN list_contains(string_split(format_raw, ':'), '{key}') THEN string_split(sample_raw, ':')[list_position(string_split(format_raw, ':'), '{key}')] END)"


def _corrected_cell(key: str) -> str:
    """A corrected record's sample value: the first of ALT, CO and REF in the format takes the rest of the sample, keys after it have none."""
    keys, parts = "string_split(format_raw, ':')", "string_split(sample_raw, ':')"
    at, taker = f"list_position({keys}, '{key}')", f"list_min(list_filter(list_transform(['ALT', 'CO', 'REF'], lambda y: list_position({keys}, y)), lambda y: y > 0))"
    return f"(CASE WHEN NOT coalesce(list_contains({keys}, '{key}'), false) THEN NULL WHEN {taker} IS NULL OR {at} < {taker} THEN {parts}[{at}] WHEN {at} = {taker} AND len({parts}) >= {at} - 1 THEN coalesce(array_to_string({parts}[{at}:], ':'), '') END)"


#: Callers in the order in which they are looked for and ranked.
CALLER_ORDER = ("svim", "pbsv", "cutesv", "sniffles", "debreak", "manta", "delly", "svaba", "svdss")

#: The corrected events: e(ord, ..., svtype, start_chrom, start_pos, end_chrom, end_pos, svlen_text, length, support_n, qual_n, caller).
EVENTS = rf"""
e0 AS (SELECT *, coalesce({_info("SVTYPE")}, '') AS svtype, {_info("CHR2")} AS chr2, {_info("END")} AS end_text, {_info("SVLEN")} AS svlen_text, {_info("SUPPORT")} AS support_text,
  {_corrected_cell("SC")} AS sc, {_corrected_cell("CO")} AS co FROM svcf_event),
e2 AS (SELECT *, CASE WHEN svtype IN ('BND','TRA') THEN CASE WHEN regexp_matches(alt, '^[ACGTNacgtn]*[\[\]][^:\[\]]+:[0-9]+[\[\]]') THEN 'alt' ELSE 'info' END
    WHEN regexp_full_match(co, '[^-_]*_[0-9]+-[^-_]*_[0-9]+') THEN 'co' WHEN end_text = '.' THEN 'length' ELSE 'info' END AS how FROM e0),
e3 AS (SELECT *, CASE how WHEN 'co' THEN string_split(string_split(co, '-')[1], '_')[1] ELSE chrom END AS start_chrom, CASE how WHEN 'co' THEN coalesce(try_cast(string_split(string_split(co, '-')[1], '_')[2] AS BIGINT), pos) ELSE pos END AS start_pos,
    CASE how WHEN 'alt' THEN regexp_extract(alt, '^[ACGTNacgtn]*[\[\]]([^:\[\]]+):([0-9]+)', 1) WHEN 'co' THEN regexp_extract(co, '-([^-_]*)_[0-9]+$', 1) ELSE coalesce(chr2, chrom) END AS end_chrom,
    coalesce(CASE how WHEN 'alt' THEN try_cast(regexp_extract(alt, '^[ACGTNacgtn]*[\[\]]([^:\[\]]+):([0-9]+)', 2) AS BIGINT) WHEN 'co' THEN try_cast(regexp_extract(co, '_([0-9]+)$', 1) AS BIGINT)
      WHEN 'length' THEN pos + abs({_int("svlen_text")}) ELSE {_int("end_text")} END, pos) AS end_pos,
    {_int("support_text")} AS support_n, {_num("qual")} AS qual_n,
    CASE WHEN sc IS NULL THEN 'unknown' {" ".join(f"WHEN contains(lower(sc), '{c}') THEN '{c}'" for c in CALLER_ORDER)} ELSE sc END AS caller FROM e2),
e AS (SELECT *, coalesce(abs({_int("svlen_text")}), end_pos - start_pos + 1) AS length FROM e3)
"""

#: The caller records: v(ord, ..., svtype, mate_chrom, mate_pos, bnd_form, route).
CALLS = rf"""
v0 AS (SELECT * EXCLUDE (svtype, svlen, support, format_raw, sample_raw), coalesce(format_raw, 'GT') AS format_raw, coalesce(sample_raw, '0/1') AS sample_raw, coalesce({_strict("SVTYPE")}, '') AS svtype,
  list_filter(regexp_split_to_array(alt, '[\[\]]'), lambda x: contains(x, ':') AND (len(string_split(x, ':')) > 2 OR regexp_full_match(string_split(x, ':')[2], '[+-]?[0-9]+')))[1] AS part FROM sv_event),
v1 AS (SELECT *, CASE WHEN regexp_matches(alt, '[\[\]]') AND len(string_split(part, ':')) = 2 THEN string_split(part, ':')[1] END AS mate_chrom,
  CASE WHEN regexp_matches(alt, '[\[\]]') AND len(string_split(part, ':')) = 2 THEN try_cast(string_split(part, ':')[2] AS BIGINT) END AS mate_pos,
  CASE WHEN regexp_full_match(alt, '[ACGTNacgtn]*\[[^\[\]]+:[0-9]+\[') THEN 't[p[' WHEN regexp_full_match(alt, '[ACGTNacgtn]*\][^\[\]]+:[0-9]+\]') THEN 't]p]'
    WHEN regexp_full_match(alt, '\[[^\[\]]+:[0-9]+\[[ACGTNacgtn]*') THEN '[p[t' WHEN regexp_full_match(alt, '\][^\[\]]+:[0-9]+\][ACGTNacgtn]*') THEN ']p]t' END AS bnd_form,
  regexp_split_to_array(alt, '[\[\]:]') AS cuts FROM v0),
v AS (SELECT *, CASE WHEN svtype <> 'BND' THEN 'other' WHEN len(cuts) = 4 AND cuts[2] = chrom THEN 'same' ELSE 'diff' END AS route FROM v1)
"""

SUPPORT = f"coalesce({', '.join(_strict(k) for k in ('SUPP', 'SUPPREAD', 'WEIGHT', 'RE', 'SUPPORT'))})"
FIRST_FAILURE = f"""
f0 AS (SELECT ord, upper(filter_raw) AS filt, {_num("qual")} AS q, coalesce(nullif({SUPPORT}, '.'), nullif({_strict("SUPPREAD")}, '.'), nullif({_strict("RE")}, '.'), nullif({_strict("DV")}, '.'), {_cell("DV")}, {_cell("DR")},
    string_split({_cell("AD")}, ',')[2]) AS s, {_cell("DP")} AS dp, string_split({_cell("AD")}, ',') AS ad, {_cell("GQ")} AS gq, nullif({_strict("SVLEN")}, '.') AS len_, {_cell("GT")} AS gt FROM v),
f1 AS (SELECT *, {_whole("s")} AS sn, CASE WHEN dp IS NOT NULL THEN {_whole("dp")} ELSE {_whole("ad[1]")} + {_whole("ad[2]")} END AS dn, {_whole("gq")} AS gn, abs({_whole("len_")}) AS ln FROM f0),
f AS (SELECT ord, CASE WHEN q < 5 OR q > 95 THEN 'qual' WHEN filt <> 'PASS' THEN 'pass' WHEN sn < 3 THEN 'support' WHEN dn < 10 THEN 'depth' WHEN gn < 5 THEN 'gq' WHEN ln < 40 OR ln > 20000 THEN 'svlen'
    WHEN gt IN ('./.', '.|.', '.') THEN 'nocall' END AS rule FROM f1)
"""

WAY = """CASE WHEN coalesce(alt, '') = '' THEN 'UNKNOWN' WHEN starts_with(alt, ']') OR (contains(alt, ']') AND ends_with(alt, 'N')) THEN 'RIGHT_TO_LEFT'
 WHEN starts_with(alt, 'N[') OR (contains(alt, '[') AND ends_with(alt, '[')) THEN 'LEFT_TO_RIGHT' WHEN starts_with(alt, 'N]') OR (contains(alt, ']') AND ends_with(alt, ']')) THEN 'RIGHT_TO_RIGHT'
 WHEN starts_with(alt, '[') OR (contains(alt, '[') AND ends_with(alt, 'N')) THEN 'LEFT_TO_LEFT' ELSE 'UNKNOWN' END"""
LOOSE = r"([^\[\]]*)([\[\]])([^:\[\]]+):([0-9]+)([\[\]])([^\[\]]*)"
PARSED = f"""SELECT *, CASE WHEN alt IS NULL OR g1 IS NULL THEN 'UNKNOWN' WHEN g1 <> '' AND g6 = '' THEN CASE WHEN g2 = ']' AND g5 = ']' THEN 't]p]' WHEN g2 = '[' AND g5 = '[' THEN 't[p[' ELSE 'MIXED' END
 WHEN g6 <> '' AND g1 = '' THEN CASE WHEN g2 = ']' AND g5 = ']' THEN ']p]t' WHEN g2 = '[' AND g5 = '[' THEN '[p[t' ELSE 'MIXED' END ELSE 'UNKNOWN' END AS form FROM (
 SELECT *, {", ".join(f"CASE WHEN regexp_matches(alt, '{LOOSE}') THEN regexp_extract(alt, '{LOOSE}', {i}) END AS g{i}" for i in range(1, 7))} FROM e WHERE svtype IN ('BND','TRA'))"""


def _score(caller: str = "caller") -> str:
    """Ten for the first caller, one less for each after it, one for others."""
    return f"(CASE {caller} {' '.join(f'WHEN {n!r} THEN {10.0 - i}::DOUBLE' for i, n in enumerate(CALLER_ORDER))} ELSE 1.0::DOUBLE END)"


TOTAL = f"""(least(coalesce(support_n, 0)::DOUBLE / 30, 1.0::DOUBLE) * 10 * 0.5::DOUBLE + least(coalesce(qual_n, 50.0::DOUBLE) / 100, 1.0::DOUBLE) * 10 * 0.3::DOUBLE + {_score()} * 0.2::DOUBLE)"""


def _first_fit(rows: str, part: str, match: str) -> str:
    """CTEs ending in fit(part, ord, leader_ord): first-fit leaders of `rows` (part, i, ord, ...) where `match` holds of a (earlier) and b."""
    return f"""
o AS ({rows}),
edge AS (SELECT a.{part} AS part, a.i AS ai, b.i AS bi FROM o a JOIN o b ON a.{part} = b.{part} AND a.i < b.i AND {match}),
adj AS (SELECT o.{part} AS part, o.i, o.ord, coalesce(list(e2.ai ORDER BY e2.ai) FILTER (e2.ai IS NOT NULL), []) AS nb FROM o LEFT JOIN edge e2 ON e2.part = o.{part} AND e2.bi = o.i GROUP BY ALL),
st AS (SELECT part, i, ord, [i] AS leaders, i AS leader FROM adj WHERE i = 1
  UNION ALL SELECT a.part, a.i, a.ord, CASE WHEN len(list_intersect(a.nb, s.leaders)) = 0 THEN list_append(s.leaders, a.i) ELSE s.leaders END, coalesce(list_min(list_intersect(a.nb, s.leaders)), a.i)
  FROM st s JOIN adj a ON a.part = s.part AND a.i = s.i + 1),
fit AS (SELECT st.part, st.ord, l.ord AS leader_ord FROM st JOIN adj l ON l.part = st.part AND l.i = st.leader)
"""


BASE = "(CASE svtype WHEN 'INS' THEN 200.0 WHEN 'DEL' THEN 150.0 WHEN 'DUP' THEN 100.0 WHEN 'INV' THEN 100.0 ELSE 50.0 END)::DOUBLE"
RATIO = "(CASE svtype WHEN 'INS' THEN 3.0 WHEN 'DEL' THEN 2.0 WHEN 'DUP' THEN 1.5 WHEN 'INV' THEN 1.5 ELSE 1.3 END)::DOUBLE"
REGULAR_ROWS = "SELECT svtype||' '||start_chrom AS part, row_number() OVER (PARTITION BY svtype, start_chrom ORDER BY ord) AS i, ord, svtype, start_pos, end_pos, length FROM e WHERE svtype IN ('INS','DEL','DUP','INV')"
REACH = BASE.replace("svtype", "a.svtype") + " * (CASE WHEN least(a.length, b.length) >= 1000 THEN 2.0 WHEN least(a.length, b.length) >= 500 THEN 1.5 ELSE 1.0 END)::DOUBLE"
REGULAR_MATCH = f"""abs(a.start_pos - b.start_pos) <= {REACH} AND (a.svtype = 'INS' OR abs(a.end_pos - b.end_pos) <= {REACH}) AND a.length <> 0 AND b.length <> 0
 AND greatest(a.length, b.length)::DOUBLE / nullif(least(a.length, b.length), 0)::DOUBLE <= {RATIO.replace("svtype", "a.svtype")}"""
TRA_ROWS = f"""SELECT least(start_chrom, end_chrom)||' '||greatest(start_chrom, end_chrom) AS part, row_number() OVER (PARTITION BY least(start_chrom, end_chrom), greatest(start_chrom, end_chrom) ORDER BY bucket, ord) AS i,
 ord, start_pos, end_pos, way FROM (SELECT *, min(ord) OVER (PARTITION BY start_chrom, end_chrom) AS bucket, {WAY} AS way FROM e WHERE svtype = 'TRA')"""
SWAP = "(least(a.way, b.way)||' '||greatest(a.way, b.way) IN ('LEFT_TO_RIGHT RIGHT_TO_LEFT', 'LEFT_TO_LEFT RIGHT_TO_RIGHT'))"
TRA_MATCH = f"abs(a.start_pos - CASE WHEN {SWAP} THEN b.end_pos ELSE b.start_pos END) <= 100 AND abs(a.end_pos - CASE WHEN {SWAP} THEN b.start_pos ELSE b.end_pos END) <= 100"
BND_ROWS = f"""SELECT start_chrom||' '||coalesce(g3, 'none '||ord)||' '||form AS part, row_number() OVER (PARTITION BY start_chrom, coalesce(g3, 'none '||ord), form ORDER BY bucket, ord) AS i, ord, start_pos, try_cast(g4 AS BIGINT) AS target_pos
 FROM (SELECT *, min(ord) OVER (PARTITION BY start_chrom) AS bucket FROM ({PARSED}) WHERE svtype = 'BND')"""
BND_MATCH = "abs(a.start_pos - b.start_pos) <= 50 AND abs(a.target_pos - b.target_pos) <= 50"


def _prefixed(sql: str, p: str) -> str:
    """The CTE names of _first_fit with a prefix, so that several may stand in one query."""
    import re

    for name in ("edge", "adj", "st", "fit", "o"):
        sql = re.sub(rf"(?<![\w.'\"]){name}(?=( AS \(|\.| a JOIN| b ON| LEFT| s JOIN| l ON| JOIN| e2|\s+WHERE| a ON))", f"{p}{name}", sql)
    return sql


MEMBERS = (
    _prefixed(_first_fit(REGULAR_ROWS, "part", REGULAR_MATCH), "r_") + "," + _prefixed(_first_fit(TRA_ROWS, "part", TRA_MATCH), "t_") + "," + _prefixed(_first_fit(BND_ROWS, "part", BND_MATCH), "b_")
    + ", members AS (SELECT ord, leader_ord AS cluster_id FROM r_fit UNION ALL SELECT ord, leader_ord FROM t_fit UNION ALL SELECT ord, leader_ord FROM b_fit)"
)
MERGED = f"""{EVENTS}, {MEMBERS},
scored AS (SELECT e.*, cluster_id, {TOTAL} AS score FROM e JOIN members USING (ord)),
merged AS (SELECT cluster_id, arg_max(ord, [score, coalesce(support_n, 0)::DOUBLE, coalesce(qual_n, 50.0), (-ord)::DOUBLE]) AS ord, max(score) AS score, count(*) AS n_members, list_sort(list(DISTINCT source_file)) AS sources FROM scored GROUP BY cluster_id),
files AS (SELECT list(svcf_name ORDER BY svcf_name)[1:3] AS fs FROM call_file)"""


def _where(condition: str) -> str:
    return f"WITH RECURSIVE {MERGED} SELECT cluster_id, array_to_string(sources, ',') AS sources FROM merged, files WHERE {condition}"


BENCH = f"""{EVENTS}, el AS (SELECT * FROM e WHERE svtype = 'TRA' OR abs(end_pos - start_pos) BETWEEN 50 AND 50000),
t AS (SELECT *, row_number() OVER (PARTITION BY svtype ORDER BY ord) AS i FROM el WHERE starts_with(source_file, 'sniffles')),
c AS (SELECT *, row_number() OVER (PARTITION BY svtype ORDER BY ord) AS i FROM el WHERE starts_with(source_file, 'cutesv')),
ok AS (SELECT c.svtype, c.i AS ci, t.i AS ti FROM c JOIN t ON c.svtype = t.svtype AND abs(c.start_pos - t.start_pos) <= 500 AND abs(c.end_pos - t.end_pos) <= 500
  AND CASE WHEN t.svtype = 'TRA' THEN c.start_chrom = t.start_chrom AND c.end_chrom = t.end_chrom ELSE abs(c.end_pos - c.start_pos) <> 0 AND abs(t.end_pos - t.start_pos) <> 0
    AND least(abs(c.end_pos - c.start_pos), abs(t.end_pos - t.start_pos))::DOUBLE / greatest(abs(c.end_pos - c.start_pos), abs(t.end_pos - t.start_pos)) >= 0.7::DOUBLE END),
cand AS (SELECT c.svtype, c.i, c.ord, coalesce(list(ti ORDER BY ti) FILTER (ti IS NOT NULL), []) AS ts FROM c LEFT JOIN ok ON ok.svtype = c.svtype AND ok.ci = c.i GROUP BY ALL),
run AS (SELECT svtype, i, ord, ts[1] AS hit, CASE WHEN len(ts) > 0 THEN [ts[1]] ELSE [] END AS used FROM cand WHERE i = 1
  UNION ALL SELECT n.svtype, n.i, n.ord, list_filter(n.ts, lambda x: NOT list_contains(r.used, x))[1], CASE WHEN len(list_filter(n.ts, lambda x: NOT list_contains(r.used, x))) > 0 THEN list_append(r.used, list_filter(n.ts, lambda x: NOT list_contains(r.used, x))[1]) ELSE r.used END
  FROM run r JOIN cand n ON n.svtype = r.svtype AND n.i = r.i + 1),
pairs AS (SELECT run.ord AS call_ord, t.ord AS truth_ord FROM run JOIN t ON t.svtype = run.svtype AND t.i = run.hit)"""

SIZE = f"(CASE WHEN coalesce({_strict('SVLEN')}, '.') <> '.' THEN abs({_int(_strict('SVLEN'))}) ELSE abs(CASE WHEN {_strict('END')} IS NULL THEN pos ELSE {_int(_strict('END'))} END - pos) END)"


def _summary(values: str) -> str:
    return f"""x AS ({values}), a AS (SELECT list_sort(list(value)) AS a, count(*) AS n FROM x WHERE value IS NOT NULL),
 j AS (SELECT *, greatest(1, least((n + 1) // 4, n - 1)) AS j1, greatest(1, least(3 * (n + 1) // 4, n - 1)) AS j3 FROM a)
SELECT n::BIGINT AS n, round(list_sum(a)::DOUBLE / n, 6) AS mean, (a[(n + 1) // 2] + a[n // 2 + 1]) / 2.0::DOUBLE AS median, a[1] AS least, a[n] AS most,
 round((a[j1] * (4 - ((n + 1) - 4 * j1)) + a[j1 + 1] * ((n + 1) - 4 * j1)) / 4, 6) AS q1, round((a[j3] * (4 - (3 * (n + 1) - 4 * j3)) + a[j3 + 1] * (3 * (n + 1) - 4 * j3)) / 4, 6) AS q3 FROM j WHERE n > 0"""


def _histogram(name: str, value: str, source: str = "svcf_event") -> str:
    return f"SELECT {value} AS {name}, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM {source} GROUP BY 1"


LENGTHS = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636,
    "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345,
    "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415,
}
FIXED = ", ".join(f"({i}, '{c}', {n})" for i, (c, n) in enumerate(LENGTHS.items()))
def _pair_sides(records: str = "v") -> str:
    """CTEs to m: the halves of same-chromosome pairs, numbered within their file and place."""
    return f"""s AS (SELECT ord, file_id, chrom, least(pos, mate_pos) AS start_pos, greatest(pos, mate_pos) AS end_pos, CASE WHEN bnd_form IN ('t[p[', ']p]t') THEN CASE WHEN (bnd_form = 't[p[') = (mate_pos > pos) THEN 'DEL' ELSE 'DUP' END
  ELSE 'INV'||bnd_form END AS kind, CASE WHEN pos < mate_pos THEN 0 WHEN pos > mate_pos THEN 1 END AS side FROM {records} WHERE route = 'same' AND mate_chrom = chrom AND bnd_form IS NOT NULL AND (bnd_form NOT IN ('t[p[', ']p]t') OR pos <> mate_pos)),
 k AS (SELECT *, row_number() OVER (PARTITION BY file_id, chrom, start_pos, end_pos, kind, side ORDER BY ord) AS n FROM s),
 m AS (SELECT * EXCLUDE (side, n), CASE WHEN side IS NULL THEN (n + 1) % 2 ELSE side END AS side, CASE WHEN side IS NULL THEN (n + 1) // 2 ELSE n END AS n FROM k)"""


PAIRS = """SELECT a.kind[1:3] AS kind, least(a.ord, b.ord) AS first_ord, greatest(a.ord, b.ord) AS second_ord, CASE WHEN a.start_pos = a.end_pos THEN greatest(a.ord, b.ord) ELSE a.ord END AS base_ord,
      a.chrom, a.start_pos, a.end_pos FROM m a JOIN m b USING (file_id, chrom, start_pos, end_pos, kind, n) WHERE a.side = 0 AND b.side = 1"""
BED_END = f"CASE WHEN svtype IN ('INS','TRA') OR {_info('END')} IS NULL THEN pos ELSE {_int(_info('END'))} END"

ORACLES: dict[str, str] = {
    "resolved_coordinates": f"WITH {EVENTS} SELECT ord, svtype, start_chrom, start_pos, end_chrom, end_pos, length FROM e",
    "bnd_pattern": f"WITH {CALLS} SELECT ord, bnd_form, mate_chrom, mate_pos, route FROM v",
    "bnd_alt_parse": f"WITH {EVENTS} SELECT ord, form, g3 AS target, try_cast(g4 AS BIGINT) AS target_pos FROM ({PARSED})",
    "tra_orientation": f"WITH {EVENTS} SELECT ord, {WAY} AS way FROM e WHERE svtype IN ('BND','TRA') AND alt IS NOT NULL",
    "caller_scores": f"WITH {EVENTS} SELECT ord, caller, {_score()} AS caller_score, {TOTAL} AS score FROM e",
    "merge_thresholds": f"WITH {EVENTS} SELECT ord, {BASE} * (CASE WHEN length >= 1000 THEN 2.0 WHEN length >= 500 THEN 1.5 ELSE 1.0 END)::DOUBLE AS distance, {RATIO} AS ratio FROM e WHERE svtype IN ('INS','DEL','DUP','INV')",
    "natural_chrom_order": "SELECT contig_name, array_to_string(list_transform(regexp_extract_all(contig_name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS sort_key FROM contig",
    "caller_info": f"""WITH {CALLS} SELECT ord, svtype, {SUPPORT} AS support_text, nullif(regexp_extract(';'||info_raw||';', '(?si)^.*;strand=([^;=]*);', 1), '') AS strand, coalesce({_strict("RNAMES")}, '.') AS rnames,
      {_strict("CHR2")} AS chr2, {_strict("END")} AS end_text, {_strict("SVLEN")} AS svlen_text FROM v""",
    "parsed_samples": f"SELECT ord, {_corrected_cell('GT')} AS gt, {_corrected_cell('AD')} AS ad, {_corrected_cell('LN')} AS ln, {_corrected_cell('SC')} AS sc FROM svcf_event",
    "depth_of_alleles": f"SELECT ord, coalesce(list_sum(list_transform(list_filter(string_split({_corrected_cell('AD')}, ','), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::BIGINT)), 0)::BIGINT AS depth FROM svcf_event",
    "filter_first_failure": f"WITH {CALLS}, {FIRST_FAILURE} SELECT ord, rule FROM f",
    "filter_stats": f"""WITH {CALLS}, {FIRST_FAILURE} SELECT count(*) AS total, count(*) FILTER (rule IS NULL) AS passed, {", ".join(f"count(*) FILTER (rule = '{r}') AS filtered_{r}" for r in ("qual", "pass", "support", "depth", "gq", "svlen", "nocall"))},
      count(*) FILTER (rule IS NULL) / count(*)::DOUBLE AS pass_rate FROM f""",
    "pair_same_chromosome": f"""WITH {CALLS}, mates AS (SELECT ord, file_id, chrom, pos, mate_chrom, mate_pos, bnd_form, route FROM v UNION ALL
      SELECT -1 - ord, file_id, chrom, mate_pos, mate_chrom, pos, CASE bnd_form WHEN 't[p[' THEN ']p]t' WHEN ']p]t' THEN 't[p[' ELSE bnd_form END, route FROM v WHERE route = 'same' AND mate_pos IS NOT NULL), {_pair_sides('mates')} {PAIRS}""",
    "cluster_sv": f"WITH RECURSIVE {EVENTS}, {_first_fit(REGULAR_ROWS, 'part', REGULAR_MATCH)} SELECT ord, leader_ord AS cluster_id FROM fit",
    "cluster_tra": f"WITH RECURSIVE {EVENTS}, {_first_fit(TRA_ROWS, 'part', TRA_MATCH)} SELECT ord, leader_ord AS cluster_id FROM fit",
    "cluster_bnd": f"WITH RECURSIVE {EVENTS}, {_first_fit(BND_ROWS, 'part', BND_MATCH)} SELECT ord, leader_ord AS cluster_id FROM fit",
    "representative": f"WITH RECURSIVE {MERGED} SELECT cluster_id, ord, score, n_members, array_to_string(sources, ',') AS sources FROM merged",
    "region_lookup": f"WITH RECURSIVE {MERGED} SELECT cluster_id, e.start_pos, e.end_pos FROM merged JOIN e USING (ord) WHERE svtype = 'DEL' AND start_chrom = 'chr1' AND start_pos <= 60000000 AND end_pos >= 1",
    "merge_union": _where("list_has_any(sources, fs)"),
    "merge_intersect": _where("list_has_all(sources, (SELECT sources[1:2] FROM merged ORDER BY len(sources) DESC, cluster_id LIMIT 1))"),
    "merge_specific": _where("list_contains(sources, fs[1]) AND NOT list_has_any(sources, fs[2:3])"),
    "merge_exact": _where("len(sources) = 2"),
    "merge_range": _where("len(sources) BETWEEN 2 AND 4"),
    "merge_expression": _where("(list_contains(sources, fs[1]) OR list_contains(sources, fs[2])) AND NOT list_contains(sources, fs[3])"),
    "upset_counts": f"WITH RECURSIVE {MERGED} SELECT array_to_string(sources, ',') AS sources_text, len(sources)::INTEGER AS n_files, count(*) AS n FROM merged GROUP BY sources",
    "file_totals": f"WITH RECURSIVE {MERGED}, u AS (SELECT unnest(sources) AS file FROM merged) SELECT svcf_name AS file, (SELECT count(*) FROM u WHERE u.file = svcf_name) AS n FROM call_file",
    "bench_eligible": f"WITH {EVENTS} SELECT ord, svtype FROM e WHERE svtype = 'TRA' OR abs(end_pos - start_pos) BETWEEN 50 AND 50000",
    "bench_matches": f"WITH RECURSIVE {BENCH} SELECT call_ord, truth_ord FROM pairs",
    "bench_metrics": f"""WITH RECURSIVE {BENCH}, k AS (SELECT (SELECT count(*) FROM pairs) AS tp, (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM t) AS nt), pr AS (SELECT tp, nc - tp AS fp, nt - tp AS fn, tp / nc::DOUBLE AS precision, tp / nt::DOUBLE AS recall FROM k)
      SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM pr""",
    "reciprocal_overlaps": f"""WITH RECURSIVE {BENCH} SELECT call_ord, truth_ord, CASE WHEN least(t.end_pos, c.end_pos) - greatest(t.start_pos, c.start_pos) > 0 THEN least((least(t.end_pos, c.end_pos) - greatest(t.start_pos, c.start_pos)) / nullif(t.end_pos - t.start_pos, 0)::DOUBLE,
      (least(t.end_pos, c.end_pos) - greatest(t.start_pos, c.start_pos)) / nullif(c.end_pos - c.start_pos, 0)::DOUBLE) ELSE 0.0::DOUBLE END AS overlap FROM pairs JOIN t ON t.ord = truth_ord JOIN c ON c.ord = call_ord""",
    "stat_types": _histogram("svtype", f"coalesce({_strict('SVTYPE')}, 'Unknown')"),
    "stat_sizes": f"""WITH x AS (SELECT {SIZE} AS s FROM svcf_event), y AS (SELECT s FROM x WHERE s >= 50) SELECT count(*) AS n, min(s)::DOUBLE AS least, max(s)::DOUBLE AS most, round(avg(s), 6) AS mean, median(s)::DOUBLE AS median, round(stddev_samp(s), 4) AS stdev FROM y""",
    "stat_size_bins": f"""WITH x AS (SELECT {SIZE} AS s FROM svcf_event) SELECT CASE WHEN s <= 50 THEN '0-50 bp' WHEN s <= 100 THEN '51-100 bp' WHEN s <= 500 THEN '101-500 bp' WHEN s <= 1000 THEN '501-1 kb' WHEN s <= 10000 THEN '1 kb-10 kb' ELSE '>10 kb' END AS bin,
      count(*) AS n FROM x WHERE s >= 50 GROUP BY 1""",
    "stat_chrom": "SELECT chrom, count(*) AS n, count(*) / (CASE WHEN regexp_full_match(chrom, 'chr([1-9]|1[0-9]|2[0-2]|X)') THEN 100000000 WHEN chrom = 'chrY' THEN 50000000 ELSE 1 END / 1e6::DOUBLE) AS density FROM svcf_event GROUP BY chrom",
    "stat_qual": f"WITH {_summary(f'SELECT v AS value FROM (SELECT {_num("qual")} AS v FROM svcf_event) WHERE v <> 0')}",
    "stat_support": f"WITH {_summary(f'SELECT v::DOUBLE AS value FROM (SELECT {_int(_info("SUPPORT"))} AS v FROM svcf_event) WHERE v > 0')}",
    "stat_filter": _histogram("status", "filter_raw"),
    "stat_gt": _histogram("gt", _cell("GT")),
    "plot_density": f"WITH p(plot_no, chrom, len_) AS (VALUES {FIXED}) SELECT plot_no, p.chrom, count(s.ord) AS n, round(count(s.ord) / (len_ / 1e6::DOUBLE), 1) AS density FROM p LEFT JOIN svcf_event s ON s.chrom = p.chrom GROUP BY plot_no, p.chrom, len_",
    "to_vcf": f"""WITH {EVENTS}, w AS (SELECT *, {_int(_info("SVLEN"))} AS n, coalesce({_corrected_cell("AD")}, '.,.') AS ad FROM e) SELECT ord, concat_ws(chr(9), coalesce(chrom, '.'), coalesce(pos::VARCHAR, '.'), coalesce(sv_id, '.'), CASE WHEN ref_seq = 'N' THEN '.' ELSE coalesce(ref_seq, '.') END,
      CASE WHEN coalesce(alt, '') IN ('', 'N', '.') THEN '<'||svtype||'>' ELSE alt END, coalesce(qual, '.'), coalesce(filter_raw, '.'),
      concat_ws(';', 'SVTYPE='||svtype, 'END='||CASE WHEN svtype = 'INS' THEN pos ELSE end_pos END, 'SVLEN='||CASE svtype WHEN 'DEL' THEN -abs(n) WHEN 'INS' THEN abs(n) ELSE n END, {", ".join(f"'{k}='||{_info(k)}" for k in ("CHR2", "SUPPORT", "SVMETHOD", "STRAND"))}),
      'GT:AD:DP:LN', concat_ws(':', coalesce({_corrected_cell("GT")}, './.'), ad, coalesce(list_sum(list_transform(list_filter(string_split(ad, ','), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::BIGINT)), 0)::BIGINT, coalesce({_corrected_cell("LN")}, '.'))) AS line FROM w""",
    "to_bed": f"""WITH {EVENTS}, w AS (SELECT *, {BED_END} AS be, {_info("STRAND")} AS strand FROM e) SELECT ord, concat_ws(chr(9), chrom, pos - 1, be,
      CASE WHEN svtype = 'TRA' THEN coalesce(sv_id, '.')||'_TRA_'||coalesce({_info("CHR2")}, '')||':'||coalesce({_info("END")}, '') ELSE coalesce(sv_id, '.')||'_'||svtype||'_'||coalesce({_info("SVLEN")}, CASE WHEN svtype = 'INS' THEN '0' ELSE (be - pos + 1)::VARCHAR END)||'bp' END,
      coalesce({_info("SUPPORT")}, qual, '.'), CASE WHEN strand IN ('+-', '-+') THEN '-' WHEN strand = '++' THEN '+' WHEN strand IN ('+', '-') THEN strand ELSE '.' END) AS line FROM w WHERE be IS NOT NULL AND chrom IS NOT NULL AND pos IS NOT NULL""",
    "to_bedpe": f"""WITH {EVENTS}, w AS (SELECT *, CASE WHEN {_info("END")} IS NULL THEN pos ELSE {_int(_info("END"))} END AS be, {_info("STRAND")} AS strand FROM e) SELECT ord, concat_ws(chr(9), chrom, pos - 1, pos, coalesce({_info("CHR2")}, chrom), be - 1, be, coalesce(sv_id, '.')||'_'||svtype,
      coalesce({_info("SUPPORT")}, qual, '.'), CASE WHEN strand IN ('-+', '--') THEN '-' ELSE '+' END, CASE WHEN strand IN ('+-', '--') THEN '-' WHEN strand IN ('++', '-+') THEN '+' WHEN svtype IN ('INV', 'TRA') THEN '-' ELSE '+' END, svtype, coalesce({_info("SVLEN")}, '.')) AS line
      FROM w WHERE be IS NOT NULL AND chrom IS NOT NULL AND pos IS NOT NULL""",
    "p5_found": """WITH RECURSIVE n AS (SELECT ord, trim(string_split(trim(source_file), '/')[-1])||chr(1)||trim(sv_id) AS name FROM svcf_event),
      m AS (SELECT trim(string_split(trim(a_source_file), '/')[-1])||chr(1)||trim(a_sv_id) AS a, trim(string_split(trim(b_source_file), '/')[-1])||chr(1)||trim(b_sv_id) AS b FROM sv_match
        WHERE a_source_file IS NOT NULL AND a_sv_id IS NOT NULL AND b_source_file IS NOT NULL AND b_sv_id IS NOT NULL),
      g AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT DISTINCT name AS x, name AS y FROM n UNION SELECT r.x, g.b FROM reach r JOIN g ON g.a = r.y),
      lowest AS (SELECT x, min(n.ord) AS group_ord FROM reach JOIN n ON n.name = y GROUP BY x) SELECT ord, coalesce(group_ord, ord) AS group_ord FROM n LEFT JOIN lowest ON x = name""",
}
