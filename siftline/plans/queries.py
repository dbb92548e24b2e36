"""The registered queries of the search operators, each over whole tables, and the same as SQL."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.patterns import Options, Pattern, compile_pattern
from siftline.operators import aggregate, index, lines, rank, search
from siftline.plans.cursor import Cursor, push
from siftline.plans.request import SearchRequest, exit_code
from siftline.sources import corpus
from siftline.sources.stored import new_folder

ASCII = Options(unicode=False)
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Documents and their lines, as every query below sees them.
D = "d AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, text AS body FROM documents)"
L = f"""{D}, a AS (SELECT doc_id, path, string_split(body, chr(10)) AS p FROM d WHERE body IS NOT NULL),
    n AS (SELECT doc_id, path, p, unnest(range(1, len(p) + 1)) AS i FROM a),
    l AS (SELECT doc_id, path, CAST(i AS BIGINT) AS line_number, p[i] AS line FROM n WHERE NOT (i = len(p) AND p[i] = ''))"""


def register(name: str, sql: str | None, plan: Callable[[DataFrame], DataFrame], source=corpus.documents) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(source(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = sql


def pat(p, **options) -> Pattern:
    return compile_pattern(p, Options(unicode=False, **options))


def _lines(name: str, where: str, pattern: Callable[[], Pattern], **how) -> None:
    register(name, f"WITH {L} SELECT path, line_number, line FROM l WHERE {where}", lambda d: search.matching_lines(d, pattern(), **how))


IS_THE = r"regexp_matches(line, '(^|[^0-9A-Za-z_])the([^0-9A-Za-z_]|$)')"
_lines("lines_literal", "contains(line, 'token =')", lambda: pat("token =", fixed=True))
_lines("lines_literal_punct", "contains(line, '$$$')", lambda: pat("$$$", fixed=True))
_lines("lines_regex", "regexp_matches(line, 'token = \"[0-9a-f]{8}')", lambda: pat('token = "[0-9a-f]{8}'))
_lines("lines_regex_anchored", "regexp_matches(line, '^The ')", lambda: pat("^The "))
_lines("lines_regex_eol", r"regexp_matches(line, 'ing\.$')", lambda: pat(r"ing\.$"))
_lines("lines_regex_classcount", "regexp_matches(line, '[0-9a-f]{16}')", lambda: pat("[0-9a-f]{16}"))
_lines("lines_regex_alternation", "regexp_matches(line, 'License|password|token')", lambda: pat("License|password|token"))
_lines("lines_regex_dense", "regexp_matches(line, '[a-z]{12,14}')", lambda: pat("[a-z]{12,14}"))
_lines("lines_posix_class", "regexp_matches(line, '[[:digit:]]{4} [[:digit:]]{4}')", lambda: pat("[[:digit:]]{4} [[:digit:]]{4}"))
_lines("lines_icase", "regexp_matches(line, '(?i)éeau')", lambda: compile_pattern("éeau", Options(ignore_case=True)))
_lines("lines_smart_case", "regexp_matches(line, '(?i)license')", lambda: compile_pattern("license", Options(smart_case=True)))
_lines("lines_smart_case_capital", "contains(line, 'License')", lambda: compile_pattern("License", Options(smart_case=True)))
_lines("lines_word", IS_THE, lambda: pat("the", word=True))
_lines("lines_whole", "line = 'Released under the MIT License.'", lambda: pat("Released under the MIT License.", fixed=True, line=True))
_lines("lines_invert", "NOT contains(line, 'e')", lambda: pat("e", fixed=True), invert=True)
_lines("lines_multi_pattern", "contains(line, 'License') OR contains(line, 'token')", lambda: pat(["License", "token"], fixed=True))
_lines("lines_unicode_class", r"regexp_matches(line, '\p{Lu}\p{Ll}+é')", lambda: compile_pattern(r"\p{Lu}\p{Ll}+é"))
_lines("lines_script", r"regexp_matches(line, '\p{Latin}{16}')", lambda: compile_pattern(r"\p{Latin}{16}"))
_lines("lines_named_group", "regexp_matches(line, '(?P<key>token) = ')", lambda: pat("(?P<key>token) = "))
_lines("lines_lookahead", "regexp_matches(line, '[a-z]+ing\\.')", lambda: pat(r"[a-z]+ing(?=\.)"))
_lines("lines_lookbehind", r"regexp_matches(line, 'MIT License')", lambda: pat("(?<=MIT )License"))
_lines(
    "lines_backreference",
    " OR ".join(f"contains(line, '{c * 4}')" for c in "abcdefghijklmnopqrstuvwxyz"),
    lambda: pat(r"([a-z])\1\1\1"),
)
_lines("lines_possessive", "regexp_matches(line, 'e+r')", lambda: pat("e++r"))
register("lines_pages", "SELECT url AS path, CAST(i AS BIGINT) AS line_number, p[i] AS line FROM (SELECT url, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT url, string_split(html, chr(10)) AS p FROM pages)) WHERE NOT (i = len(p) AND p[i] = '') AND contains(p[i], '<article>')", lambda d: search.matching_lines(d, pat("<article>", fixed=True)), corpus.pages)

HAS = "contains(line, 'token')"
TOKEN = lambda: pat("token", fixed=True)
register("files_with_match", f"WITH {L} SELECT DISTINCT path FROM l WHERE {HAS}", lambda d: search.files_with(d, TOKEN()))
register("files_without_match", f"WITH {L} SELECT path FROM d WHERE path NOT IN (SELECT path FROM l WHERE {HAS})", lambda d: search.files_without(d, TOKEN()))
register("count_lines", f"WITH {L} SELECT path, count(*) AS n FROM l WHERE {IS_THE} GROUP BY 1", lambda d: search.count_lines(d, pat("the", word=True)))
register("count_lines_include_zero", f"WITH {L} SELECT d.path, count(l.path) AS n FROM d LEFT JOIN l ON d.path = l.path AND {HAS} GROUP BY 1", lambda d: search.count_lines(d, TOKEN(), include_zero=True))
register("count_lines_invert", f"WITH {L} SELECT path, count(*) AS n FROM l WHERE NOT {HAS} GROUP BY 1", lambda d: search.count_lines(d, TOKEN(), invert=True))
register("count_corpus", f"WITH {L} SELECT count(*) AS n FROM l WHERE {HAS}", lambda d: search.count_lines(d, TOKEN()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
register("count_matches", f"WITH {L} SELECT path, CAST(sum(len(regexp_extract_all(line, '[a-z]+ing'))) AS BIGINT) AS n FROM l GROUP BY 1 HAVING n > 0", lambda d: search.count_matches(d, pat("[a-z]+ing")))
register("quiet_exists", f"WITH {L} SELECT count(*) > 0 AS found FROM l WHERE {HAS}", lambda d: d.sparkSession.createDataFrame([(search.exists(d, TOKEN()),)], "found boolean"))
register("absent", f"WITH {L} SELECT count(*) = 0 AS absent FROM l WHERE contains(line, 'zzqqzz')", lambda d: d.sparkSession.createDataFrame([(search.absent(d, pat("zzqqzz", fixed=True)),)], "absent boolean"))
register("only_matching", f"""WITH {L}, m AS (SELECT path, line_number, regexp_extract_all(line, '[0-9a-f]{{12,}}') AS t, regexp_split_to_array(line, '[0-9a-f]{{12,}}') AS p FROM l WHERE regexp_matches(line, '[0-9a-f]{{12,}}')),
    o AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM m), q AS (SELECT path, line_number, t[i] AS text, list_sum([strlen(x) FOR x IN p[1:i]]) + coalesce(list_sum([strlen(x) FOR x IN t[1 : i - 1]]), 0) AS start FROM o)
    SELECT path, line_number, text, CAST(start AS BIGINT) AS start, CAST(start + strlen(text) AS BIGINT) AS "end" FROM q""",
    lambda d: search.only_matching(d, pat("[0-9a-f]{12,}")).withColumns({c: F.col(c).cast("long") for c in ("start", "end")}))
#: All occurrences in a line, later ones too: {0} by its pieces, with the bytes before each.
ALL = "{L}, m AS (SELECT path, line_number, line, string_split(line, '{0}') AS p FROM l WHERE contains(line, '{0}')), o AS (SELECT *, unnest(range(1, len(p))) AS i FROM m), s AS (SELECT path, line_number, line, CAST(list_sum([strlen(x) FOR x IN p[1:i]]) + (i - 1) * strlen('{0}') AS BIGINT) AS start FROM o)"
register("match_offsets", f"WITH {ALL.format('token', L=L)} SELECT path, line_number, start, start + 5 AS \"end\" FROM s", lambda d: search.match_records(d, TOKEN()).select("path", "line_number", F.explode("submatches").alias("m")).select("path", "line_number", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end")))
register("vimgrep_columns", f"WITH {ALL.format('License', L=L)} SELECT path, line_number, start + 1 AS col, line FROM s", lambda d: search.vimgrep(d, pat("License", fixed=True)))
register("replace_groups", f"""WITH {L} SELECT path, line_number, regexp_replace(line, '([a-z]+) = "([0-9a-f]+)"', '\\2 := \\1', 'g') AS line FROM l WHERE regexp_matches(line, '([a-z]+) = "([0-9a-f]+)"')""", lambda d: search.replaced(d, pat('(?P<k>[a-z]+) = "([0-9a-f]+)"'), "$2 := ${k}"))
register("passthru", f"WITH {L} SELECT path, line_number, line, {HAS} AS is_match FROM l", lambda d: search.passthru(d, TOKEN()))
CONTEXT = f"""WITH {L}, h AS (SELECT *, {HAS} AS hit FROM l),
    c AS (SELECT path, line_number, line, hit, max(hit) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h),
    k AS (SELECT *, line_number - lag(line_number) OVER (PARTITION BY path ORDER BY line_number) AS step FROM c WHERE near)
    SELECT path, line_number, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind,
           CAST(sum(CASE WHEN step > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_number) AS BIGINT) AS group_id FROM k"""
register("context_window", CONTEXT, lambda d: search.with_context(d, TOKEN(), before=1, after=2))
register("max_count", f"WITH {L} SELECT path, line_number, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number) AS r FROM l WHERE {IS_THE}) WHERE r <= 2", lambda d: search.matching_lines(d, pat("the", word=True), max_count=2))
register("multiline_spans", f"""WITH {D} SELECT path, 'ing.' || chr(10) AS text, CAST(i AS BIGINT) AS first_line, CAST(i AS BIGINT) AS last_line
    FROM (SELECT path, p, unnest(range(1, len(p))) AS i FROM (SELECT path, string_split(body, chr(10)) AS p FROM d)) WHERE ends_with(p[i], 'ing.')""", lambda d: search.multiline_spans(d, pat(r"ing\.\n", multiline=True)))
register("formatted_lines", f"WITH {L} SELECT path || ':' || line_number || ':' || line AS value FROM l WHERE {HAS}", lambda d: search.formatted(search.matching_lines(d, TOKEN())))
register("search_stats", f"""WITH {L}, s AS (SELECT path, count(*) AS k, sum(len(regexp_extract_all(line, 'token'))) AS n FROM l WHERE {HAS} GROUP BY 1)
    SELECT (SELECT count(*) FROM d) AS files, count(*) AS files_matched, CAST(coalesce(sum(k), 0) AS BIGINT) AS lines_matched, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches, (SELECT CAST(sum(strlen(body)) AS BIGINT) FROM d) AS bytes FROM s""", lambda d: search.stats(d, TOKEN()))
register("line_offsets", f"""WITH {L} SELECT path, line_number, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l""", lambda d: lines.line_offsets(d).select("path", "line_number", "byte_offset"))

register("context_invert", CONTEXT.replace(f"{HAS} AS hit", "NOT contains(line, 'e') AS hit"), lambda d: search.with_context(d, pat("e", fixed=True), before=1, after=2, invert=True))
register("context_max_count", CONTEXT.replace(f"{HAS} AS hit", f"{IS_THE} AND sum(CASE WHEN {IS_THE} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_number) <= 1 AS hit"), lambda d: search.with_context(d, pat("the", word=True), before=1, after=2, max_count=1))
register("files_invert", f"WITH {L} SELECT DISTINCT path FROM l WHERE NOT {IS_THE}", lambda d: SearchRequest("the", word=True, unicode=False, invert=True).files(d))
register("count_lines_max_count", f"WITH {L} SELECT path, least(count(*), 2) AS n FROM l WHERE {IS_THE} GROUP BY 1", lambda d: search.count_lines(d, pat("the", word=True), max_count=2))
register("null_data_records", f"WITH {D} SELECT path, CAST(1 AS BIGINT) AS line_number, body AS line FROM d WHERE contains(body, 'token')", lambda d: SearchRequest("token", fixed=True, null_data=True).lines(d))
register("only_matching_replace", f"""WITH {L}, m AS (SELECT path, line_number, unnest(regexp_extract_all(line, '[0-9a-f]{{12,}}')) AS text FROM l)
    SELECT path, line_number, '<' || substr(text, 1, 4) || '>' AS text FROM m""", lambda d: search.only_matching(d, pat("([0-9a-f]{4})[0-9a-f]{8,}"), "<$1>").select("path", "line_number", "text"))
#: Matched lines with their spans, as text.
SPANS = f"{ALL.format('token', L=L)}, h AS (SELECT path, line_number, line, string_agg(start || '-' || (start + 5), ',' ORDER BY start) AS spans, count(*) AS n FROM s GROUP BY ALL)"
RECORD = "path string, line_number long, line string, submatches array<struct<text string, start int, end int>>, matched_lines long, matches long, files long"


def as_spans(column: str):
    return F.array_join(F.transform(F.col(column), lambda m: F.concat_ws("-", m["start"], m["end"])), ",").alias("spans")


register("json_records", f"WITH {SPANS} SELECT path, line_number, line, spans FROM h", lambda d: search.json_lines(d, TOKEN()).select(F.from_json("value", RECORD).alias("r")).select("r.path", "r.line_number", "r.line", as_spans("r.submatches")))
register("json_stream", f"""WITH {SPANS}, e AS (SELECT path, max(line_number) AS last, count(*) AS k, sum(n) AS n FROM h GROUP BY 1)
    SELECT path, line_number AS seq, 'match' AS kind, line, spans, NULL AS matched_lines, NULL AS matches, NULL AS files FROM h
    UNION ALL SELECT path, 0, 'begin', NULL, NULL, NULL, NULL, NULL FROM e UNION ALL SELECT path, last + 1, 'end', NULL, NULL, k, CAST(n AS BIGINT), NULL FROM e
    UNION ALL SELECT NULL, 0, 'summary', NULL, NULL, coalesce(CAST(sum(k) AS BIGINT), 0), coalesce(CAST(sum(n) AS BIGINT), 0), count(*) FROM e""",
    lambda d: search.json_stream(d, TOKEN()).select("path", "seq", F.from_json("value", f"type string, data struct<{RECORD.replace(' string', ': string').replace(' long', ': long').replace(' array', ': array').replace('text:', 'text:').replace(' int', ': int')}>").alias("r"))
        .select("path", "seq", F.col("r.type").alias("kind"), "r.data.line", as_spans("r.data.submatches"), "r.data.matched_lines", "r.data.matches", "r.data.files"))
register("formatted_context", f"{CONTEXT.replace('SELECT path, line_number, line, CASE', 'SELECT path, line_number, line, CASE', 1).rsplit('SELECT path', 1)[0]} SELECT path || CASE WHEN hit THEN ':' ELSE '-' END || line_number || CASE WHEN hit THEN ':' ELSE '-' END || line AS value FROM k", lambda d: search.formatted(search.with_context(d, TOKEN(), before=1, after=2)))

DIR, EXT = r"regexp_extract(path, '^(.*)/[^/]*$', 1)", r"regexp_extract(path, '(\.[^./]*)$', 1)"
for by, key in (("file", "path"), ("dir", DIR), ("ext", EXT)):
    register(f"tally_{by}", f'WITH {L} SELECT {key} AS key, count(*) AS "count", count(DISTINCT path) AS files FROM l WHERE {IS_THE} GROUP BY 1', lambda d, by=by: aggregate.summary(d, pat("the", word=True), by))
register("tally_match", f"""WITH {L} SELECT regexp_extract(line, '[A-Z][a-z]+ing') AS key, count(*) AS "count", count(DISTINCT path) AS files FROM l WHERE regexp_matches(line, '[A-Z][a-z]+ing') GROUP BY 1""", lambda d: aggregate.summary(d, pat("[A-Z][a-z]+ing"), "match"))
register("tally_custom", f"""WITH {L} SELECT CAST(len(line) // 100 AS VARCHAR) AS key, count(*) AS "count", count(DISTINCT path) AS files FROM l WHERE {HAS} GROUP BY 1""", lambda d: aggregate.summary(d, TOKEN(), F.expr("cast(length(line) div 100 as string)")))
register("summary_topk", f"""WITH {L} SELECT path AS key, count(*) AS "count", count(DISTINCT path) AS files FROM l WHERE {IS_THE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", lambda d: aggregate.summary(d, pat("the", word=True), "file", 10))

OVERLAPS = "len([i FOR i IN range(1, len(body) - 1) IF substr(body, i, 3) = 'ere'])"
register("codex_count", f"WITH {D}, c AS (SELECT path, {OVERLAPS} AS n FROM d WHERE contains(body, 'ere')) SELECT CAST(sum(n) AS BIGINT) AS \"count\", count(*) AS files FROM c", lambda d: aggregate.literal_total(d, "ere"))
register("codex_tally", f"WITH {D} SELECT path, CAST({OVERLAPS} AS BIGINT) AS n FROM d WHERE contains(body, 'ere') ORDER BY n DESC, path LIMIT 20", lambda d: aggregate.literal_tally(d, "ere", 20))

GENUS = "CASE WHEN regexp_matches(path, '^docs?/') THEN 'docs' ELSE 'code' END"
register("type_scope", f"WITH {L} SELECT path, line_number, line FROM l WHERE ends_with(path, '.fr') AND {HAS}", lambda d: SearchRequest("token", fixed=True, types=("fr",)).lines(d))
register("type_exclude", f"WITH {L} SELECT path, line_number, line FROM l WHERE NOT ends_with(path, '.fr') AND {HAS}", lambda d: SearchRequest("token", fixed=True, not_types=("fr",)).lines(d))
register("glob_scope", f"WITH {L} SELECT path, line_number, line FROM l WHERE regexp_matches(path, '^src1[0-9]?/') AND NOT ends_with(path, '.de') AND {HAS}", lambda d: SearchRequest("token", fixed=True, globs=("/src1*/**", "!*.de")).lines(d))
register("path_scope", f"WITH {L} SELECT path, line_number, line FROM l WHERE starts_with(path, 'src0/') AND {HAS}", lambda d: SearchRequest("token", fixed=True, paths=("./src0/",)).lines(d))
register("depth_scope", f"WITH {D} SELECT path FROM d WHERE len(string_split(path, '/')) <= 2 AND strlen(body) <= 2048", lambda d: SearchRequest("x", max_depth=2, max_size=paths.parse_size("2K")).scope(d).select("path"))
register("ignore_rules", f"WITH {D} SELECT path FROM d WHERE NOT (starts_with(path, 'src0/') OR (ends_with(path, '.es') AND NOT starts_with(path, 'src7/')))", lambda d: SearchRequest("x", ignore_rules=("*.es", "!/src7/*.es", "src0/")).scope(d).select("path"))
register("ignore_hierarchy", f"WITH {D} SELECT path FROM d WHERE NOT (starts_with(path, 'src1/') OR (ends_with(path, '.es') AND NOT starts_with(path, 'src7/')) OR regexp_matches(path, '^src7/1[^/]*[.]de$'))", lambda d: SearchRequest("x", ignore_rules=("*.es", "src1/"), ignore_tree=(("src7", ("!*.es", "/1*.de")), ("src1", ("!*",)))).listing(d))
register("type_registry", f"WITH {L} SELECT path, line_number, line FROM l WHERE (ends_with(path, '.fr') OR ends_with(path, '.de')) AND {HAS}", lambda d: SearchRequest("token", fixed=True, types=("prose",), type_add=("prose:include:fr", "prose:*.de")).lines(d))
register("list_files", f"WITH {D} SELECT path FROM d", lambda d: d.select("path"))
register("sort_path_component", f"WITH {D} SELECT path FROM d ORDER BY string_split(path, '/')", lambda d: d.select("path").orderBy(paths.by_component(F.col("path"))))

TRI = f"{D}, t AS (SELECT DISTINCT doc_id, tri FROM (SELECT doc_id, substr(body, unnest(range(1, len(body) - 1)), 3) AS tri FROM d))"
register("trigram_stats", f"WITH {TRI} SELECT (SELECT count(*) FROM d) AS files, count(DISTINCT tri) AS distinct_trigrams, count(*) AS postings FROM t", index.trigram_stats)
register("crest_runs", f"WITH {D} SELECT path, coalesce(list_max([len(x) FOR x IN regexp_extract_all(body, '[0-9a-f]+')]), 0) AS hex_run, coalesce(list_max([len(x) FOR x IN regexp_extract_all(body, '[0-9]+')]), 0) AS digit_run, coalesce(list_max([len(x) FOR x IN regexp_extract_all(body, '[A-Z]+')]), 0) AS upper_run FROM d", index.crest)
register("amend_overlay", f"WITH {L} SELECT path, line_number, line FROM l WHERE doc_id % 7 <> 3 AND doc_id % 5 <> 0 AND {HAS} UNION ALL SELECT path, 1, 'token of ' || path FROM d WHERE doc_id % 5 = 0", lambda d: search.matching_lines(index.overlay(d, d.where("doc_id % 5 = 0").withColumn("body", F.concat(F.lit("token of "), "path")), d.where("doc_id % 7 = 3").select("doc_id")), TOKEN()))


CONV = "SELECT 'conv/' || conv_id || '/' || turn || '.' || role AS path, text FROM conversations"
register("lines_conversations", f"SELECT path, count(*) AS n FROM ({CONV}), unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[a-z]+ing') GROUP BY ALL", lambda d: search.count_lines(d, pat("[a-z]+ing")), corpus.conversations)
register("only_matching_lookbehind", f"WITH {L}, m AS (SELECT path, line_number, unnest(regexp_extract_all(line, 'MIT License')) AS t FROM l) SELECT path, line_number, 'X-License' AS text FROM m", lambda d: search.only_matching(d, pat("(?<=MIT )License"), "X-$0").select("path", "line_number", "text"))
KINDS = "CASE doc_id % 3 WHEN 0 THEN 'docs/' || path WHEN 1 THEN path || '.json' ELSE path || '.py' END"
register("genus_partition", f"WITH {D} SELECT CASE doc_id % 3 WHEN 0 THEN 'docs' WHEN 1 THEN 'data' ELSE 'code' END AS genus, count(*) AS files FROM d GROUP BY 1", lambda d: d.withColumn("path", F.expr(KINDS)).groupBy(paths.genus(F.col("path")).alias("genus")).agg(F.count(F.lit(1)).alias("files")))
HIDING = "CASE WHEN doc_id % 4 = 0 THEN '.cfg/' || path ELSE path END"
register("hidden_scope", f"WITH {D} SELECT path FROM d WHERE doc_id % 4 <> 0", lambda d: SearchRequest("x").listing(d.withColumn("path", F.expr(HIDING))))
register("iglob_scope", f"WITH {D} SELECT path FROM d WHERE ends_with(path, '.fr')", lambda d: SearchRequest("x", iglobs=("*.FR",)).listing(d))
register("crlf_lines", f"WITH {L} SELECT path, line_number, line FROM l WHERE regexp_matches(line, 'ing\\.$')", lambda d: SearchRequest(r"ing\.$", unicode=False, crlf=True).lines(d.withColumn("body", F.replace("body", F.lit("\n"), F.lit("\r\n")))))
register("headed_lines", f"WITH {L}, h AS (SELECT * FROM l WHERE {HAS}) SELECT path, line_number AS seq, line_number || ':' || line AS value FROM h UNION ALL SELECT DISTINCT path, CAST(0 AS BIGINT), path FROM h", lambda d: search.headed(search.matching_lines(d, TOKEN())))

_RUNS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g'), '\\s+', ' ', 'g'), '[^a9 ]', '.', 'g')"
register("rank_topk", f"""WITH {L}, h AS (SELECT *, CASE WHEN regexp_matches(line, '{rank.DECLARES}') THEN 0 ELSE 1 END AS use FROM l WHERE regexp_matches(line, 'token|License')),
    b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY use, line_number) AS r, count(*) OVER (PARTITION BY path) AS n, sum(len(line) + 1) OVER (PARTITION BY path) AS width FROM h),
    f AS (SELECT path, line_number, line, n, CAST(1000 * n // width AS BIGINT) AS density, substr({_RUNS}, 1, {rank.SHAPE}) AS shape, len(string_split(path, '/')) AS depth,
          CASE WHEN regexp_matches(path, '{rank.MIRRORED}') THEN 'mirror' WHEN regexp_matches(path || chr(10) || line, '{rank.GENERATED}') THEN 'gen' WHEN use = 0 THEN 'def' ELSE 'use' END AS kind FROM b WHERE r = 1),
    g AS (SELECT *, floor(log2(count(*) OVER (PARTITION BY shape))) AS sharing FROM f),
    o AS (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS c, dense_rank() OVER (ORDER BY density DESC) AS d,
          dense_rank() OVER (ORDER BY sharing) AS s, dense_rank() OVER (ORDER BY depth) AS e FROM g),
    t AS (SELECT *, 0e0 + {rank.WEIGHTS['by_count']}e0 / (c + {rank.SMOOTHING}) + {rank.WEIGHTS['by_density']}e0 / (d + {rank.SMOOTHING})
          + {rank.WEIGHTS['by_shape']}e0 / (s + {rank.SMOOTHING}) + {rank.WEIGHTS['by_depth']}e0 / (e + {rank.SMOOTHING}) + CASE WHEN kind = 'def' THEN {rank.BOOST}e0 WHEN kind IN ('gen', 'mirror') THEN -{rank.DEMOTION}e0 ELSE 0e0 END AS score FROM o)
    SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank, path, line_number, kind, n AS "count", trim(line) AS snippet FROM t ORDER BY score DESC, path LIMIT 20""", lambda d: rank.ranked(d, pat("token|License"), 20))

_indexes: dict[tuple[str, str], str] = {}


def stored_index(docs: DataFrame, sf_dir: str) -> str:
    """Where the index of a corpus is: built in the shared folder on first use in a session, read from then on."""
    key = (docs.sparkSession.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        place = new_folder(docs.sparkSession)
        index.build(docs, place)
        _indexes[key] = place
    return _indexes[key]


def with_index(name: str, sql: str, plan: Callable[[DataFrame, str], DataFrame]) -> None:
    ORACLE_SQL[name] = sql
    QUERIES[name] = lambda spark, sf_dir: plan(docs := corpus.documents(spark, sf_dir), stored_index(docs, sf_dir))


def later(docs: DataFrame) -> DataFrame:
    """The corpus as it is some time after: texts that have changed, others that have gone."""
    body = F.when(F.expr("doc_id % 50 = 0"), F.concat(F.lit("token of "), "path")).otherwise(F.col("body"))
    return docs.where("doc_id % 70 <> 3").withColumn("body", body)


def amended(docs: DataFrame, place: str) -> DataFrame:
    index.amend(later(docs), place)
    return index.search_indexed(later(docs), index.load(docs.sparkSession, place), TOKEN())


def own_index(docs: DataFrame) -> str:
    place = new_folder(docs.sparkSession)
    index.build(docs, place)
    return place


LATER = f"WITH {L} SELECT path, line_number, line FROM l WHERE doc_id % 70 <> 3 AND doc_id % 50 <> 0 AND {HAS} UNION ALL SELECT path, 1, 'token of ' || path FROM d WHERE doc_id % 50 = 0 AND doc_id % 70 <> 3"
with_index("trigram_prefilter_lines", f"WITH {L} SELECT path, line_number, line FROM l WHERE regexp_matches(line, 'token = \"[0-9a-f]+')", lambda d, place: index.search_indexed(d, index.load(d.sparkSession, place), pat('token = "[0-9a-f]+')))
with_index("stale_index_lines", LATER, lambda d, place: index.search_fresh(later(d), place, TOKEN()))
register("amended_index_lines", LATER, lambda d: amended(d, own_index(d)))

# --- what is around a search: encodings, preprocessors, budgets, codes, cursors

UPPER = "translate(body, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def in_utf16(docs: DataFrame) -> DataFrame:
    """The corpus as bytes with byte-order marks, decoded by them again."""
    content = F.concat(F.unhex(F.lit("FFFE")), F.encode("body", "UTF-16LE"))
    return docs.withColumn("content", content).withColumn("body", corpus.decoded("content", "auto"))


def as_bytes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "path", F.encode("body", "UTF-8").alias("content"))


def as_text(raw: DataFrame) -> DataFrame:
    return raw.withColumn("body", corpus.decoded("content"))


def codes(docs: DataFrame) -> DataFrame:
    rows = [(p, exit_code(SearchRequest(p), docs)) for p in ("token", "zzqqzz", "[abc")]
    return docs.sparkSession.createDataFrame(rows, "pattern string, code int")


def pulled(docs: DataFrame) -> DataFrame:
    """The first 500 paths with a match that a cursor gives, how it ended, and how many a callback took."""
    rows = SearchRequest("token", fixed=True).files(docs).orderBy("path")
    with Cursor(rows, max_results=500) as cursor:
        found = [r.path for r in cursor]
    taken: list[str] = []
    why = push(rows, lambda r: taken.append(r.path) or len(taken) == 10)
    return docs.sparkSession.createDataFrame([(p, cursor.stopped, why, len(taken)) for p in found], "path string, stopped string, pushed string, taken int")


TALLY = f"WITH {L}, t AS (SELECT regexp_extract(path, '(\\.[^./]*)$', 1) AS k, count(*) AS n FROM l WHERE {IS_THE} GROUP BY 1)"


def totals(docs: DataFrame) -> DataFrame:
    t = aggregate.summary(docs, pat("the", word=True), "ext")
    return docs.sparkSession.createDataFrame([(aggregate.total(t), aggregate.get(t, ".fr"), aggregate.get(t, ".none"))], "total long, french long, none long")


register("encoded_lines", f"WITH {L} SELECT path, line_number, line FROM l WHERE {HAS}", lambda d: search.matching_lines(in_utf16(d), TOKEN()))
register("preprocessed_lines", f"WITH {L}, u AS (SELECT path, line_number, {UPPER.replace('body', 'line')} AS line FROM l) SELECT * FROM u WHERE contains(line, 'TOKEN')", lambda d: search.matching_lines(as_text(corpus.transformed(as_bytes(d), bytes.upper)), pat("TOKEN", fixed=True)))
register("compressed_lines", f"WITH {L} SELECT path, line_number, line FROM l WHERE {HAS}", lambda d: search.matching_lines(as_text(corpus.transformed(corpus.transformed(as_bytes(d), gzip.compress), corpus.unpacked)), TOKEN()))
register("binary_scope", f"WITH {D} SELECT path FROM d WHERE doc_id % 3 <> 0", lambda d: SearchRequest("x", skip_binary=True).listing(d.withColumn("body", F.when(F.expr("doc_id % 3 = 0"), F.concat("body", F.lit("\0"))).otherwise(F.col("body")))))
register("unrestricted_scope", f"WITH {D} SELECT path FROM d", lambda d: SearchRequest("x", skip_binary=True, unrestricted=3, ignore_rules=("*.fr",)).listing(d.withColumn("body", F.concat("body", F.lit("\0")))))
register("exit_codes", f"WITH {L} SELECT 'token' AS pattern, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS code FROM l WHERE {HAS} UNION ALL SELECT 'zzqqzz', CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM l WHERE contains(line, 'zzqqzz') UNION ALL SELECT '[abc', 2", codes)
register("output_budget", f"WITH {L}, v AS (SELECT path, line_number, path || ':' || line_number || ':' || line AS value FROM l WHERE {HAS}), b AS (SELECT *, sum(strlen(value) + 1) OVER (ORDER BY path, line_number) AS used FROM v) SELECT path, line_number, value FROM b WHERE used <= 5000", lambda d: search.within_budget(search.matching_lines(d, TOKEN()).select("path", "line_number", F.concat_ws(":", "path", F.col("line_number").cast("string"), "line").alias("value")), 5000))
register("cursor_and_push", f"WITH {L}, f AS (SELECT DISTINCT path FROM l WHERE {HAS}), k AS (SELECT count(*) AS n FROM f) SELECT path, CASE WHEN n > 500 THEN 'max_results' ELSE 'end' END AS stopped, CASE WHEN n >= 10 THEN 'cancelled' ELSE 'end' END AS pushed, CAST(least(n, 10) AS INT) AS taken FROM f, k ORDER BY path LIMIT 500", pulled)
register("tally_totals", f"{TALLY} SELECT CAST(sum(n) AS BIGINT) AS total, coalesce(CAST(sum(n) FILTER (k = '.fr') AS BIGINT), 0) AS french, CAST(0 AS BIGINT) AS \"none\" FROM t", totals)
register("sort_modified", f"WITH {D} SELECT path FROM d", lambda d: search.in_order(d.withColumn("modified", F.timestamp_seconds(F.col("doc_id") % 1000)), "modified", reverse=True).select("path"))
register("max_results", f"WITH {L} SELECT least(count(*), 7) AS n FROM l WHERE {HAS}", lambda d: SearchRequest("token", fixed=True, max_results=7).lines(d).agg(F.count(F.lit(1)).alias("n")))
register("best_lines", f"WITH {L}, h AS (SELECT path, line_number, line, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN regexp_matches(line, '{rank.DECLARES}') THEN 0 ELSE 1 END, line_number) AS r, count(*) OVER (PARTITION BY path) AS n FROM l WHERE {HAS}) SELECT path, line_number, line, n FROM h WHERE r = 1", lambda d: rank.best_lines(search.matching_lines(d, TOKEN())).select("path", "best.line_number", "best.line", F.col("count").alias("n")))
with_index("index_status", f"WITH {TRI} SELECT (SELECT count(*) FROM d) AS files_indexed, count(DISTINCT tri) AS distinct_trigrams, count(*) AS postings, true AS has_bytes FROM t", lambda d, place: index.status(d.sparkSession, place).select("files_indexed", "distinct_trigrams", "postings", (F.col("bytes") > 0).alias("has_bytes")))
