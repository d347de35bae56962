"""SQL (DuckDB's) for the queries that SQL can say, over the whole tables."""

from __future__ import annotations

from .quality_rules import ACCURACY, FENCES, LEAST_DOCS
from .secrets import ENTROPY, WIDE_OWNERS, WIDE_REPOS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], chr(1))) AS least FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win, range(13) t(k) WHERE least < doc_id),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

RATIOS = {
    "symbol_ratio": "n_symbols / words", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_ratio": "n_repeat_words / words",
    "upper_ratio": "n_upper / chars", "punct_ratio": "n_punct / chars", "mean_word": "word_chars / words",
}
GAMMA = f"((1 + {ACCURACY}::DOUBLE) / (1 - {ACCURACY}::DOUBLE))"


def _op5() -> str:
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {v} AS value FROM r WHERE NOT base_failed" for k, v in RATIOS.items())

    def level(name: str, keys: str) -> str:
        by, part = f"{keys}, " if keys else "", f"{keys}, feature" if keys else "feature"
        at = ", ".join(f"min(v) FILTER (WHERE upto >= ceil(docs * {q}::DOUBLE)) AS q{k}" for k, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
        return f"""{name} AS (SELECT {by}feature, max(docs) AS docs, {at} FROM (SELECT {by}feature, CASE WHEN bucket = -2147483648 THEN 0 ELSE 2 * pow({GAMMA}, bucket) / ({GAMMA} + 1) END AS v,
  sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS docs FROM (SELECT {by}feature, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"""

    q = ", ".join(f"CASE WHEN o.docs >= {LEAST_DOCS} THEN o.q{k} WHEN l.docs >= {LEAST_DOCS} THEN l.q{k} ELSE a.q{k} END AS q{k}" for k in (1, 2, 3))
    hi = ", ".join(f"max(q2 + greatest({width}::DOUBLE * (q3 - q2), {least}::DOUBLE)) FILTER (WHERE feature = '{k}') AS hi_{k}" for k, (width, least) in FENCES.items())
    lo = f"max(q2 - greatest({FENCES['mean_word'][0]}::DOUBLE * (q2 - q1), {FENCES['mean_word'][1]}::DOUBLE)) FILTER (WHERE feature = 'mean_word') AS lo_mean_word"
    broken = ", ".join([*(f"CASE WHEN {RATIOS[k]} > hi_{k} THEN '{k}' END" for k in FENCES), f"CASE WHEN {RATIOS['mean_word']} < lo_mean_word THEN 'mean_word' END"])
    return rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 2], chr(1))) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(3) x(k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS n_punct FROM t),
r AS (SELECT f.*, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, greatest(n_words, 1)::DOUBLE AS words, greatest(word_chars, 1)::DOUBLE AS chars,
  n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed FROM f LEFT JOIN rep USING (doc_id)),
sk AS (SELECT lang, source, feature, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / ln({GAMMA})) AS INT) ELSE -2147483648 END AS bucket, count(*) AS n FROM ({pairs}) GROUP BY ALL),
{level("own", "lang, source")}, {level("of_lang", "lang")}, {level("of_all", "")},
q AS (SELECT o.lang, o.source, o.feature, {q} FROM own o JOIN of_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.feature = o.feature JOIN of_all a ON a.feature = o.feature),
fence AS (SELECT lang, source, {hi}, {lo} FROM q GROUP BY ALL),
j AS (SELECT r.*, CASE WHEN base_failed THEN 'base' ELSE concat_ws(',', {broken}) END AS failed_rules FROM r LEFT JOIN fence g ON g.lang IS NOT DISTINCT FROM r.lang AND g.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j"""


def _spans(name: str, kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: places follow from the lengths of what stands between matches."""
    return f"""{name} AS (SELECT doc_id, {number} AS k, '{kind}' AS kind, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, ms[i] AS m, vs[i] AS v
  FROM (SELECT doc_id, ms, vs, parts, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS parts FROM t)) WHERE length(vs[i]) >= {least})"""


def _op7() -> str:
    assign = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    told = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans("s0", "assign", 0, assign, 2, 8)}, {_spans("s1", "access", 1, "AKIA[A-Z0-9]+", 0, 16)}, {_spans("s2", "hex", 2, "[0-9a-f]+", 0, 32)}, {_spans("g", "generic", 3, "[A-Za-z0-9+/_-]+", 0, 24)},
base AS (SELECT *, a + length(m) AS e FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
gen AS (SELECT *, a + length(m) AS e FROM g WHERE regexp_matches(v, '[0-9]') AND lower(v) <> v AND upper(v) <> v),
alone AS (SELECT * FROM gen ANTI JOIN base ON gen.doc_id = base.doc_id AND base.a < gen.e AND gen.a < base.e),
every AS (SELECT * FROM base UNION ALL SELECT * FROM alone),
en AS (SELECT v, -sum(c / n * log2(c / n)) AS h FROM (SELECT v, x, count(*)::DOUBLE AS c, any_value(length(v))::DOUBLE AS n FROM (SELECT v, unnest(string_split(v, '')) AS x FROM (SELECT DISTINCT v FROM every)) GROUP BY v, x) GROUP BY v),
cand AS (SELECT every.*, h >= {ENTROPY} AND regexp_matches(v, '[0-9]') AS random FROM every JOIN en USING (v) WHERE k < 3 OR h >= {ENTROPY} + 0.5),
held AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || source, '') || chr(1) || concat_ws('/', source, lang)) AS repos FROM cand JOIN documents USING (doc_id) GROUP BY v),
j AS (SELECT cand.*, owners, repos, owners >= {WIDE_OWNERS} OR (owners >= 2 AND repos >= {WIDE_REPOS}) AS wide FROM cand JOIN held USING (v)),
b AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg({told}, ',' ORDER BY a, k) AS told FROM base GROUP BY doc_id),
o AS (SELECT doc_id, string_agg({told}, ',' ORDER BY a, k) AS spans, count(*) FILTER (WHERE random AND NOT wide) AS n_live, count(*) FILTER (WHERE wide) AS n_example, string_agg({told}, ',' ORDER BY a, k) FILTER (WHERE random AND NOT wide) AS live,
  max(owners) AS most_owners, max(repos) AS most_repos FROM j WHERE k < 3 OR NOT wide GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example, coalesce(live, '') AS live, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos FROM t LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)"""


OP8 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, chr(1))] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], chr(1))) END)) AS sh FROM w),
d AS (SELECT doc_id, len(sh) AS n, sh, min(doc_id) OVER (PARTITION BY sh) AS rep FROM s),
c AS (SELECT rep, n, unnest(sh) AS x FROM d WHERE doc_id = rep AND n > 0),
e AS (SELECT a.rep AS p, b.rep AS q FROM c a JOIN c b ON a.x = b.x AND a.rep <> b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(node, least) AS (SELECT rep, rep FROM d WHERE doc_id = rep AND n > 0 UNION SELECT e.q, r.least FROM r JOIN e ON e.p = r.node),
m AS (SELECT node, min(least) AS component FROM r GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component END AS component_id, n = 0 OR doc_id = component AS kept FROM d LEFT JOIN m ON node = rep"""

SQL = {"op2_substring_dedup": OP2, "op5_quality_rules": _op5(), "op7_secret_scan": _op7(), "op8_near_duplicates": OP8}
