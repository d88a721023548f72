"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import quality_rules as Q
from . import url_filters as U

WS = r"[\x20\x09-\x0D]"
ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')"


def lowered(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup(min_docs: int = 10) -> str:
    return f"""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 k AS (SELECT *, {lowered(f"trim(line, {ENDS})")} AS key FROM l),
 c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs})
 SELECT doc_id, count(*) AS n_lines, count_if(key IN (SELECT key FROM c))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM c)), '')) AS kept_sha256 FROM k GROUP BY doc_id"""


def substring_dedup(length: int = 50) -> str:
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {length - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {length} + 2)) AS i FROM d WHERE len(ws) >= {length})),
 f AS (SELECT g, min(doc_id) AS m FROM p GROUP BY g), gone AS (SELECT doc_id, i FROM p JOIN f USING (g) WHERE m < doc_id),
 cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS i FROM gone),
 w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN cover USING (doc_id, i) GROUP BY doc_id)
 SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for s in Q.STOP_WORDS for w in dict.fromkeys((s, s.capitalize())))
    rules = " AND ".join([f"{r.ratio} >= {r.least}" for r in Q.RULES if r.least > 0] + [f"{r.ratio} <= {r.most}" for r in Q.RULES if r.most != float("inf")])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
 g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
 r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
 b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{WS}+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, len(list_intersect(ws, [{stops}])) AS stop_words, len(list_filter(ls, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•'))) AS bullets, len(list_filter(ls, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS ellipses FROM d LEFT JOIN r USING (doc_id)),
 v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars::DOUBLE / n_words AS mean_word_chars, n_symbols::DOUBLE / n_words AS symbols_per_word, digits::DOUBLE / word_chars AS digits_per_char, n_dup_lines::DOUBLE / n_lines AS dup_line_share, bullets::DOUBLE / n_lines AS bullet_line_share, ellipses::DOUBLE / n_lines AS ellipsis_line_share FROM b)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE {rules} END AS kept FROM v"""


def url_filters() -> str:
    low = lowered("url")
    match = {v: " OR ".join(f"regexp_matches({low}, '{p.regex}')" for p in U.PATTERNS if p.verdict == v) for v in (U.BLOCK, U.ALLOW)}
    ranked = sorted(U.HOST_PATH_RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ranked) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ranked)
    return f"""WITH s AS (SELECT page_id, url, contains(coalesce(url, ''), '://') AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
 h AS (SELECT page_id, url, ok, CASE WHEN ok THEN {lowered("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM s)
 SELECT page_id, host, path, {rule} AS rule, {said} WHEN ok AND ({match[U.BLOCK]}) AND NOT ({match[U.ALLOW]}) THEN 'block' ELSE 'allow' END AS verdict FROM h"""


def collocations(least: int = 30, most: int = 2000) -> str:
    low = lowered("coalesce(text, '')")
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS g, {k} AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM p WHERE len(ws) >= {k})" for k in (1, 2, 3, 4))
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
 p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM d)),
 g AS (SELECT lang, g, k, count(*) AS f FROM ({grams}) GROUP BY lang, g, k), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
 c AS (SELECT lang, g, string_split(g, ' ') AS ws, k, f FROM g WHERE k > 1 AND f >= {least}),
 cuts AS (SELECT lang, g, f, j, array_to_string(ws[:j], ' ') AS lg, array_to_string(ws[j + 1:], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
 s AS (SELECT cuts.lang, cuts.g, cuts.f AS a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * cuts.f) // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts JOIN g x ON x.lang = cuts.lang AND x.g = lg JOIN g y ON y.lang = cuts.lang AND y.g = rg),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
 w AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS sub FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))) GROUP BY lang, sub),
 t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM b LEFT JOIN w ON w.lang = b.lang AND w.sub = b.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
 SELECT t.lang, rank, t.g AS phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= {most}"""


def warc(least: int = 1000) -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= {least} GROUP BY d)
 SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM p LEFT JOIN k USING (d)"""


ORACLE_SQL = {"op4_line_dedup": line_dedup(), "op8_url_filters": url_filters(), "op9_quality_rules": quality_rules(), "op10_substring_dedup": substring_dedup(), "op12_collocations": collocations(), "op13_warc": warc()}
