"""SQL for DuckDB of the numbered operators that SQL can express; tests/llm hold the others against brute force."""

from __future__ import annotations

from .license_scan import TEMPLATES
from .quality_rules import BASE, RULES, STOP_WORDS, SYMBOLS, WINDOW
from .warc_zstd import LEAST_BYTES


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_text(x) for x in xs) + "]"


def op1_sql() -> str:
    texts = ", ".join(f"({_text(k)}, {_text(t)})" for k, t in TEMPLATES.items())
    return rf"""WITH tm(id, text) AS (VALUES {texts}),
    tw AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM tm),
    tb AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM tw)),
    ts AS (SELECT id, len(w) AS words, (SELECT count(*) FROM tb WHERE tb.id = tw.id) AS n FROM tw),
    d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
    g AS (SELECT rid, doc_id, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)),
    h AS (SELECT rid, id, i, g FROM g JOIN tb USING (g)),
    c AS (SELECT rid, id, words, n FROM h JOIN ts USING (id) GROUP BY ALL HAVING 2.0 * count(DISTINCT g) / (count(DISTINCT g) + n) >= 0.8),
    s AS (SELECT DISTINCT rid, id, words, n, unnest(range(greatest(1, i - words + 2), i + 1)) AS i FROM h JOIN c USING (rid, id)),
    x AS (SELECT s.rid, s.id, s.i, any_value(doc_id) AS doc_id, 2.0 * count(DISTINCT tb.g) / (count(DISTINCT g.g) + any_value(n)) AS dice
      FROM s JOIN g ON g.rid = s.rid AND g.i BETWEEN s.i AND s.i + words - 2 LEFT JOIN tb ON tb.id = s.id AND tb.g = g.g GROUP BY 1, 2, 3)
    SELECT doc_id, id AS license_id, round(max(dice), 6) AS dice, count(*) AS n_windows FROM x WHERE dice >= 0.8 GROUP BY 1, 2"""


def op3_sql() -> str:
    return """WITH t AS (SELECT conv_id, turn, CAST(floor(turn / 64.0) AS BIGINT) AS part, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
    p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, text) - 1) // 64 AS piece FROM t),
    who AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
    m AS (SELECT p.*, speaker, role = speaker AS own, text || '<|end|>' || chr(10) AS body,
      CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head FROM p JOIN who ON conv_id IS NOT DISTINCT FROM c),
    o AS (SELECT *, CAST(coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY part NULLS FIRST, piece, turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM m),
    x AS (SELECT *, min(b) OVER (PARTITION BY conv_id, speaker, part, piece) AS start FROM o)
    SELECT conv_id, speaker, part, piece, any_value(start) AS "at", count(*) AS n_turns, count_if(own) AS n_assistant_turns, string_agg(head || body, '' ORDER BY turn, role, text) AS dialogue,
      coalesce(string_agg((b - start + length(head)) || ':' || (b - start + length(head) + length(body)), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask_spans FROM x GROUP BY 1, 2, 3, 4"""


def op7_sql() -> str:
    fails = {}
    for r in RULES:
        m = "100 * n_repeat_words > 20 * n_words" if r.metric == "repeat_word_ratio" else " OR ".join([f"{r.metric} < {r.least}"] * (r.least is not None) + [f"{r.metric} > {r.most}"] * (r.most is not None))
        fails[r.name] = f"(({m}) AND n_words >= {r.from_words})"
    ratio = lambda a, b, name: f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0) AS {name}"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY 1),
    m AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains({_list(STOP_WORDS)}, lower(rtrim(x, '.,;:!?'))))) AS stops, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS bullets,
      len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS ell FROM w LEFT JOIN rep USING (rid)),
    r AS (SELECT *, coalesce(chars, 0) AS word_chars, {ratio('coalesce(chars, 0)', 'n_words', 'mean_word_chars')}, {ratio('n_symbols', 'n_words', 'symbol_ratio')}, {ratio('stops', 'n_words', 'stop_word_ratio')},
      {ratio('n_dup_lines', 'lines', 'dup_line_ratio')}, {ratio('bullets', 'lines', 'bullet_ratio')}, {ratio('ell', 'lines', 'ellipsis_ratio')} FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(fails[k] for k in BASE)} AS base_failed, NOT ({' OR '.join(fails.values())}) AS kept FROM r"""


def op10_sql() -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, CASE WHEN strlen(h) >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p),
    r AS (SELECT *, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f)
    SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, CAST(NULL AS VARCHAR) AS error FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": op1_sql(), "op3_chat_rotation": op3_sql(), "op7_quality_rules": op7_sql(), "op10_warc": op10_sql()}
