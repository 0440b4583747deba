"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from lexmill.llm.mixing import Plan


def mixing_sql(plan: Plan) -> str:
    def weight(names, column: str) -> str:
        arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items())
        return f"CASE {column} {arms} ELSE {plan.other} END" if arms else str(plan.other)

    def level(out: str, nodes: str, parent: str, w: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
{out}_w AS (SELECT *, {w} AS w FROM ({nodes})),
{out}_s AS (SELECT *, sum(cap) OVER ({by} ORDER BY cap / w) AS cap_to, sum(w) OVER ({by} ORDER BY cap / w) AS w_to, sum(w) OVER ({by}) AS w_all FROM {out}_w),
{out}_f AS (SELECT *, cap_to * w + cap * (w_all - w_to) <= budget * w AS is_full FROM {out}_s),
{out}_t AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0) AS cap_full, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({by}), 0) AS w_open FROM {out}_f),
{out} AS (SELECT * EXCLUDE (w, cap_to, w_to, w_all, is_full, cap_full, w_open, budget), CASE WHEN is_full THEN cap ELSE least(cap, ((budget - cap_full) * w) // w_open) END AS share FROM {out}_t)"""

    return f"""
WITH d AS (
  SELECT doc_id, coalesce('d' || CAST(CAST(floor(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) / 5) AS BIGINT) AS VARCHAR), '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {plan.max_epochs} AS BIGINT) AS cap FROM d
  WHERE {weight(plan.domains, "domain")} > 0 AND {weight(plan.languages, "lang")} > 0 AND {weight(plan.sources, "source")} > 0 GROUP BY ALL HAVING sum(n_tokens) > 0),
{level("l1", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(floor(sum(n_tokens) * {plan.budget_percent} / 100) AS BIGINT) FROM d) AS budget FROM leaf GROUP BY domain", "", weight(plan.domains, "domain"))},
{level("l2", "SELECT n.*, p.share AS budget FROM (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL) n JOIN l1 p USING (domain)", "domain", weight(plan.languages, "lang"))},
{level("l3", "SELECT n.*, p.share AS budget FROM leaf n JOIN l2 p USING (domain, lang)", "domain, lang", weight(plan.sources, "source"))},
e AS (SELECT d.*, md5('{plan.seed}:' || CAST(coalesce(l3.share // l3.tokens, 0) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM d LEFT JOIN l3 USING (domain, lang, source)),
c AS (SELECT e.*, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM e)
SELECT doc_id, c.domain, c.lang, c.source, n_tokens,
  CAST(CASE WHEN l3.share IS NULL THEN 0 ELSE l3.share // l3.tokens + CASE WHEN l3.share % l3.tokens > 0 AND upto <= l3.share % l3.tokens THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM c LEFT JOIN l3 ON c.domain = l3.domain AND c.lang = l3.lang AND c.source = l3.source"""


#: A recursion over the turns, whose walks carry the repaired rows; CRC-32 is taken by half bytes.
REPAIR_SQL = """
WITH RECURSIVE nibble AS (
  SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (
  SELECT n.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(k) + 1), lambda i: CAST(ord(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: xor(xor(xor(c, b) >> 4, t[CAST(xor(c, b) & 15 AS INTEGER) + 1]) >> 4, t[CAST(xor(xor(c, b) >> 4, t[CAST(xor(c, b) & 15 AS INTEGER) + 1]) & 15 AS INTEGER) + 1])), 4294967295) % 20 AS draw
  FROM named n, nibble),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE draw WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS nth FROM drawn)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed),
turns AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM turns GROUP BY conv_id),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a rerole or an insertion takes the role that the state asks for
asks(state, role, after) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
inserts AS (
  SELECT state AS a, state AS b, 0 AS cost, '' AS letters, CAST([] AS VARCHAR[]) AS made FROM asks
  UNION ALL SELECT state, after, 5, 'I', [role || ':'] FROM asks
  UNION ALL SELECT x.state, y.after, 10, 'II', [x.role || ':', y.role || ':'] FROM asks x JOIN asks y ON y.state = x.after),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, b AS state, {'cost': cost, 'audit': letters, 'made': made} AS best FROM (SELECT DISTINCT conv_id FROM conversations) c, inserts WHERE a = 0
  UNION ALL
  SELECT conv_id, place, state, min(best) FROM (
    SELECT w.conv_id, t.place, i.b AS state, {
      'cost': w.best.cost + e.cost + i.cost + CASE WHEN e.letter <> 'D' AND t.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': w.best.audit || e.letter || i.letters,
      'made': list_concat(w.best.made, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [e.role || ':' || t.text] END, i.made)} AS best
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.place = w.place + 1
    JOIN (SELECT state, 'D' AS letter, '' AS role, 2 AS cost, state AS after FROM asks UNION ALL SELECT state, 'R', role, 1, after FROM asks UNION ALL SELECT state, 'K', role, 0, after FROM asks UNION ALL SELECT 0, 'K', 's', 0, 1) e
      ON e.state = w.state AND (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR left(e.role, 1) = t.initial)
    JOIN inserts i ON i.a = e.after)
  GROUP BY conv_id, place, state),
ended AS (
  SELECT w.conv_id, min(w.best) AS best FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.state IN (0, 3) AND w.place = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit, sha256(array_to_string(e.best.made, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
