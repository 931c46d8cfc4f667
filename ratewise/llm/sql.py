"""DuckDB SQL for the queries that SQL can express on whole tables.

Not here, and tested against brute force instead: private spans (a trained classifier),
packing (a tokenizer), mixing (a hash order), language-model scores, the quality and
language models.
"""

from __future__ import annotations

from ratewise.llm import rules

OP6 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""

_STATISTICS = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
st AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
              length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
              len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
       FROM w LEFT JOIN cov USING (rid)),
sb AS (SELECT *, n_words < {least} OR 100 * n_repeat_words > {most} * n_words AS base_failed,
              10000 * n_symbols // greatest(word_chars, 1) AS symbols, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
              10000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM st)"""

# A sketch is a table of counts by bucket; its quantiles are read from running sums.
_SKETCH = """
v AS (SELECT lang, source, rule, val, greatest(length(bin(val)) - 6, 0) AS cut
      FROM (UNPIVOT (SELECT lang, source, base_failed, symbols, dup_lines, repeats FROM sb) ON symbols, dup_lines, repeats INTO NAME rule VALUE val)
      WHERE NOT base_failed),
sk AS (SELECT lang, source, rule, (val >> cut) + cut * 64 AS b, count(*) AS n FROM v GROUP BY ALL)"""


def _quantiles(name: str, keys: str) -> str:
    by = f"{keys}, rule" if keys else "rule"
    low = "CAST(b - c * 64 AS BIGINT) << c"
    share = "CASE rule " + " ".join(f"WHEN '{r}' THEN {p}" for r, p in rules.UPPER.items()) + " END"
    return f"""
{name}_m AS (SELECT {by}, b, CAST(greatest(floor((b - 32) / 64), 0) AS BIGINT) AS c, sum(n) AS n FROM sk GROUP BY ALL),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS up, sum(n) OVER (PARTITION BY {by}) AS total FROM {name}_m),
{name} AS (SELECT {by}, max(total) AS n, min({low}) FILTER (WHERE up * 100 >= total * 50) AS p50,
                  min({low}) FILTER (WHERE up * 100 >= total * ({share})) AS upper FROM {name}_u GROUP BY {by})"""


def _op2() -> str:
    best = lambda x: f"CASE WHEN o.n >= {rules.SUPPORT} THEN o.{x} WHEN l.n >= {rules.SUPPORT} THEN l.{x} ELSE a.{x} END"
    floor = "CASE o.rule " + " ".join(f"WHEN '{r}' THEN {s}" for r, s in rules.FLOOR.items()) + " END"
    tests = " AND ".join(f"coalesce({r} <= f_{r}, TRUE)" for r in rules.FLOOR)
    return "WITH " + ",".join([
        _STATISTICS.replace("{least}", str(rules.LEAST_WORDS)).replace("{most}", str(rules.MOST_REPEATED)), _SKETCH,
        _quantiles("own", "lang, source"), _quantiles("bylang", "lang"), _quantiles("everything", ""), f"""
top AS (SELECT o.lang, o.source, o.rule, {best('p50')} + {rules.SPREADS} * greatest({best('upper')} - {best('p50')}, {floor}) AS top
        FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN everything a ON o.rule = a.rule),
fence AS (SELECT lang, source, {', '.join(f"max(top) FILTER (WHERE rule = '{r}') AS f_{r}" for r in rules.FLOOR)} FROM top GROUP BY lang, source)"""]) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept
FROM sb LEFT JOIN fence f ON sb.lang IS NOT DISTINCT FROM f.lang AND sb.source IS NOT DISTINCT FROM f.source"""


OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\]|NAME\]|\\)', '\1\\\2', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 24 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL)
          JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.x),
comp AS (SELECT x, min(root) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON comp.x = doc_id"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                       '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(ps) AS p FROM d)),
g AS (SELECT lang, ws[i:i + k - 1] AS ws, k FROM w, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
f AS MATERIALIZED (SELECT lang, array_to_string(ws, ' ') AS phrase, k, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
many AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE a >= 10),
parts AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(ws[:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail
                       FROM (SELECT *, unnest(range(1, k)) AS j FROM many WHERE k > 1)),
heads AS MATERIALIZED (SELECT p.*, x.a AS l FROM parts p JOIN many x ON x.lang = p.lang AND x.phrase = p.head),
cuts AS (SELECT p.*, y.a AS r, 1000000 * p.a * p.a // (p.l * y.a) AS score FROM heads p JOIN many y ON y.lang = p.lang AND y.phrase = p.tail),
c AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, part AS phrase, max(a) AS most FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM many WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * c.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM l GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(max(s.n), 0)::HUGEINT AS n
      FROM d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2)::HUGEINT // (g.n + 2 * v.v) AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(max(s.value), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT y.lang, y.source, z.source AS item, sum((y.p - z.p) * (y.p - z.p) // (y.p + z.p)) AS value
                    FROM x y JOIN x z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000 * (l.c + 2) // (v.n + 2 * v.v) AS q FROM l JOIN v USING (lang)),
term AS (SELECT x.lang, x.source, x.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
         FROM x JOIN q USING (lang, term) WHERE c > 0 AND p > q),
joined AS (SELECT *, 'pair' AS part FROM pair UNION ALL BY NAME SELECT *, 'term' AS part FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM joined)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLE: dict[str, str] = {
    "op2_adaptive_rules": _op2(),
    "op3_chat_round_trip": OP3,
    "op6_exact_dedup": OP6,
    "op8_minhash_near_dedup": OP8,
    "op11_phrase_mining": OP11,
    "op13_source_divergence": OP13,
}
