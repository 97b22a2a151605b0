"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Words as op5 counts them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op5_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p+19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS p FROM d)),
late AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (
  SELECT word.doc_id, coalesce(string_agg(x, ' ' ORDER BY q) FILTER (WHERE gone.q IS NULL), '') AS t,
         count(gone.q) AS n_removed
  FROM word LEFT JOIN gone USING (doc_id, q) GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
edge AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings
  UNION
  SELECT reach.u, edge.w FROM reach JOIN edge ON reach.w = edge.u),
part AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM edge GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN part ON vec_id = part.u LEFT JOIN n ON vec_id = n.u
"""


def _level(depth: int, source: str) -> str:
    """One level of op1's tree: nodes with budget, shared among the children of each parent."""
    keys = ["domain", "lang", "source"][: depth + 1]
    own, over = ", ".join(keys), ", ".join(keys[:-1]) or "1"
    weight = {
        "domain": "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 1 END",
        "source": "CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END",
    }[keys[-1]]
    join = f"JOIN {source} p USING ({', '.join(keys[:-1])})" if depth else f"CROSS JOIN {source} p"
    return f"""
n{depth} AS (SELECT {own}, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * 2 AS cap, {weight} AS w FROM leaf GROUP BY {own}),
o{depth} AS (
  SELECT n{depth}.*, p.budget AS b,
    coalesce(sum(cap) OVER (PARTITION BY {over} ORDER BY cap / w, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (PARTITION BY {over} ORDER BY cap / w, {keys[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM n{depth} {join}),
f{depth} AS (SELECT *, (b - before) * w >= cap * onward AS is_full FROM o{depth}),
l{depth} AS (
  SELECT {own}, tokens, CASE WHEN is_full THEN cap
    ELSE ((b - coalesce(sum(cap) FILTER (WHERE is_full) OVER (PARTITION BY {over}), 0)) * w)
         // (sum(w) FILTER (WHERE NOT is_full) OVER (PARTITION BY {over})) END::HUGEINT AS budget
  FROM f{depth})"""


ORACLES["op1_source_mixing"] = f"""
WITH base AS (
  SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '(\\d+)$', 1), '') AS INTEGER) % 4), 'none') AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, len({_WORDS})::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM base GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * 0.6::DOUBLE)::HUGEINT AS budget FROM leaf),
{_level(0, 'root')},
{_level(1, 'l0')},
{_level(2, 'l1')},
keyed AS (
  SELECT base.*, (q.budget // q.tokens)::BIGINT AS whole, q.budget % q.tokens AS rest,
    ('0x' || substr(md5('17:' || (q.budget // q.tokens)::BIGINT || ':' || doc_id), 1, 15))::BIGINT AS k
  FROM base JOIN l2 q USING (domain, lang, source) WHERE q.tokens > 0),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS total FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, whole + (total <= rest)::BIGINT AS copies
FROM summed WHERE whole + (total <= rest)::BIGINT > 0
"""


def _code_rounds(rounds: int) -> str:
    """Assignments a0.. and codebooks b1.. of op11, one after the other."""
    assign = """
a{n} AS MATERIALIZED (
  SELECT vec_id, p, k, d FROM (
    SELECT x.vec_id, x.p, b.k, x.n2 - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS d FROM x JOIN b{n} b USING (p))
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)"""
    update = """
m{n} AS (
  SELECT p, k, list(m ORDER BY i) AS v FROM (
    SELECT p, k, i, floor(sum(v[i]) / count(*)) AS m FROM a{m} JOIN x USING (vec_id, p), range(1, (SELECT max(len(v)) FROM x) + 1) t(i) GROUP BY p, k, i)
  GROUP BY p, k),
b{n} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM b{m} b LEFT JOIN m{n} m USING (p, k))"""
    return ",".join(assign.format(n=n) + ("," + update.format(n=n + 1, m=n) if n < rounds else "") for n in range(rounds + 1))


ORACLES["op11_code_compression"] = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * e::DOUBLE) for e in embedding] AS e, len(embedding) // 8 AS l FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([e for e in embedding if e IS NULL OR isnan(e) OR isinf(e)]) = 0),
x AS MATERIALIZED (
  SELECT vec_id, p, v, list_inner_product(v, v) AS n2
  FROM (SELECT vec_id, p, e[(p * l + 1):(p * l + l)] AS v FROM kept, range(8) t(p))),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v
  FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),{_code_rounds(6)},
coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string([y::BIGINT for y in v], ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


def _edit_options() -> str:
    """op13: the cheapest (cost, audit, text) of the four states after one more row x, from those in s0 to s3 before it."""
    put_in = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    options: dict[int, list[str]] = {e: [] for e in range(4)}
    for start in range(4):
        now, lines = start, ""
        for n in range(3):
            def option(end, letter, cost, line, when):
                options[end].append(f"CASE WHEN {when} THEN {{'c': s{start}.c + {cost}, 'a': s{start}.a || '{'I' * n + letter}', 't': s{start}.t || '{lines}' || {line}}} END")

            option(now, "D", f"{3 + 2 * n}", "''", "true")
            option(put_in[now], "R", f"{2 + 2 * n} + x.late", f"chr(10) || '{names[put_in[now]]}:' || x.text", "NOT x.gone")
            for (state, initial), end in kept.items():
                if state == now:
                    option(end, "K", f"{2 * n} + x.late", "chr(10) || x.role || ':' || x.text", f"NOT x.gone AND left(x.role, 1) = '{initial}'")
            now = put_in[now]
            lines += f"\n{names[now]}:"
    return ", ".join(f"list_min([{', '.join(options[e])}]) AS s{e}" for e in range(4))


ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair
  FROM placed),
x AS MATERIALIZED (SELECT g, i, role, text, blank OR again AS gone, cut::INT AS late FROM seen),
faults AS (
  SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS n
  FROM seen GROUP BY g),
fold AS (
  SELECT DISTINCT g, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 1000000, 'a': '', 't': ''}} AS s1,
    {{'c': 1000000, 'a': '', 't': ''}} AS s2, {{'c': 1000000, 'a': '', 't': ''}} AS s3 FROM x
  UNION ALL
  SELECT g, x.i, {_edit_options()} FROM fold JOIN x USING (g) WHERE x.i = fold.i + 1),
done AS (
  SELECT g, list_min([s0, {{'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}}, s3]) AS best
  FROM fold JOIN faults USING (g) WHERE i = n),
found AS (SELECT * FROM faults JOIN done USING (g))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found ON c.conv_id IS NOT DISTINCT FROM found.conv_id
"""
