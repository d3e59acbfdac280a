"""SQL of the iterative corpus operators, written out as one statement each."""

from __future__ import annotations


def kmeans_sql(k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> str:
    """The rounds one after another; sums and squares in HUGEINT are exact."""
    nearest = (
        "SELECT vec_id, x, c.cluster, list_sum(list_transform(generate_series(1, {w}), lambda i: (x[i] - c.c[i])::HUGEINT * (x[i] - c.c[i])::HUGEINT)) AS d "
        "FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c.cluster) = 1"
    )
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings "
        f"WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {width})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS cluster, x AS c FROM (SELECT x, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, x LIMIT {k})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest.format(w=width, r=r)})",
            f"m{r} AS (SELECT cluster, i, sum(e::HUGEINT)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL)",
            f"n{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (cluster))",
        ]
    steps.append(f"a{rounds} AS MATERIALIZED ({nearest.format(w=width, r=rounds)})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    )


def _add(value: str, cost: str, letter: str) -> str:
    """A value is the cost in nine digits and the audit, so that the least string is the least pair; ``~`` is unreachable."""
    return f"CASE WHEN {value} = '~' THEN '~' ELSE printf('%09d', left({value}, 9)::INT + {cost}) || substr({value}, 10) || '{letter}' END"


def _closed(table: str) -> str:
    """Insertions from the four positions before the next message."""
    u = f"least(u, {_add('s0', '3', 'I')}, {_add('s1', '3', 'I')}, {_add('a', '3', 'I')})"
    return f"(SELECT conv, nth, s0, s1, u, least(a, {_add('u', '3', 'I')}) AS a FROM (SELECT conv, nth, s0, s1, {u} AS u, a FROM {table}))"


_EXTRA = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"


def _step(before: list[str], initial: str, rerole: bool) -> str:
    """Least value of keeping or reroling a message after one of the positions ``before``."""
    ways = [f"CASE WHEN initial = '{initial}' THEN {_add(b, _EXTRA, 'K')} ELSE '~' END" for b in before]
    ways += [_add(b, f"3 + {_EXTRA}", "R") for b in before if rerole]
    return f"CASE WHEN fault IN ('b', 'd') THEN '~' ELSE least({', '.join(ways)}) END" if len(ways) > 1 else f"CASE WHEN fault IN ('b', 'd') THEN '~' ELSE {ways[0]} END"


#: Left to right over the messages instead of by spans: the grammar's strings are regular.
REPAIR_SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
z AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS m FROM k),
h AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE m <> 0),
n AS (SELECT *, coalesce(conv_id::VARCHAR, 'null') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nth,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM h),
o AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM n),
p AS (SELECT DISTINCT conv, 0::BIGINT AS nth, '000000000' AS s0, '~' AS s1, '~' AS u, '~' AS a FROM o
  UNION ALL SELECT c.conv, o.nth, {_add('s0', '4', 'D')}, least({_add('s1', '4', 'D')}, {_step(['s0'], 's', False)}),
    least({_add('u', '4', 'D')}, {_step(['s0', 's1', 'a'], 'u', True)}), least({_add('a', '4', 'D')}, {_step(['u'], 'a', True)})
  FROM {_closed('p')} c JOIN o ON o.conv = c.conv AND o.nth = c.nth + 1),
w AS (SELECT conv, left(v, 9)::BIGINT AS cost, substr(v, 10) AS audit FROM
    (SELECT conv, least(s0, a) AS v FROM {_closed('p')} QUALIFY nth = max(nth) OVER (PARTITION BY conv))),
r AS (SELECT conv, audit, 0::BIGINT AS i, 0::BIGINT AS nth, '^' AS pos, NULL::VARCHAR AS out FROM w
  UNION ALL SELECT r.conv, r.audit, i + 1, r.nth + (e <> 'I')::INT, CASE WHEN e = 'D' THEN pos WHEN e = 'K' THEN o.initial WHEN pos = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN e = 'D' THEN out ELSE concat_ws(chr(10), out, CASE WHEN e = 'K' THEN o.role WHEN pos = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE o.text END) END
  FROM (SELECT *, substr(audit, i::INT + 1, 1) AS e FROM r WHERE i < length(audit)) r LEFT JOIN o ON o.conv = r.conv AND o.nth = r.nth + 1 AND r.e <> 'I'),
s AS (SELECT conv, sha256(coalesce(out, '')) AS repaired_sha256 FROM r WHERE i = length(audit)),
c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY nth) || initial AS pair FROM o) GROUP BY conv)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS conv FROM conversations) d LEFT JOIN c USING (conv) LEFT JOIN w USING (conv) LEFT JOIN s USING (conv)
"""
