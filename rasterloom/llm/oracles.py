"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_ODD = "</s>[INST] ok [/INST]"
_ESC = "replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2')"
CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_ODD}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD}'
), o AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('text')}) + CASE WHEN rn = 1 OR prev <> role THEN 8 + length(replace({_ESC.format('role')}, chr(10), '~3')) ELSE 3 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def urls(rules: list[tuple[str, str]], terms: tuple[str, ...], least: int = 5, z: float = 1.96, smoothing: float = 4.0, prior: float = 0.1, reject: float = 0.5) -> str:
    """The URL filter by its definition: every page looks at all pages of its host through windows, position by position."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def chain(value) -> str:
        out = []
        for said, text in ordered:
            name, slash, rest = text.partition("/")
            out.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash + rest}') THEN '{value(said, text)}'")
        return "CASE " + " ".join(out) + " END"

    seeded = " OR ".join(f"contains(host, '{t}')" for t in terms)
    sql = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {chain(lambda s, t: t)} AS rule, {chain(lambda s, t: s)} AS said,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+([._-][A-Za-z0-9]*)?$|^[0-9a-fA-F-]{{8,}}$|[0-9]{{3,}}') THEN '*' ELSE x END) AS segs FROM h),
x0 AS (SELECT *, CASE WHEN said = 'block' OR (said IS NULL AND ({seeded})) THEN 1 WHEN said = 'allow' THEN 0 END AS bad,
  coalesce(segs[1], '') AS s0, coalesce(segs[2], '') AS s1, coalesce(array_to_string(segs[3:], '/'), '') AS s2 FROM r)"""
    above = "host"
    for k in range(3):
        # of: labelled and bad pages of the branch (a) and of its siblings (b)
        sql += f""",
c{k} AS (SELECT *, count(*) OVER w AS seen, count(bad) OVER w AS la, coalesce(sum(bad) OVER w, 0) AS ba, count(bad) OVER p - count(bad) OVER w AS lb, coalesce(sum(bad) OVER p, 0) - coalesce(sum(bad) OVER w, 0) AS bb
  FROM x{k} WINDOW w AS (PARTITION BY {above}, s{k}), p AS (PARTITION BY {above})),
d{k} AS (SELECT *, (ba + bb + 1) / (la + lb + 2) AS pool FROM c{k}),
x{k + 1} AS (SELECT * EXCLUDE (seen, la, ba, lb, bb, pool), CASE
  WHEN s{k} = '' THEN ''
  WHEN la = 0 AND seen >= {least} AND s{k} <> '*' THEN s{k}
  WHEN la = 0 AND lb > 0 THEN '?'
  WHEN la = 0 THEN '*'
  WHEN lb = 0 THEN s{k}
  WHEN seen >= {least} AND abs(ba / la - bb / lb) >= {z} * sqrt(pool * (1 - pool) * (1 / la + 1 / lb)) THEN s{k}
  ELSE '*' END AS t{k} FROM d{k})"""
        above += f", t{k}"
    template = " || ".join(["host", *(f"CASE WHEN t{k} = '' THEN '' ELSE '/' || t{k} END" for k in range(3))])
    return (
        sql
        + f""",
tt AS (SELECT *, {template} AS template FROM x3),
j AS (SELECT *, count(bad) OVER t AS tl, (coalesce(sum(bad) OVER t, 0) + {smoothing} * (coalesce(sum(bad) OVER o, 0) + {smoothing} * {prior}) / (count(bad) OVER o + {smoothing})) / (count(bad) OVER t + {smoothing}) AS purity
  FROM tt WINDOW t AS (PARTITION BY host, template), o AS (PARTITION BY host))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN tl > 0 AND purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity FROM j"""
    )
