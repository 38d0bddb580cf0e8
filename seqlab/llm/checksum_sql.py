"""SQL pieces for the oracles of this subpackage: checksums and trees that DuckDB has no function for."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, null for null."""
    shift = "xor(x >> 1, (x & 1) * 3988292384)"
    eight = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: cast(ascii(ch) AS bigint))"
    return f"xor(list_reduce(list_concat([cast(4294967295 AS bigint)], {codes}), lambda c, b: {eight}), 4294967295)"


def field_sql(value: str) -> str:
    """A field as a Merkle leaf holds it."""
    text = f"cast({value} AS varchar)"
    return f"coalesce(cast(octet_length(encode({text})) AS varchar) || ':' || {text}, '-')"


def tree_sql(name: str, leaves: str, depth: int, fanout: int = 8) -> str:
    """Common table expressions {name}0..{name}{depth} (tree, idx, d, n): nodes of every level; a finished tree stays as it is."""
    parts = [f"{name}0 AS (SELECT tree, idx, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(depth):
        parts.append(
            f"{name}{k}g AS (SELECT tree, idx // {fanout} AS idx, list(d ORDER BY idx) AS ds, n FROM {name}{k} GROUP BY tree, idx // {fanout}, n), "
            f"{name}{k + 1} AS (SELECT tree, idx, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, "
            f"count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}g)"
        )
    return ", ".join(parts)


def climb_sql(name: str, start: str, out: str, tree: str, idx: str, depth: int, fanout: int = 8) -> str:
    """Expressions from ``start`` (row key id, own digest, proof) to ``out`` over the levels that ``tree_sql`` made."""
    parts, before = [], start
    for k in range(depth):
        now = out if k == depth - 1 else f"{out}{k}"
        slot = f"(s.{idx} // {fanout ** k}) % {fanout}"
        left, right = f"array_to_string(g.ds[1:{slot}], '')", f"array_to_string(g.ds[{slot} + 2:], '')"
        parts.append(
            f"{now} AS (SELECT s.* REPLACE (CASE WHEN g.n > 1 THEN sha256({left} || s.own || {right}) ELSE s.own END AS own, "
            f"CASE WHEN g.n > 1 THEN s.proof || {left} || {right} ELSE s.proof END AS proof) "
            f"FROM {before} s JOIN {name}{k}g g ON g.tree = s.{tree} AND g.idx = s.{idx} // {fanout ** (k + 1)})"
        )
        before = now
    return ", ".join(parts)


def manifest_sql(depth: int = 7, upper: int = 3) -> str:
    """op13's rows, for up to 8 ** depth rows of a group and 8 ** upper groups."""
    leaf = lambda text: "sha256(" + " || ".join([field_sql(c) for c in ("doc_id", "source", "lang", "n_chars")] + [field_sql(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    chosen = crc32_sql("cast(doc_id AS varchar)") + " % 3 = 0"
    return f"""
WITH raw AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS leaf,
  CASE WHEN {chosen} THEN {leaf(low)} ELSE {leaf('text')} END AS changed FROM documents),
rows0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM raw),
{tree_sql('t', '(SELECT tree, idx, leaf AS d FROM rows0)', depth)},
subs AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, tree AS lang, d FROM t{depth}),
{tree_sql('u', 'subs', upper)},
s0 AS (SELECT r.doc_id, r.leaf, r.changed AS own, '' AS proof, r.tree, r.idx, s.d AS subroot, s.idx AS top, '' AS all_ FROM rows0 r JOIN subs s ON s.lang = r.tree),
{climb_sql('t', 's0', 'a', 'tree', 'idx', depth)},
{climb_sql('u', 'a', 'b', 'all_', 'top', upper)}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = r.d AS verified
FROM b CROSS JOIN (SELECT d FROM u{upper}) r"""


def repair_sql() -> str:
    """op12's rows: a forward search over rows and states that keeps the least (cost, audit) with its repaired text."""
    visible = r"'[^\x20\x09-\x0D]'"
    last = r"regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)"
    # edits of a row: (from, to, needed initial or '' for any)
    keeps = "(0,1,'s'),(0,2,'u'),(1,2,'u'),(3,2,'u'),(2,3,'a')"
    turns = "(0,2,'user'),(1,2,'user'),(3,2,'user'),(2,3,'assistant')"
    glue = "CASE WHEN v.r IS NULL THEN {0} ELSE v.r || chr(10) || {0} END"
    # one step: none, one or two inserts, then the row's own edit; the last step (n + 1) has inserts only
    ins = lambda src: (
        f"SELECT v.conv, v.pos, t.b AS s, v.c + 5 AS c, v.a || 'I' AS a, {glue.format(chr(39) + chr(39) + ' || t.name || ' + chr(39) + ':' + chr(39))} AS r "
        f"FROM {src} v JOIN turns t ON t.a = v.s")
    return f"""
WITH RECURSIVE src AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ')")} % 20 AS kind FROM conversations),
dam AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE kind <> 0)),
rws AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos FROM dam),
flt AS (SELECT *, NOT regexp_matches(text, {visible}) AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again,
  {last} NOT IN ('.', '!', '?') AS cut, lag(role[1:1]) OVER (PARTITION BY conv ORDER BY pos) || role[1:1] AS pair FROM rws),
row_ AS (SELECT conv, pos, role, text, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM flt),
keeps(a, b, initial) AS (VALUES {keeps}), turns(a, b, name) AS (VALUES {turns}),
dp AS (
  SELECT DISTINCT conv, cast(0 AS bigint) AS pos, 0 AS s, 0 AS c, '' AS a, cast(NULL AS varchar) AS r FROM rws
  UNION ALL
  SELECT conv, pos + 1, s, best.c, best.a, best.r FROM (
    SELECT conv, pos, s, min(struct_pack(c := c, a := a, r := r)) AS best FROM (
      WITH v0 AS (SELECT * FROM dp), v1 AS ({ins("v0")}), v2 AS ({ins("v1")}),
      v AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2)
      SELECT v.conv, v.pos, v.s, v.c + 2 AS c, v.a || 'D' AS a, v.r FROM v JOIN row_ w ON w.conv IS NOT DISTINCT FROM v.conv AND w.pos = v.pos + 1
      UNION ALL
      SELECT v.conv, v.pos, k.b, v.c + w.more, v.a || 'K', {glue.format("w.role || ':' || w.text")} FROM v
        JOIN row_ w ON w.conv IS NOT DISTINCT FROM v.conv AND w.pos = v.pos + 1 AND NOT w.gone JOIN keeps k ON k.a = v.s AND k.initial = w.role[1:1]
      UNION ALL
      SELECT v.conv, v.pos, t.b, v.c + 1 + w.more, v.a || 'R', {glue.format("t.name || ':' || w.text")} FROM v
        JOIN row_ w ON w.conv IS NOT DISTINCT FROM v.conv AND w.pos = v.pos + 1 AND NOT w.gone JOIN turns t ON t.a = v.s)
    GROUP BY conv, pos, s)),
fin AS (SELECT dp.* FROM dp JOIN (SELECT conv, max(pos) AS n FROM rws GROUP BY conv) m ON m.conv IS NOT DISTINCT FROM dp.conv AND m.n = dp.pos),
f1 AS ({ins("fin")}), f2 AS ({ins("f1")}),
done AS (SELECT conv, min(struct_pack(c := c, a := a, r := r)) AS best FROM
  (SELECT * FROM fin UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) WHERE s IN (0, 3) GROUP BY conv),
cnt AS (SELECT conv, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM flt GROUP BY conv)
SELECT i.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
  coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(d.best.c, 0)::bigint AS cost,
  coalesce(d.best.a, '') AS audit, sha256(coalesce(d.best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN done d ON d.conv IS NOT DISTINCT FROM i.conv_id
LEFT JOIN cnt ON cnt.conv IS NOT DISTINCT FROM i.conv_id"""
