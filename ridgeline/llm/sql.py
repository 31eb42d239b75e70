"""SQL that says the same as the longer queries of entries.py."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWERED.format("coalesce(text, '')")} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""


def _nodes(name: str, leaves: str) -> str:
    """A recursive table of all levels (tree, level, place, n, digest) over leaves (tree, place, n, digest)."""
    return f"""{name}(tree, level, place, n, digest) AS (
  SELECT tree, 0, place, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 8
)"""


_SIZED = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = " || ".join(_SIZED.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))

#: crc32 of the id's decimal digits, bit by bit; then the trees, each row's siblings by level, and the fold of what it shows.
MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_LEAF.format(text="text")}) AS leaf, sha256({_LEAF.format(text=LOWERED.format("text"))}) AS lowered,
    coalesce(xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 3 = 0, false) AS changed
  FROM documents
), l AS (
  SELECT *, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS row_id FROM d
), v AS (SELECT tree, place, n, leaf AS digest FROM l),
{_nodes("low", "v")},
s AS (
  SELECT tree AS lang, level AS height, 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n, digest FROM low WHERE n = 1
), u AS (SELECT tree, place, n, digest FROM s),
{_nodes("high", "u")},
p AS (
  SELECT l.row_id, x.level, l.place AS at, x.place, x.digest, x.place = (l.place // (8 ** x.level)::BIGINT) AS own
  FROM l JOIN low x ON x.tree IS NOT DISTINCT FROM l.tree AND x.place // 8 = l.place // (8 ** (x.level + 1))::BIGINT AND x.n > 1
  UNION ALL
  SELECT l.row_id, s.height + x.level, s.place, x.place, x.digest, x.place = (s.place // (8 ** x.level)::BIGINT)
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN high x ON x.place // 8 = s.place // (8 ** (x.level + 1))::BIGINT AND x.n > 1
), r AS (
  SELECT row_id, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place > mine), '') AS behind
  FROM (SELECT *, max(place) FILTER (WHERE own) OVER (PARTITION BY row_id, level) AS mine FROM p) GROUP BY row_id, level
), f(row_id, level, digest) AS (
  SELECT row_id, 0, CASE WHEN changed THEN lowered ELSE leaf END FROM l
  UNION ALL
  SELECT f.row_id, f.level + 1, sha256(r.before || f.digest || r.behind) FROM f JOIN r ON r.row_id = f.row_id AND r.level = f.level
), e AS (SELECT row_id, arg_max(digest, level) AS folded_root FROM f GROUP BY row_id),
o AS (SELECT row_id, sha256(string_agg(before || behind, '' ORDER BY level)) AS proof FROM r GROUP BY row_id),
t AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.root, coalesce(o.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN t JOIN e ON e.row_id = l.row_id LEFT JOIN o ON o.row_id = l.row_id
"""


def _assigned(k: int) -> str:
    """Each part's nearest entry of the k-th codebooks."""
    return f"""a{k} AS (
  SELECT vec_id, row_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.row_id, x.part, b.entry, list_sum(list_transform(range(1, len(x.p) + 1), lambda i: (x.p[i] - b.p[i]) * (x.p[i] - b.p[i])))::BIGINT AS d
    FROM x JOIN b{k} b ON b.part = x.part) GROUP BY vec_id, row_id, part
)"""


def _moved(k: int) -> str:
    """The codebooks after round k: floors of means, unused entries as they were."""
    return f"""m{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS p FROM (
    SELECT x.part, a.entry, i, floor(sum(x.p[i]) / count(*))::BIGINT AS m FROM a{k} a JOIN x ON x.row_id = a.row_id AND x.part = a.part, range(1, (SELECT max(len(p)) + 1 FROM x)) t(i) GROUP BY x.part, a.entry, i) GROUP BY part, entry
), b{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.p, b.p) AS p FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry
)"""


CODES = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT vec_id, row_id, part, e[part * (len(e) // 16) + 1:(part + 1) * (len(e) // 16)] AS p FROM v, range(16) t(part)
), b0 AS (
  SELECT part, row_id - 1 AS entry, p FROM x WHERE row_id <= 64
), {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
c AS (
  SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row_id
), h AS (
  SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT v.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, h.codebooks_sha256
FROM v JOIN c ON c.row_id = v.row_id CROSS JOIN h
"""
