"""SQL that states the results of the prefix trie and of the Merkle manifest."""

from __future__ import annotations

#: CRC-32 from its polynomial: a table of 256 numbers, made by rule.
CRC = """bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc(x: str) -> str:
    """SQL of the unsigned CRC-32 of a text of ASCII signs, where `tab` is in reach."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"


def told(c: str) -> str:
    """SQL of a column as a leaf holds it."""
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def joined(*parts: str) -> str:
    return " || ".join(parts)


OP12 = f"""WITH RECURSIVE {CRC},
leaves AS (SELECT doc_id, lang, sha256({joined(*map(told, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS h,
 CASE WHEN {crc('doc_id::VARCHAR')} % 3 = 0 THEN sha256({joined(*map(told, ('doc_id', 'source', 'lang', 'n_chars')), told(LOWERED))}) END AS changed FROM documents, tab),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS level, pos, h, n FROM placed UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, subroot AS h, n FROM subs UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8),
beside AS (SELECT a.lang, 0 AS part, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
 FROM nodes a JOIN nodes b ON b.lang IS NOT DISTINCT FROM a.lang AND b.level = a.level AND b.pos // 8 = a.pos // 8 WHERE a.n > 1 GROUP BY a.lang, a.level, a.pos
 UNION ALL SELECT NULL, 1, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), ''), coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '')
 FROM tops a JOIN tops b ON b.level = a.level AND b.pos // 8 = a.pos // 8 WHERE a.n > 1 GROUP BY a.level, a.pos),
low AS (SELECT p.doc_id, p.lang, p.h AS leaf, 0 AS level, p.pos, p.n, coalesce(p.changed, p.h) AS folded, '' AS proof FROM placed p
 UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(s.l || w.folded || s.r), w.proof || s.l || s.r FROM low w JOIN beside s ON s.part = 0 AND s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.pos = w.pos WHERE w.n > 1),
high AS (SELECT w.doc_id, w.leaf, s.subroot, 0 AS level, s.pos, s.n, w.folded, w.proof FROM low w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
 UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(s.l || w.folded || s.r), w.proof || s.l || s.r FROM high w JOIN beside s ON s.part = 1 AND s.level = w.level AND s.pos = w.pos WHERE w.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM tops WHERE n = 1) AS verified FROM high WHERE n = 1"""
OP11 = f"""WITH RECURSIVE {CRC},
told AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT c, name, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, name) AS pos FROM told),
convs AS (SELECT c, c - c % 20 AS base, {crc('c::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT c FROM placed) x, tab),
rebuilt AS (SELECT v.c, p.pos AS i, p.name, p.words FROM convs v JOIN placed p ON p.c = v.base AND p.pos <= v.h UNION ALL SELECT v.c, p.pos + 1000000000, p.name, p.words FROM convs v JOIN placed p ON p.c = v.c AND p.pos > v.h),
turns AS (SELECT c, name, words, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM rebuilt),
sized AS (SELECT v.c, count(t.c) AS n FROM convs v LEFT JOIN turns t ON t.c = v.c GROUP BY v.c),
path AS (SELECT c, 0::BIGINT AS d, '' AS k, 0::BIGINT AS words FROM convs UNION ALL SELECT p.c, t.d, sha256(p.k || t.name), t.words FROM path p JOIN turns t ON t.c = p.c AND t.d = p.d + 1),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own FROM path GROUP BY k, d),
up AS (SELECT DISTINCT b.k, a.k AS parent FROM path b JOIN path a ON a.c = b.c AND a.d = b.d - 1),
kids AS (SELECT parent AS k, count(*) AS n FROM up GROUP BY parent),
reach AS (SELECT DISTINCT a.k AS top, b.k FROM path a JOIN path b ON b.c = a.c AND b.d >= a.d),
sums AS (SELECT r.top AS k, count(*) FILTER (WHERE s.n IS NULL) AS n_leaves, CAST(sum(n.own) AS BIGINT) AS saved FROM reach r JOIN nodes n ON n.k = r.k LEFT JOIN kids s ON s.k = r.k GROUP BY r.top),
ends AS (SELECT p.k, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS e FROM path p JOIN sized z ON z.c = p.c AND z.n = p.d GROUP BY p.k)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(s.n, 0) AS n_children, m.n_leaves, m.saved AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN up u ON u.k = n.k LEFT JOIN nodes q ON q.k = u.parent LEFT JOIN kids s ON s.k = n.k JOIN sums m ON m.k = n.k LEFT JOIN ends e ON e.k = n.k"""
