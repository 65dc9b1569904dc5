"""SQL fragments for checking the queries: CRC-32, grams and minimizers as common table expressions."""

from __future__ import annotations

import re

#: The CRC's table by its recurrence, then seven derived ones, flattened: l[j * 256 + byte + 1].
CRC = """
t(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
t0 AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
tj(j, l) AS (SELECT 0, l FROM t0
  UNION ALL SELECT j + 1, list_transform(tj.l, lambda x: xor(x >> 8, t0.l[(x & 255) + 1])) FROM tj, t0 WHERE j < 7),
tab AS (SELECT flatten(list(l ORDER BY j)) AS l FROM tj)"""

#: Documents as lists of bytes.
DOCS = """
d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents)"""


def nested_xor(terms: list[str]) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"xor({out}, {t})"
    return out


def grams(name: str, source: str, q: int = 8) -> str:
    """(id, pos, n, crc) of all q-grams of source (id, b)."""
    look = [f"l[{(q - 1 - k) * 256} + {f'(255 - b[p + {k}])' if k < 4 else f'b[p + {k}]'} + 1]" for k in range(q)]
    crc = nested_xor(["4294967295", *look])
    return f"""
{name} AS (SELECT id, unnest(range(1, len(b) - {q - 2})) AS pos, len(b) - {q - 1} AS n,
    unnest(list_transform(range(1, len(b) - {q - 2}), lambda p: {crc})) AS crc
  FROM {source}, tab WHERE len(b) >= {q})"""


def minimizers(name: str, source: str, w: int = 8, short: bool = True, q: int = 8) -> str:
    """(id, crc): distinct minimizer keys of source (id, b)."""
    own = f"""
  UNION SELECT id, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t0.l[(xor(c, x) & 255) + 1]))) FROM {source}, t0 WHERE len(b) < {q}"""
    return f"""{grams(f'g_{name}', source, q)},
{name} AS (SELECT DISTINCT id, crc FROM (
    SELECT id, pos, n, CASE WHEN n <= {w} THEN crc ELSE min(crc) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS crc FROM g_{name})
  WHERE n <= {w} OR pos >= {w}{own if short else ''})"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


#: Bytes 9 to 104 of every hundredth document, a shorter one as it is; and those that are long enough for filters.
QUERIES = """
q AS (SELECT id, CASE WHEN len(b) >= 104 THEN b[9:104] ELSE b END AS b FROM d WHERE id % 100 = 0),
ql AS (SELECT * FROM q WHERE len(b) >= 47)"""

#: Documents' bytes one by one.
BYTES = """
x AS (SELECT id, unnest(range(len(b))) AS ba, unnest(b) AS byte FROM d)"""

ENTROPY = """
c AS (SELECT id, byte, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT id, sum(n) AS total FROM c GROUP BY ALL),
e AS (SELECT d.id, coalesce(round(abs(z.h), 9), 0.0) AS entropy FROM d LEFT JOIN (
  SELECT c.id, sum(-(n / total) * log2(n / total)) AS h FROM c JOIN s ON c.id = s.id GROUP BY c.id) z ON d.id = z.id)"""


def profile(name: str, where: str = "true", size: int = 64) -> str:
    return f"""
p_{name} AS (SELECT entropy, row_number() OVER (ORDER BY e.id) - 1 AS pos, count(*) OVER () AS n, min(entropy) OVER () AS lo, max(entropy) OVER () AS hi
  FROM e JOIN documents o ON e.id = o.doc_id WHERE {where}),
{name} AS (SELECT r.slot::INTEGER AS slot, coalesce(CASE WHEN hi > lo THEN (entropy - lo) / (hi - lo) ELSE 0.0 END, 0.0) AS value
  FROM range({size}) r(slot) LEFT JOIN p_{name} ON pos = CASE WHEN (SELECT max(n) FROM p_{name}) > {size} THEN r.slot * (SELECT max(n) FROM p_{name}) // {size} ELSE r.slot END
  WHERE (SELECT count(*) FROM p_{name}) > 0)"""


def signature(name: str, where: str = "true", k: int = 128, window: int = 32) -> str:
    total = " + ".join(f"b[p + {j}]::HUGEINT * {pow(257, window - 1 - j, 1 << 64)}" for j in range(window))
    return f"""
{name} AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS rank, lower(lpad(hex(h::UBIGINT), 16, '0')) AS hash FROM (
  SELECT unnest(list_transform(range(1, len(b) - {window - 2}), lambda p: ({total}) % 18446744073709551616)) AS h
  FROM d JOIN documents o ON d.id = o.doc_id WHERE len(b) >= {window} AND {where} ORDER BY h LIMIT {k}))"""


LOW = "((crc::HUGEINT * 2654435769) & 4294967295)"


def bloom_positions(bits: int = 16384, k: int = 11) -> str:
    return f"list_transform(range({k}), lambda i: (({LOW} + i * crc::HUGEINT) % {bits})::BIGINT)"


BLOOM = f"""
kb AS (SELECT DISTINCT id, unnest({bloom_positions()}) AS pos FROM m),
kq AS (SELECT DISTINCT id, crc, unnest(list_distinct({bloom_positions()})) AS pos FROM mq),
need AS (SELECT id, crc, count(*) AS n FROM kq GROUP BY ALL),
hits AS (SELECT kq.id AS qid, kq.crc, kb.id AS chunk_id FROM kq JOIN kb ON kq.pos = kb.pos JOIN need ON need.id = kq.id AND need.crc = kq.crc
  GROUP BY kq.id, kq.crc, kb.id, need.n HAVING count(*) = need.n)
"""


def search(df_max: int = 16, block: int = 16, most: int = 256) -> str:
    """summary and cand of the two-layer search over m (chunks) and mq (queries)."""
    return f"""
n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT crc, count(*) AS df FROM m GROUP BY crc),
hb AS (SELECT mq.id AS qid, crc, df, row_number() OVER (PARTITION BY mq.id ORDER BY df, crc) AS rk FROM mq JOIN f USING (crc) WHERE df <= {df_max}),
masks AS (SELECT DISTINCT crc, m.id // {block} AS block FROM m JOIN f USING (crc) WHERE df > {df_max}),
fc AS (SELECT crc, count(*) * {block} AS df FROM masks GROUP BY crc),
hc AS (SELECT mq.id AS qid, crc, df, row_number() OVER (PARTITION BY mq.id ORDER BY df, crc) AS rk FROM mq JOIN fc USING (crc)),
lists AS (SELECT qid, m.id AS chunk_id, min(rk) AS rk FROM hb JOIN m USING (crc) WHERE rk <= 2 GROUP BY ALL),
cc AS (SELECT DISTINCT qid, unnest(range(block * {block}, least(block * {block} + {block}, n.n))) AS chunk_id FROM hc JOIN masks USING (crc), n WHERE rk <= 2),
s0 AS (SELECT q.id AS qid,
  (SELECT count(*) FROM hb WHERE hb.qid = q.id) AS nb, (SELECT min(df) FROM hb WHERE hb.qid = q.id) AS df_b,
  (SELECT count(*) FROM hc WHERE hc.qid = q.id) AS nc, (SELECT min(df) FROM hc WHERE hc.qid = q.id) AS df_c,
  (SELECT count(*) FROM lists WHERE lists.qid = q.id) AS n12, (SELECT count(*) FROM lists WHERE lists.qid = q.id AND rk = 1) AS n1,
  (SELECT count(*) FROM cc WHERE cc.qid = q.id) AS ncc, n.n FROM q, n),
s1 AS (SELECT *, CASE WHEN n12 <= {most} THEN n12 ELSE n1 END AS size_b FROM s0),
s2 AS (SELECT *, (nb = 0 OR size_b > {most}) AND nc > 0 AS by_c FROM s1),
s3 AS (SELECT *, by_c AND (nb = 0 OR ncc < size_b) AS take_c, by_c AND (nb = 0 OR df_c < df_b) AS label_c FROM s2),
s4 AS (SELECT *, nb + nc = 0 OR (CASE WHEN take_c THEN ncc ELSE size_b END) > n // 2 AS everything FROM s3),
picked AS (
  SELECT lists.qid, chunk_id FROM lists JOIN s4 ON lists.qid = s4.qid WHERE NOT everything AND NOT take_c AND (n12 <= {most} OR rk = 1)
  UNION ALL SELECT cc.qid, chunk_id FROM cc JOIN s4 ON cc.qid = s4.qid WHERE NOT everything AND take_c
  UNION ALL SELECT qid, unnest(range(n)) FROM s4 WHERE everything),
cand AS (SELECT DISTINCT qid, c AS chunk_id FROM (SELECT qid, unnest([chunk_id - 1, chunk_id, chunk_id + 1]) AS c FROM picked), n WHERE c >= 0 AND c < n.n),
summary AS (SELECT s4.qid,
  CASE WHEN nb + nc = 0 THEN 'l0_fallback' ELSE 'l0_' || CASE WHEN everything THEN 'fallback' WHEN take_c THEN 'c_top2' WHEN n12 > {most} THEN 'b_best1' WHEN nb >= 2 THEN 'b_isect' ELSE 'b_best' END || '_' || (nb + nc) END AS method,
  nb + nc AS anchors_found, nb AS b_anchors, nc AS c_anchors, coalesce(CASE WHEN label_c THEN df_c ELSE df_b END, 0) AS best_df,
  CASE WHEN everything THEN 'fallback' WHEN label_c THEN 'C' WHEN nb >= 2 THEN 'B_isect' ELSE 'B' END AS best_source,
  (SELECT count(*) FROM cand WHERE cand.qid = s4.qid) AS cand_count,
  round(100 * (SELECT count(*) FROM cand WHERE cand.qid = s4.qid) / n, 6) AS cand_pct, (nb + nc > 0)::INTEGER::DOUBLE AS l0_hit_rate FROM s4)"""


def renamed(text: str, names: str, suffix: str) -> str:
    """The fragment with these names of its tables suffixed."""
    return re.sub(rf"\b({names})\b", rf"\1{suffix}", text)


#: Slices of the whole corpus, ``q``, and the first and last document that each touches.
RAW = """
so AS (SELECT id, sum(len(b)) OVER (ORDER BY id) - len(b) AS off FROM d),
x2 AS (SELECT id, byte, (off + ba)::BIGINT AS p FROM x JOIN so USING (id)),
rt AS (SELECT L * 100 + i AS qid, L, (i * 62710561) % (total - L + 1) AS o FROM (SELECT sum(len(b))::BIGINT AS total FROM d), (VALUES (48), (192), (768)) v(L), range(100) r(i) WHERE L <= total),
qx AS (SELECT qid, L, byte, p, x2.id FROM (SELECT qid, L, unnest(range(o, o + L)) AS p FROM rt) JOIN x2 USING (p)),
q AS (SELECT qid AS id, list(byte ORDER BY p) AS b FROM qx GROUP BY qid),
lim AS (SELECT qid, L::INTEGER AS length, min(id) AS low, max(id) AS high FROM qx GROUP BY ALL)"""

#: Metrics over r(anchors_found, cand_count, hit, n).
METRICS = """count(*) AS trials, round(count(*) FILTER (WHERE anchors_found > 0) / count(*), 4) AS hit_rate, round(100 * count(*) FILTER (WHERE good) / count(*), 1) AS effective_pct,
  count(*) FILTER (WHERE anchors_found > 0 AND NOT good) AS fallback, count(*) FILTER (WHERE anchors_found = 0) AS miss,
  round(1 - count(*) FILTER (WHERE good AND NOT hit) / count(*), 4) AS recall, count(*) FILTER (WHERE good AND NOT hit) AS recall_fail,
  round(avg(cand_count) FILTER (WHERE good), 1) AS avg_cand, floor(quantile_cont(cand_count, 0.5) FILTER (WHERE good))::BIGINT AS med_cand
FROM (SELECT *, anchors_found > 0 AND cand_count * 2 < n AS good FROM r)"""
