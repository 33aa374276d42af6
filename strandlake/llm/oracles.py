"""DuckDB SQL for the queries that SQL can express."""


def _rake_sql(rounds: int = 12, budget: float = 0.5, seed: int = 42) -> str:
    """Raking as a chain of common table expressions, a marginal each."""
    parts = [
        r"""t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)""",
        """d AS (SELECT doc_id, source, lang, n AS n_tokens, CASE WHEN n = 0 THEN 'empty'
 WHEN (length(text) - length(replace(text, '|', ''))) * 20 > n THEN 'table' WHEN (length(text) - length(replace(text, '!', ''))) * 4 > n THEN 'loud'
 WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) * 50 > length(text) THEN 'numbers' WHEN n < 120 THEN 'short' ELSE 'prose' END AS topic FROM t)""",
        """c AS (SELECT coalesce(source, '') AS s, coalesce(lang, '') AS l, topic AS o, CAST(sum(n_tokens) AS DOUBLE) AS k FROM d GROUP BY ALL)""",
        "total AS (SELECT sum(k) AS a FROM c)",
    ]
    for x, power in (("s", 0.5), ("l", 0.7), ("o", 0.8)):
        parts.append(f"g_{x} AS (SELECT {x}, pow(sum(k), {power}) AS p FROM c GROUP BY {x} HAVING sum(k) > 0)")
        parts.append(f"h_{x} AS (SELECT {x}, p / (SELECT sum(p) FROM g_{x}) * a AS target FROM g_{x}, total)")
    parts.append("w0 AS (SELECT s, l, o, k, k AS w FROM c)")
    step = 0
    for _ in range(rounds):
        for x in "slo":
            step += 1
            parts.append(
                f"w{step} AS MATERIALIZED (SELECT s, l, o, k, coalesce(w * target / nullif(sum(w) OVER (PARTITION BY {x}), 0), 0) AS w"
                f" FROM w{step - 1} LEFT JOIN h_{x} USING ({x}))"
            )
    parts += [
        f"r AS (SELECT s, l, o, k, CASE WHEN k > 0 THEN w / k ELSE 0 END AS r FROM w{step})",
        f"f AS (SELECT r, ({budget} * a - coalesce(sum(k) OVER q, 0)) / nullif(sum(k * r) OVER () - coalesce(sum(k * r) OVER q, 0), 0) AS f"
        " FROM r, total WINDOW q AS (ORDER BY r DESC, s, l, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        "z AS (SELECT f FROM f WHERE f * r <= 1 ORDER BY r DESC LIMIT 1)",
        "p AS (SELECT s, l, o, round(CASE WHEN k > 0 THEN least(1.0, f * r) ELSE 1.0 END, 9) AS p FROM r, z)",
    ]
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(p, 7) AS probability,
       CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|{seed}'), 1, 8)) AS UBIGINT) / 4294967296.0 < p AS sampled
FROM d JOIN p ON coalesce(source, '') = s AND coalesce(lang, '') = l AND topic = o"""
    )


def _leaf_sql(more: int) -> str:
    def field(c: str) -> str:
        text = f"CAST({c} + {more} AS VARCHAR)" if c == "n_chars" and more else f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen({text}) AS VARCHAR) || ':' || {text} END"

    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "text"))) + ")"


def _tree_sql(name: str, leaves: str, levels: int) -> list[str]:
    """Nodes (k, g, p, h, c) of the trees over leaves (g, p, h); c: nodes of the same level and g."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT 0 AS k, g, p, h, count(*) OVER (PARTITION BY g) AS c FROM {leaves})"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT {k + 1} AS k, g, p, h, count(*) OVER (PARTITION BY g) AS c"
            f" FROM (SELECT g, p // 2 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{k} AS x(k, g, p, h, c) WHERE c > 1 GROUP BY g, x.p // 2))"
        )
    parts.append(f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(levels + 1)) + ")")
    return parts


def _merkle_sql(levels: int = 24, upper: int = 10) -> str:
    """All trees by levels; the checksum of the ids by its table, digit by digit."""
    parts = [
        "bits(b, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL"
        " SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8)",
        "ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)",
        "crc(doc_id, s, k, c) AS (SELECT doc_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids UNION ALL"
        " SELECT doc_id, s, crc.k + 1, xor(c >> 8, v) FROM crc JOIN bits ON bits.k = 8 AND b = xor(c, ascii(s[crc.k + 1])) & 255 WHERE crc.k < length(s))",
        "hit AS (SELECT doc_id, true AS hit FROM crc WHERE k = length(s) AND xor(c, 4294967295) % 7 = 0)",
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql(0)} AS h,"
        f" CASE WHEN hit THEN {_leaf_sql(1)} ELSE {_leaf_sql(0)} END AS now FROM documents LEFT JOIN hit USING (doc_id))",
        "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d)",
        *_tree_sql("n", "e", levels),
        "sub AS MATERIALIZED (SELECT g, k AS depth, h AS subroot, row_number() OVER (ORDER BY CAST(encode(g) AS BLOB)) - 1 AS q FROM n WHERE c = 1)",
        "subs AS (SELECT '' AS g, q AS p, subroot AS h FROM sub)",
        *_tree_sql("u", "subs", upper),
        "top AS MATERIALIZED (SELECT k AS depth, h AS root FROM u WHERE c = 1)",
        "f(r, k, h, sibs, p, g, depth) AS (SELECT r, CAST(0 AS BIGINT), now, '', p, g, depth FROM e JOIN sub USING (g) UNION ALL"
        " SELECT f.r, f.k + 1, sha256(CASE WHEN n.h IS NULL THEN f.h WHEN (f.p >> f.k) & 1 = 1 THEN n.h || f.h ELSE f.h || n.h END),"
        " sibs || coalesce(n.h, ''), f.p, f.g, depth FROM f LEFT JOIN n ON n.k = f.k AND n.g = f.g AND n.p = xor(f.p >> f.k, 1) WHERE f.k < depth)",
        "t(r, k, h, sibs, p, depth) AS (SELECT r, CAST(0 AS BIGINT), h, sibs, q, top.depth FROM f JOIN sub USING (g), top WHERE f.k = f.depth UNION ALL"
        " SELECT t.r, t.k + 1, sha256(CASE WHEN u.h IS NULL THEN t.h WHEN (t.p >> t.k) & 1 = 1 THEN u.h || t.h ELSE t.h || u.h END),"
        " sibs || coalesce(u.h, ''), t.p, depth FROM t LEFT JOIN u ON u.k = t.k AND u.p = xor(t.p >> t.k, 1) WHERE t.k < depth)",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + """
SELECT doc_id, d.h AS leaf, subroot, root, sha256(sibs) AS proof_sha256, t.h AS folded_root, t.h = root AS verified
FROM d JOIN sub USING (g) JOIN t ON t.r = d.r AND t.k = t.depth, top"""
    )


def _cluster_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Rounds of assignment and floored means as a chain of common table expressions."""
    far = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e"
        f" FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER o - 1 AS c, e FROM v WINDOW o AS (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, vec_id NULLS LAST, e) QUALIFY row_number() OVER o <= {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': {far}, 'c': c.c}}) AS m FROM v, c{n} AS c GROUP BY r)")
        if n < rounds:
            parts.append(
                f"s{n} AS (SELECT c, list(q ORDER BY i) AS e FROM (SELECT m.c AS c, i, CAST((sum(e[i]) - ((sum(e[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q"
                f" FROM a{n} JOIN v USING (r), range(1, {dim + 1}) AS t(i) GROUP BY m.c, i) GROUP BY c)"
            )
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c AS c, coalesce(s.e, c.e) AS e FROM c{n} AS c LEFT JOIN s{n} AS s USING (c))")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS c ON c.c = m.c"""
    )


ORACLES = {
    "op3_rake_mixture": _rake_sql(),
    "op4_line_windows": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, l[p] || chr(10) || l[p+1] || chr(10) || l[p+2] AS s
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
i AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
k AS (SELECT i.doc_id, string_agg(line, chr(10) ORDER BY i.p) FILTER (c.p IS NULL) AS t, count(c.p) AS n
      FROM i LEFT JOIN c USING (doc_id, p) GROUP BY i.doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_lsm_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_prefix_filtered_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, p, item_id FROM x JOIN v USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op10_warc_index_first": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k""",
    "op7_repeated_phrase_automata": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE k > 1),
i AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT i.doc_id, string_agg(word, ' ' ORDER BY i.p) FILTER (c.p IS NULL) AS t, count(c.p) AS n
      FROM i LEFT JOIN c USING (doc_id, p) GROUP BY i.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op11_centroid_gemm": _cluster_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op13_minhash_multi_index": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, w[p] || coalesce(' ' || w[p + 1], '') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
f AS MATERIALIZED (SELECT s, count(*) AS k FROM s GROUP BY s),
x AS MATERIALIZED (SELECT r, s, n FROM (SELECT r, s, n, row_number() OVER (PARTITION BY r ORDER BY k, s) AS p FROM s JOIN f USING (s) JOIN n USING (r)) WHERE p <= n - (80 * n + 99) // 100 + 1),
c AS MATERIALIZED (SELECT DISTINCT a.r AS a, b.r AS b, a.n AS m, b.n AS n FROM x AS a JOIN x AS b ON a.s = b.s AND a.r < b.r WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT a, b FROM c JOIN s AS t ON t.r = a JOIN s AS o ON o.r = b AND o.s = t.s GROUP BY a, b, m, n HAVING 100 * count(*) >= 80 * (m + n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
q(r, o) AS (SELECT r, r FROM d UNION SELECT q.r, e.b FROM q JOIN e ON e.a = q.o)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, doc_id IS NULL AND component_id IS NULL) AS kept
FROM d LEFT JOIN n USING (r) JOIN (SELECT q.r, min(doc_id) AS component_id FROM q JOIN d AS z ON z.r = q.o GROUP BY q.r) USING (r)""",
}
