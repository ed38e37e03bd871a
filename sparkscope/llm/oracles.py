"""DuckDB SQL for the queries of ``registry``: plain forms of the definitions, for small tables."""

from __future__ import annotations

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _merkle() -> str:
    """Trees of three by recursion over levels: of each source, then over the sources' roots; proofs folded by a list."""

    def leaf(text: str) -> str:
        fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"

    def up(rows: str) -> str:
        return f"""{rows}
            UNION ALL
            SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM {{name}} WHERE n > 1 GROUP BY g, lvl, i // 3"""

    def beside(name: str, at: str, on: str, first: int) -> str:
        own = f"{at} // CAST(pow(3, u.lvl) AS BIGINT)"
        return f"""SELECT rid, u.lvl + {first} AS lvl, coalesce(string_agg(h, '' ORDER BY u.i) FILTER (WHERE u.i < {own}), '') AS before,
                   coalesce(string_agg(h, '' ORDER BY u.i) FILTER (WHERE u.i > {own}), '') AS after
            FROM leaves l JOIN {name} u ON {on} AND u.n > 1 AND u.i // 3 = {at} // CAST(pow(3, u.lvl + 1) AS BIGINT) GROUP BY rid, u.lvl"""

    return f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
        ), hashed AS (
            SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS other,
                   xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda a: CAST(ord(a) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS sum
            FROM documents, crc
        ), leaves AS (
            SELECT *, CASE WHEN sum % 2 = 0 THEN other ELSE leaf END AS changed, row_number() OVER () AS rid,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM hashed
        ), up AS (
            {up("SELECT g, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves").format(name="up")}
        ), subroots AS (SELECT g AS i, h AS subroot, count(*) OVER () AS n FROM up WHERE n = 1), top AS (
            {up("SELECT 0 AS g, 0 AS lvl, i, subroot AS h, n FROM subroots").format(name="top")}
        ), steps AS (
            {beside("up", "l.i", "u.g = l.g", 0)}
            UNION ALL {beside("top", "l.g", "u.g = 0", 100)}
        ), proofs AS (
            SELECT rid, string_agg(before || after, '' ORDER BY lvl) AS proof, list(before || '|' || after ORDER BY lvl) AS path FROM steps GROUP BY rid
        ), folded AS (
            SELECT l.*, coalesce(proof, '') AS proof, list_reduce(coalesce(path, []), lambda h, p: sha256(split_part(p, '|', 1) || h || split_part(p, '|', 2)), changed) AS folded_root
            FROM leaves l LEFT JOIN proofs USING (rid)
        )
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = h AS verified
        FROM folded f JOIN subroots s ON s.i = f.g, (SELECT h FROM top WHERE n = 1)
    """


ORACLES: dict[str, str] = {
    # Bytes are pairs of hex digits; blocks keep the strings short from which windows are cut.
    "op1_suffix_array_dedup": """
        WITH texts AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), blocks AS (
            SELECT doc_id, n, b, substr(h, CAST(2 * b + 1 AS BIGINT), 1422) AS part FROM texts, unnest(range(0, n, 512)) u(b)
        ), windows AS (
            SELECT doc_id, b + i AS p, substr(part, CAST(2 * i + 1 AS BIGINT), 400) AS w FROM blocks, unnest(range(0, least(512, n - b - 199))) v(i)
        ), prints AS (
            SELECT doc_id, p, md5_number(w) AS k FROM windows
        ), starts AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM prints) WHERE c > 1
        ), marked AS (
            SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS first FROM starts
        ), numbered AS (
            SELECT doc_id, p, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
        ), runs AS (
            SELECT doc_id, run, min(p) AS a, max(p) + 200 AS z FROM numbered GROUP BY ALL
        ), gaps AS (
            SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
            UNION ALL SELECT t.doc_id, coalesce(max(r.z), 0), any_value(t.n) FROM texts t LEFT JOIN runs r USING (doc_id) GROUP BY t.doc_id
        ), rest AS (
            SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS kept FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
        ), sums AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM texts JOIN rest USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op6_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, least(len(w) + 1, 2)))) u(i)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
        ), reach AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
    """,
    # Five hex digits are four letters of base 32.
    "op8_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS t FROM pages
        ), named AS (
            SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS target FROM payloads
        ), digits AS (
            SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS d FROM named
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((d[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> target THEN target END AS refers_to
        FROM digits
    """,
    "op10_benchmark_decontamination": f"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, w[i : i + 9] AS terms FROM items, unnest(range(1, greatest(len(w) - 8, least(len(w) + 1, 2)))) u(i)
        ), phrases AS (
            SELECT array_to_string(terms, ' ') AS s, len(terms) AS size, list(DISTINCT item) AS of FROM windows GROUP BY ALL
        ), places AS (
            SELECT doc_id, i, z, array_to_string(w[i : i + z - 1], ' ') AS s FROM texts, (SELECT DISTINCT size AS z FROM phrases) q, unnest(range(1, len(w) - z + 2)) u(i)
        ), met AS (
            SELECT doc_id, i, z, of FROM places JOIN phrases USING (s) WHERE z = size
        ), hit AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM met, unnest(range(z)) u(k) GROUP BY doc_id
        ), found AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, unnest(of) AS item FROM met) GROUP BY doc_id
        ), postings AS (
            SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM texts
        ), counts AS (
            SELECT t, count(*) AS c FROM postings GROUP BY t
        ), rarest AS (
            SELECT terms, arg_min(u.t, struct_pack(c := coalesce(c, 0), t := u.t)) AS t
            FROM (SELECT terms, unnest(terms) AS t FROM (SELECT DISTINCT terms FROM windows)) u LEFT JOIN counts USING (t) GROUP BY terms
        ), beside AS (
            SELECT DISTINCT doc_id, terms FROM rarest JOIN postings USING (t) JOIN texts USING (doc_id)
            WHERE list_has_all(w[greatest(1, p - 20) : p + 20], terms)
        ), near AS (
            SELECT doc_id, count(DISTINCT item) AS n FROM beside JOIN windows USING (terms) GROUP BY doc_id
        )
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near_items
        FROM texts t LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op12_merkle_manifest": _merkle(),
    "op13_filter_audit": """
        WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
        ), steps AS (
            SELECT o, s, sum(bit) FILTER (WHERE strpos(o, l) = s) AS bit, coalesce(sum(bit) FILTER (WHERE strpos(o, l) < s), 0) AS before
            FROM orders, range(1, 6) r(s), letters GROUP BY o, s
        ), said AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
        ), texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), failing AS (
            SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM texts
        ), cells AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, mask
        ), counted AS (
            SELECT part, o, s, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS toxic_lost
            FROM (SELECT o, s, CAST(bit AS BIGINT) AS bit, CAST(before AS BIGINT) AS before FROM steps), (SELECT part, CAST(mask AS BIGINT) AS mask, n, g, x FROM cells) GROUP BY part, o, s, bit
        )
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM counted
    """,
}
