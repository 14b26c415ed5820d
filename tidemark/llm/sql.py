"""DuckDB statements for the corpus queries that SQL can express."""

#: CRC-32 of the strings `s` of a table, four bits at a time: a table of 16 entries, then two steps a byte, the low half first.
_CRC = r"""
        nibble AS (
            SELECT list_transform(range(16), lambda n: list_reduce(range(4), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n)) AS t
        ), {name} AS (
            SELECT s, xor(4294967295, list_reduce(range(len(x)), lambda a, i: xor(a >> 4, t[(xor(a, strpos('0123456789ABCDEF', x[xor(i, 1) + 1]) - 1) & 15) + 1]), 4294967295)) AS crc
            FROM (SELECT DISTINCT s, hex(encode(s)) AS x FROM {of}), nibble
        )"""

SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)
        ), least_doc AS (
            SELECT h, min(doc_id) AS m FROM win GROUP BY h
        ), hit AS (
            SELECT doc_id, i FROM win JOIN least_doc USING (h) WHERE m < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS p FROM hit, generate_series(0, 49) AS s(k)
        ), word AS (
            SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d
        ), kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
    """,
    "op7_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 2], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS i FROM d)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * common >= 90 * (x.n + y.n - common)
        ), edge AS (
            SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM d
            UNION
            SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY ALL
    """,
    "op9_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS t
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
        ), size AS (
            SELECT DISTINCT n FROM bw
        ), dw AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, size)
        ), hit AS (
            SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, t)
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit))
            GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
        ), phrase AS (
            SELECT DISTINCT item_id, w[i : i + 9] AS p
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
        ), place AS (
            SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS j FROM d
        ), anchor AS (
            SELECT item_id, p, arg_min(k, coalesce(c, 0)) AS r
            FROM (SELECT item_id, p, unnest(p) AS x, unnest(generate_series(1, len(p))) AS k FROM phrase)
            LEFT JOIN (SELECT x, count(*) AS c FROM place GROUP BY x) USING (x) GROUP BY item_id, p
        ), attempt AS (
            SELECT doc_id, item_id, p, j - r + 1 + o AS i
            FROM place JOIN anchor ON x = p[r] JOIN (SELECT unnest(generate_series(-2, 2)) AS o) ON o = 0 OR r > 1
        ), near AS (
            SELECT DISTINCT doc_id, item_id FROM attempt JOIN d USING (doc_id)
            WHERE i >= 1 AND i + len(p) - 1 <= len(w) AND w[i] = p[1]
              AND len(list_filter(generate_series(2, len(p)), lambda k: NOT list_contains(w[greatest(i + k - 3, 1) : i + k + 1], p[k]))) = 0
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near GROUP BY doc_id) USING (doc_id)
    """,
    "op11_target_resampling": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), df AS (
            SELECT doc_id, array_to_string(w[i : i + k], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM (SELECT doc_id, w, unnest([0, 1, 2]) AS k FROM d))
        ), bf AS (
            SELECT array_to_string(w[i : i + k], ' ') AS s
            FROM (SELECT w, k, unnest(range(1, len(w) - k + 1)) AS i FROM (SELECT w, unnest([0, 1, 2]) AS k FROM b))
        ), each_one AS (
            SELECT s FROM df UNION SELECT s FROM bf
        ),""" + _CRC.format(name="coded", of="each_one") + r""", source AS (
            SELECT crc % 10000 AS bucket, count(*) AS n FROM df JOIN coded USING (s) GROUP BY 1
        ), target AS (
            SELECT crc % 10000 AS bucket, count(*) AS n FROM bf JOIN coded USING (s) GROUP BY 1
        ), gain AS (
            SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM source) + 10000)::DOUBLE
                   / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS g
            FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN source s USING (bucket) LEFT JOIN target t USING (bucket)
        ), weighed AS (
            SELECT doc_id, count(*) AS n_features, sum(g) AS weight
            FROM df JOIN coded USING (s) JOIN gain ON gain.bucket = crc % 10000 GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN weighed USING (doc_id)
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank, n_words::BIGINT AS n_words
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
    "op12_bottom_sketches": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 1], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, least(len(w), 1)))) AS i FROM d)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM (SELECT doc_id, h, n FROM g JOIN n USING (doc_id)) a JOIN (SELECT doc_id, h, n FROM g JOIN n USING (doc_id)) b USING (h)
            WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
        ), link AS (
            SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * common >= 80 * (x.n + y.n - common)
        ), edge AS (
            SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM d
            UNION
            SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id, min(reach.b) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE run AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
        ), named AS (
            SELECT r, doc_id || ':' || r AS s FROM run WHERE length(r) >= 6
        ),""" + _CRC.format(name="coded", of="named") + r""", v AS (
            SELECT CASE WHEN crc % 199 = 0 THEN left(r, (crc % length(r))::BIGINT) || substr(r, (crc % length(r))::BIGINT + 2) ELSE r END AS word, count(*)::BIGINT AS n
            FROM named JOIN coded USING (s) GROUP BY 1 HAVING length(word) >= 6 AND count(*) >= 5
        ), letter AS (
            SELECT DISTINCT unnest(string_split(word, '')) AS c FROM v
        ), place AS (
            SELECT word, unnest(range(length(word) + 1)) AS i FROM v
        ), near AS (
            SELECT p.word, v.word AS near, v.n
            FROM (
                SELECT word, left(word, i) || substr(word, i + 2) AS x FROM place WHERE i < length(word)
                UNION SELECT word, left(word, i) || c || substr(word, i + 2) FROM place, letter WHERE i < length(word)
                UNION SELECT word, left(word, i) || c || substr(word, i + 1) FROM place, letter
            ) p JOIN v ON v.word = x WHERE x <> p.word
        ), best AS (
            SELECT word, count(*) AS n_near, list(near ORDER BY n DESC, near)[1] AS near, max(n) AS near_n FROM near GROUP BY word
        ), formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
            FROM v LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS last FROM formed
            UNION ALL
            SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.last WHERE form IS NOT NULL
        )
        SELECT f.word, f.form, walk.last AS root, f.n, f.n_near, f.form_n
        FROM formed f JOIN walk ON walk.word = f.word JOIN formed e ON e.word = walk.last WHERE e.form IS NULL
    """,
}
