"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"

#: In the block that is cut: what is taken in a round, and then the last one taken and what is left.
_ROUND = """, f{k} AS (
    SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source, cut_block ORDER BY h) <= g{k} AS takes{k}
    FROM (SELECT *, cut_block AND h > c{k} AND size <= g{k} AS fits FROM {before})
), q{k} AS (
    SELECT * EXCLUDE (fits), max(CASE WHEN takes{k} THEN h ELSE c{k} END) OVER cut AS c{next}, g{k} - sum(CASE WHEN takes{k} THEN size ELSE 0 END) OVER cut AS g{next}
    FROM f{k} WINDOW cut AS (PARTITION BY source, cut_block)
)"""

OP3 = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce({_WORDS}, 0)::BIGINT AS size, md5('mix-1/' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS words, greatest(ceil(count(*) / 100000), least(16, ceil(count(*) / 64)))::BIGINT AS blocks FROM d GROUP BY source
), w AS (
    SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM s
), r AS (
    SELECT *, sum(words) OVER () AS all_words,
        sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w, coalesce(sum(words) OVER before, 0) * 3 AS held
    FROM w
    WINDOW before AS (ORDER BY words / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT *, CASE WHEN (all_words - held)::DOUBLE / rest_w * w <= words * 3 THEN (all_words - held)::DOUBLE / rest_w END AS level FROM r
), t AS (
    SELECT source, words, blocks, coalesce(least(w * max(level) OVER (), (words * 3)::DOUBLE), (words * 3)::DOUBLE) AS target FROM l
), p AS (
    SELECT d.*, t.words, t.target, CASE WHEN t.words > 0 THEN least(floor(t.target / t.words), 3)::BIGINT ELSE 0 END AS whole,
        floor(('0x' || substr(h, 1, 8))::BIGINT * blocks / 4294967296.0::DOUBLE)::BIGINT AS block
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
    SELECT *, target - whole * words AS rest, sum(size) OVER (PARTITION BY source, block) AS in_block,
        sum(size) OVER (PARTITION BY source ORDER BY block) - sum(size) OVER (PARTITION BY source, block) AS begins
    FROM p
), c AS (
    SELECT *, rest > 0 AND begins <= rest AND rest < begins + in_block AS cut_block, rest - begins AS g0, '' AS c0 FROM b
){"".join(_ROUND.format(k=k, next=k + 1, before=f"q{k - 1}" if k else "c") for k in range(4))}
SELECT doc_id, size, words AS source_size, target,
    (size * (whole + CASE WHEN takes0 OR takes1 OR takes2 OR takes3 OR (rest > 0 AND NOT cut_block AND begins + in_block <= rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q3
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (
    SELECT doc_id, {_TERMS} AS w FROM documents
), i AS (
    SELECT item_id, {_TERMS} AS w FROM benchmark
), p AS (
    SELECT DISTINCT item_id, list_slice(w, k, k + least(10, len(w)) - 1) AS words, least(10, len(w)) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM p
), g AS (
    SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (
    SELECT g.doc_id, g.k, g.n, p.item_id FROM g JOIN p ON g.words = p.words
), places AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH l AS (
    SELECT doc_id, k, lines[k] AS line, trim({_LOWER.replace("coalesce(text, '')", "lines[k]")}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), f AS (
    SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
    SELECT l.*, f.key IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER t AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW t AS (PARTITION BY coalesce(text, ''))
"""

#: Every order of the filters is applied to every document, one filter after the other.
OP11 = rf"""
WITH marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), d AS (
    SELECT documents.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents LEFT JOIN marks ON documents.doc_id = marks.doc_id
), f AS (
    SELECT part, good, toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
    FROM d
), p AS (
    SELECT fails, part, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY fails, part
), o AS (
    SELECT [a.i, b.i, c.i, d.i, e.i] AS o
    FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
    SELECT o, k, o[k] AS f, list_slice(o, 1, k - 1) AS before FROM o, range(1, 6) s(k)
), r AS (
    SELECT *, fails[f] AS now, len(list_filter(before, lambda x: fails[x])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) AS n_failed FROM steps, p
), s AS (
    SELECT part, o, k, f,
        coalesce(sum(n) FILTER (WHERE NOT now AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE now AND NOT earlier), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE now AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE now AND n_failed = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE now AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE now AND NOT earlier), 0)::BIGINT AS toxic_lost
    FROM r GROUP BY part, o, k, f
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, k::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM s
"""

#: The checksum is worked out byte by byte from its table; near words are told by what is left without one letter.
OP12 = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END)) AS step
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
    SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6
), sums AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
        lambda h, b: xor(h // 256, step[(xor(h, b) % 256 + 1)::INT]))) AS h
    FROM bytes, crc
), v AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)
), near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT less.word, less.n, v.word, v.n FROM less JOIN v ON less.rest = v.word
    UNION SELECT v.word, v.n, less.word, less.n FROM less JOIN v ON less.rest = v.word
), best AS (
    SELECT word, n, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS form FROM near GROUP BY word, n
), f AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN form END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
    FROM v LEFT JOIN best ON v.word = best.word
), chain AS (
    SELECT word, word AS root FROM f
    UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL
), ends AS (
    SELECT chain.word, root FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON f.word = ends.word
"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1, "op3_mixing": OP3, "op5_line_dedup": OP5, "op9_exact_dedup": OP9, "op11_filter_audit": OP11, "op12_spelling_variants": OP12}
