"""DuckDB SQL for the text operators whose results SQL can express: exact all-pairs forms of the similarity searches."""

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _word_shingles(table: str, key: str, short: bool) -> str:
    few = "[array_to_string(w, ' ')]" if short else "[]"
    return f"""SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN {few}
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS g FROM (SELECT {key}, {WORDS} AS w FROM {table})"""


#: Closure of the links ``e`` over the nodes ``n``; ``roots`` has each node's smallest.
CLOSURE = """e AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
r(id, root) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
roots AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
ds AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g,
              unnest(CASE WHEN len(w) < 5 THEN [] ELSE range(len(w) - 4) END) AS pos FROM d),
q AS ({_word_shingles('benchmark', 'item_id', False)}),
qn AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT doc_id, item_id, count(DISTINCT g) / CAST(n AS DOUBLE) AS containment, count(DISTINCT g) AS shared, n AS item_shingles, min(pos) AS first_shingle
FROM ds JOIN q USING (g) JOIN qn USING (item_id) GROUP BY doc_id, item_id, n HAVING count(DISTINCT g) >= 0.8 * n - 1e-9"""

JACCARD_JOIN = rf"""WITH RECURSIVE n AS (SELECT doc_id AS id FROM documents),
s AS ({_word_shingles('documents', 'doc_id', True)}),
k AS (SELECT doc_id, count(*) AS m, md5(string_agg(g, '|' ORDER BY g)) AS digest FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM p JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE c >= 0.8 * (ka.m + kb.m - c) - 1e-9),
{CLOSURE},
links AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a),
same AS (SELECT doc_id AS id, count(*) OVER (PARTITION BY digest) AS equal_docs FROM k)
SELECT id AS doc_id, root AS class_id, count(*) OVER (PARTITION BY root) AS class_size, coalesce(n_links, 0) AS n_links, coalesce(equal_docs, 1) AS equal_docs
FROM roots LEFT JOIN links USING (id) LEFT JOIN same USING (id)"""

LINE_DEDUP = f"""WITH RECURSIVE o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
oc AS (SELECT * FROM o WHERE regexp_matches(x, '\\S')),
t AS (SELECT row_number() OVER (ORDER BY x) AS id, x FROM (SELECT DISTINCT x FROM oc)),
n AS (SELECT id FROM t),
s AS (SELECT id, unnest(CASE WHEN length(x) < 8 THEN [x] ELSE list_distinct([substr(x, i, 8) for i in range(1, length(x) - 6)]) END) AS g FROM t),
k AS (SELECT id, count(*) AS m FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
linked AS (SELECT a, b FROM p JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b WHERE c >= 0.8 * (ka.m + kb.m - c) - 1e-9),
{CLOSURE},
f AS (SELECT doc_id, line_no, root FROM oc JOIN t USING (x) JOIN roots USING (id)),
first AS (SELECT root, min((doc_id, line_no)) AS spot, count(*) AS class_lines FROM f GROUP BY root)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, spot[1] AS class_doc_id, CAST(spot[2] AS INTEGER) AS class_line_no, class_lines, (doc_id, line_no) = spot AS kept
FROM f JOIN first USING (root)"""

EXACT_DEDUP = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER g = 1 AS kept, text_sha256, CAST(n AS BIGINT) AS n_chars
FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""

#: The remainders of 0 to 15 by the reflected CRC-32 polynomial: crc32 is read four bits at a time.
_CRC = []
for _x in range(16):
    for _ in range(4):
        _x = _x >> 1 ^ (0xEDB88320 if _x & 1 else 0)
    _CRC.append(_x)

_LOWER = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""WITH RECURSIVE o AS (SELECT doc_id, {_LOWER} AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents)),
c AS (SELECT doc_id, r, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM o GROUP BY doc_id, r),
h AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x)), lambda i: CAST(instr('0123456789ABCDEF', substr(x, i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1 AS BIGINT))),
    lambda a, b: xor(a >> 4, {_CRC}[1 + (xor(a, b) & 15)])), 4294967295) AS h FROM c),
m AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.v = b.word),
t AS (SELECT word, count(*) AS n_near, max(other_n) AS other_n FROM p GROUP BY word),
u AS (SELECT word, other_n, min(other) AS other FROM p JOIN t USING (word, other_n) GROUP BY word, other_n),
f AS (SELECT word, n, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM w LEFT JOIN u USING (word)),
j(word, spot, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT j.word, f.form, depth + 1 FROM j JOIN f ON f.word = j.spot WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(spot, depth) AS root FROM j GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM f JOIN e USING (word) LEFT JOIN t USING (word)"""
