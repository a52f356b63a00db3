"""DuckDB SQL for the queries of this package that SQL can express."""

from cxlens.llm.queries import SHARD_BYTES
from cxlens.llm.secrets import ALPHABET, LLR_LIMIT, PSEUDO, RANDOM, STATES, UNIFORM

# Words are split at ASCII white space; a trailing or leading empty piece is no word.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"



def _lower(text: str) -> str:
    """Only A-Z lower-cased."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    """The fields of a document as they go into its leaf."""
    return " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))


def _secrets_sql() -> str:
    """The whole scan, for tables of at most ``TRAIN_DOCS`` texts, all of which are in the ordinary sample; on larger ones the sample is Spark's hash."""
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"""({keyword})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    run = "[A-Za-z0-9+/_=-]"
    kinds = [(0, assign, 2), (1, "AKIA[A-Z0-9]+", 0), (2, "[0-9a-f]{24,}", 0), (3, run + "{16,}", 0), (4, run + "{4,}", 0)]
    found = "\n    UNION ALL\n    ".join(
        f"SELECT r, {no} AS no, regexp_split_to_array(t, '{p}') AS b, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS v FROM d" for no, p, g in kinds)

    def moves(name, values):
        chars = f"list_filter(list_transform(string_split(value, ''), lambda c: instr('{ALPHABET}', c)), lambda s: s > 0)"
        return f"""{name} AS (
    SELECT value, unnest(list_transform(range(len(s)), lambda i: CASE WHEN i = 0 THEN 0 ELSE s[i] END * {STATES} + s[i + 1])) AS id
    FROM (SELECT value, {chars} AS s FROM (SELECT DISTINCT value FROM {values})))"""

    size = STATES - 1
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
spans AS (
    SELECT r, no, start, start + length(hit) AS stop, value
    FROM (SELECT r, no, v[k + 1] AS value, m[k + 1] AS hit,
                 (coalesce(list_sum(list_transform(b[1:k + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0))::BIGINT AS start
          FROM (SELECT *, unnest(range(len(m))) AS k FROM found))),
base AS (SELECT * FROM spans WHERE length(value) >= CASE no WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END AND no < 3),
beside AS (SELECT * FROM spans s WHERE no >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND s.start < b.stop AND b.start < s.stop)),
cands AS (SELECT * FROM beside WHERE no = 3),
words AS (SELECT * FROM beside WHERE no = 4 AND (length(value) <= 15 OR regexp_full_match(value, '[0-9+-]+'))),
{moves("random", "base")},
{moves("ordinary", "words")},
{moves("tried", "cands")},
counts AS (
    SELECT id, coalesce(r, 0) AS r, coalesce(o, 0) AS o, sum(coalesce(r, 0)) OVER w AS rs, sum(coalesce(o, 0)) OVER w AS os
    FROM range({STATES * STATES}) c(id) LEFT JOIN (SELECT id, count(*) AS r FROM random GROUP BY id) USING (id)
    LEFT JOIN (SELECT id, count(*) AS o FROM ordinary GROUP BY id) USING (id) WINDOW w AS (PARTITION BY id // {STATES})),
model AS (
    SELECT id, ln(({UNIFORM} / {size} + {1 - UNIFORM} * CASE WHEN rs > 0 THEN r::DOUBLE / rs::DOUBLE ELSE 1.0 / {size} END)
                  / ((o + {PSEUDO})::DOUBLE / (os + {PSEUDO} * {size})::DOUBLE)) AS x FROM counts),
keys AS (SELECT value FROM tried JOIN model USING (id) GROUP BY value HAVING sum(x) >= {LLR_LIMIT}),
kept AS (SELECT r, no, start, stop FROM base UNION ALL SELECT r, no, start, stop FROM cands WHERE value IN (SELECT value FROM keys)),
named AS (SELECT r, no, start, ['assign', 'access', 'hex', '{RANDOM}'][no + 1] || ':' || start || ':' || stop AS span FROM kept)
SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, no) FILTER (WHERE no < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, no), '') AS spans
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id"""


ORACLES = {
    "op4_extendible_sharding": f"""
WITH k AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
    FROM documents),
prefixes AS (
    SELECT d, key >> (60 - d) AS p, sum(n_bytes)::BIGINT AS bytes, count(*) AS docs
    FROM k, range(0, 25) AS r(d) GROUP BY ALL),
leaf AS (
    SELECT k.doc_id, arg_min(struct_pack(d := d, p := p, bytes := bytes, docs := docs), d) AS l
    FROM k JOIN prefixes x ON x.p = k.key >> (60 - x.d)
    WHERE bytes <= {SHARD_BYTES} OR docs = 1 GROUP BY k.doc_id)
SELECT doc_id, n_bytes, CASE WHEN l.d = 0 THEN '' ELSE right(bin(l.p + (1::BIGINT << l.d)), l.d::INTEGER) END AS shard,
       l.d::INTEGER AS depth, l.docs AS shard_docs, l.bytes AS shard_bytes, l.bytes > {SHARD_BYTES} AS oversize
FROM k JOIN leaf USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY payload_digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest""",
    "op9_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
           FROM documents),
tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) AS r(k) GROUP BY doc_id),
m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(lines) AS n_lines
    FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars > 14 * n_words) AS kept
FROM m""",
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE fixed AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, text,
           sha256({_leaf('text')}) AS leaf,
           coalesce(crc % 5 = 0, false) AS hit,
           sha256({_leaf(_lower('text'))}) AS changed
    FROM (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
              lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) AS crc
          FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM fixed),
inner_nodes AS (
    SELECT 0 AS lvl, g, i, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lvl + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM inner_nodes WHERE n > 1 GROUP BY lvl, g, i // 16, n),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes AS (
    SELECT 0 AS lvl, i, n, h FROM subroots
    UNION ALL
    SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM outer_nodes WHERE n > 1 GROUP BY lvl, i // 16, n),
beside AS (
    SELECT lvl, g, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
           coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
    FROM (SELECT lvl, g, i, n, h FROM inner_nodes UNION ALL SELECT 1000 + lvl, NULL, i, n, h FROM outer_nodes) WHERE n > 1
    WINDOW w AS (PARTITION BY lvl, g, i // 16 ORDER BY i)),
low_walk AS (
    SELECT g AS of, i AS leaf_i, 0 AS lvl, i, n, '' AS proof, CASE WHEN hit THEN changed ELSE leaf END AS h FROM leaves
    UNION ALL
    SELECT w.of, leaf_i, w.lvl + 1, w.i // 16, (n + 15) // 16, proof || a || b, sha256(a || h || b)
    FROM low_walk w JOIN beside s ON s.lvl = w.lvl AND s.g = w.of AND s.i = w.i WHERE n > 1),
high_walk AS (
    SELECT w.of, leaf_i, 1000 AS lvl, s.i, s.n, proof, w.h FROM low_walk w JOIN subroots s ON s.g = w.of WHERE w.n = 1
    UNION ALL
    SELECT w.of, leaf_i, w.lvl + 1, w.i // 16, (n + 15) // 16, proof || a || b, sha256(a || h || b)
    FROM high_walk w JOIN beside s ON s.lvl = w.lvl AND s.g IS NULL AND s.i = w.i WHERE n > 1)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves l JOIN high_walk w ON w.of = l.g AND w.leaf_i = l.i AND w.n = 1 JOIN subroots s ON s.g = l.g, (SELECT h FROM outer_nodes WHERE n = 1) r""",
    "op13_secret_scan": _secrets_sql(),
}
