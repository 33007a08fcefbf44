"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

from aulario.llm import divergence_rules as rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

COMPONENTS = f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
d AS (SELECT doc_id, {_WORDS.format(text="t")} AS w FROM t),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
      FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b
      WHERE 100 * o.common >= 75 * (x.n + y.n - o.common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(min(r.root) AS BIGINT) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""

REPEATED_WORDS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM p),
m AS (SELECT doc_id, i FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
g AS (SELECT DISTINCT m.doc_id, m.i + k.k AS i FROM m, (SELECT unnest(range(0, 35)) AS k) k),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(u.x, ' ' ORDER BY u.i) AS kept
      FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.i WHERE g.i IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _removed(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _term(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END"
    return f"0.5 * ({part(p)} + {part(q)})"


_BY_CLASS = " + ".join(_term(f"(b.{c} / b.chars)", f"(r.{c} / r.chars)") for c in rules.CLASSES)

RULES = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
v AS (SELECT *, {_WORDS.format(text="t")} AS w FROM t),
x AS (SELECT doc_id, lang, w, len(w) AS n_words, length(t) AS chars, length(array_to_string(w, '')) AS word_chars,
             {_removed("[#*$%&|<>]")} AS symbol, {_removed(r"\p{Lu}")} AS upper,
             {_removed("[0-9]")} AS digit, {_removed(r'''[.,;:!?''"()_/@+=~^{}\[\]-]''')} AS mark,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM v),
b AS (SELECT *, chars - word_chars AS space, word_chars - upper - digit - symbol - mark AS letter,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM x),
p AS (SELECT doc_id, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i, w FROM b WHERE len(w) >= {rules.WINDOW}),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ') AS s FROM p),
m AS (SELECT doc_id, unnest(list(i)) AS i FROM s GROUP BY doc_id, s HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT m.i + k.k) AS n_repeat_words
      FROM m, (SELECT unnest(range(0, {rules.WINDOW})) AS k) k GROUP BY doc_id),
r AS (SELECT lang, {", ".join(f"sum({c}) AS {c}" for c in rules.CLASSES)}, sum(chars) AS chars, sum(n_words) AS n_words FROM b GROUP BY lang),
u AS (SELECT doc_id, lang, lower(x) AS x, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS x FROM b)
      WHERE length(x) <= {rules.COMMON_LENGTH} AND regexp_full_match(lower(x), '[a-zà-ÿ]+') GROUP BY ALL),
a AS (SELECT lang, x, sum(n) AS n FROM u GROUP BY ALL),
q AS (SELECT a.lang, a.x, a.n / r.n_words AS q FROM a JOIN r USING (lang)
      QUALIFY row_number() OVER (PARTITION BY a.lang ORDER BY a.n DESC, a.x) <= {rules.TOP_WORDS}),
k AS (SELECT b.doc_id, sum({_term("(coalesce(u.n, 0) / b.n_words)", "q.q")}) AS d, sum(coalesce(u.n, 0) / b.n_words) AS p, sum(q.q) AS q
      FROM b JOIN q USING (lang) LEFT JOIN u ON u.doc_id = b.doc_id AND u.x = q.x WHERE b.n_words > 0 GROUP BY b.doc_id),
j AS (SELECT b.doc_id, b.n_words, b.word_chars, b.symbol AS n_symbols, b.n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
             CASE WHEN b.chars >= {rules.GUARD_CHARS} THEN sqrt(greatest(0, {_BY_CLASS})) ELSE 0 END AS dc,
             CASE WHEN b.n_words >= {rules.GUARD_WORDS} THEN sqrt(greatest(0, k.d + {_term("greatest(0, 1 - k.p)", "(1 - k.q)")})) ELSE 0 END AS dw,
             b.n_words >= {rules.GUARD_WORDS} AND k.p = 0 AND b.n_words * k.q >= {rules.NONE_EXPECTED} AS without,
             CASE WHEN b.n_words * k.q >= {rules.WORDS_EXPECTED} THEN least({rules.MAX_WORD_DISTANCE},
                  {rules.WORD_PART} * sqrt(greatest(0, 0.5 * k.q + {_term("1.0", "(1 - k.q)")})))
                  ELSE {rules.MAX_WORD_DISTANCE} END AS word_limit
      FROM b JOIN r USING (lang) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dc, 0) <= {rules.MAX_CLASS_DISTANCE} AND coalesce(dw, 0) <= word_limit
       AND NOT coalesce(without, false) AS kept
FROM f
"""

# CRC-32 by its table of 256 entries, over the bytes of "<doc_id>:<run>" (code points up to U+00FF).
_CRC = """list_reduce(list_prepend(4294967295, {bytes}), lambda a, b: xor(a >> 8, k[1 + CAST(xor(a, b) & 255 AS INTEGER)]))"""
_TABLE = (
    "SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), "
    "lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) t(i))"
)
_BYTES = (
    "flatten(list_transform(string_split(concat(doc_id, ':', r), ''), "
    "lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] "
    "ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"
)

VARIANTS = f"""
WITH RECURSIVE k AS ({_TABLE}),
o AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
      WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT r, n, CASE WHEN doc_id IS NOT NULL THEN xor({_CRC.format(bytes=_BYTES)}, 4294967295) END AS h FROM o, k),
d AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) + 2 AS INTEGER))
      ELSE r END AS word FROM h),
w AS (SELECT word, sum(n) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.less
      UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.less),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS m, arg_min(near, (-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.best END AS form,
             CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n FROM w LEFT JOIN b USING (word)),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN e USING (word)
"""

ORACLES: dict[str, str] = {
    "op6_jaccard_join": COMPONENTS,
    "op8_fm_index": REPEATED_WORDS,
    "op10_divergence_rules": RULES,
    "op11_spelling_index": VARIANTS,
}
