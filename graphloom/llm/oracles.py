"""SQL that says what queries of this subpackage return, for DuckDB over the same tables, straight from their contracts.

The rest is beyond SQL: ids of a tokenizer, models, checksums that DuckDB has not, strings of 50 bytes at every place.
"""

from __future__ import annotations

from .line_dedup import MIN_CHARS, MIN_SIGNS, MIN_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All white space, as escapes of RE2.
WHITE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS w FROM {table}"


def grams(rel: str, key: str, size: str) -> str:
    """Every run of so many words, with its place; none where there are fewer."""
    return f"SELECT {key}, {size} AS m, unnest(range(1, len(w) - {size} + 2)) AS i, w FROM {rel} WHERE len(w) >= {size}"


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""WITH it AS ({words("benchmark", "item_id", WORD)}), dw AS ({words("documents", "doc_id", WORD)}),
ig AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM ({grams("it", "item_id", "least(10, len(w))")}) WHERE m > 0),
ms AS (SELECT DISTINCT m FROM ig),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, m, unnest(range(1, (len(w) - m + 2)::BIGINT)) AS i, w FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM dg JOIN ig USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(said, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

NEAR_DOCUMENTS = f"""WITH RECURSIVE dw AS ({words("documents", "doc_id", "[^ \\t-\\r]+")}),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') || ' ' || m AS g FROM ({grams("dw", "doc_id", "least(4, len(w))")}) WHERE m > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b),
root AS (SELECT a, min(b) AS r FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id, least(doc_id, coalesce(r, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.a = doc_id"""

LINES = f"""WITH li AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
f0 AS (SELECT doc_id, i, raw, lower(regexp_replace(regexp_replace(raw, '^[{WHITE}]+', ''), '[{WHITE}]+$', '')) AS form FROM li),
f1 AS (SELECT *, string_split_regex(form, '[{WHITE}]+') AS w FROM f0),
f2 AS (SELECT *, length(form) >= {MIN_CHARS} OR len(w) >= {MIN_WORDS} OR length(regexp_replace(form, '[^{UNSPACED}]', '', 'g')) >= {MIN_SIGNS} AS asked FROM f1),
firsts AS (SELECT form, w, min((doc_id, i)) AS place FROM f2 WHERE asked GROUP BY form, w),
longer AS (SELECT form, w, len(w) AS n, place FROM firsts WHERE len(w) >= {MIN_WORDS}),
spot AS (SELECT form, w, n, place, unnest(range(0, n + 1)) AS k FROM longer),
less AS (SELECT form, place, n::VARCHAR || ' ' || k || ' ' || array_to_string(w[1:k] || w[k + 2:n], ' ') AS key FROM spot WHERE k < n),
more AS (SELECT form, place, (n + 1)::VARCHAR || ' ' || k || ' ' || array_to_string(w, ' ') AS key FROM spot),
gone AS (SELECT y.form FROM less x JOIN less y ON x.key = y.key AND x.place < y.place UNION SELECT CASE WHEN x.place < y.place THEN y.form ELSE x.form END FROM less x JOIN more y ON x.key = y.key),
kept AS (SELECT f2.doc_id, f2.i, f2.raw, NOT f2.asked OR (firsts.place = (f2.doc_id, f2.i) AND f2.form NOT IN (SELECT form FROM gone)) AS stays FROM f2 LEFT JOIN firsts ON firsts.form = f2.form),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS left_text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, left_text AS text FROM documents d LEFT JOIN t USING (doc_id)"""

SQL = {"op4_winnowing_decontamination": DECONTAMINATION, "op5_line_dedup": LINES, "op6_bottom_k_near_documents": NEAR_DOCUMENTS}
