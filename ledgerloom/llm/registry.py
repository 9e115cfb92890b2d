"""The corpus queries, each over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import line_templates, spaced_seeds
from ledgerloom.llm.block_labeller import extract_main_text
from ledgerloom.llm.credential_automata import scan_secrets
from ledgerloom.llm.dual_tree import ranked_search
from ledgerloom.llm.hilbert_packing import pack_along_curve
from ledgerloom.llm.hyperminhash import near_duplicates
from ledgerloom.llm.kneser_ney import quality_rules
from ledgerloom.llm.language_backoff import identify_language
from ledgerloom.llm.line_templates import drop_recurring_lines
from ledgerloom.llm.phrase_quicksort import collocations
from ledgerloom.llm.prefix_forest import nearest
from ledgerloom.llm.pseudonyms import pseudonymize
from ledgerloom.llm.spaced_seeds import decontaminate
from ledgerloom.llm.suffix_tree import suffix_tree_scores
from ledgerloom.llm.tables import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_main_text, op2_near_duplicates, op3_pseudonyms, op4_decontamination, op5_suffix_tree, op6_quality_rules,
        op7_line_templates, op8_secrets, op9_curve_packing, op10_language, op11_ranked_search, op12_collocations,
        op13_nearest_neighbours)
}
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_MASKS = ", ".join(f"({k}, {list(mask)})" for k, mask in enumerate(spaced_seeds.MASKS))
_SPAN, _REACH = spaced_seeds.SPAN, spaced_seeds.REACH

#: Written from the definitions: strings instead of hashes, loops over places instead of slices.
SQL: dict[str, str] = {
    "op4_decontamination": f"""
        WITH masks(m, places) AS (VALUES {_MASKS}),
        docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        doc_seeds AS (SELECT doc_id, pos, m, array_to_string(list_transform(places, lambda k: w[pos + k + 1]), ' ') AS seed
            FROM (SELECT *, unnest(range(0, len(w) - {_SPAN - 1})) AS pos FROM docs WHERE len(w) >= {_SPAN}), masks),
        item_seeds AS (SELECT item_id, pos, m, array_to_string(list_transform(places, lambda k: w[pos + k + 1]), ' ') AS seed
            FROM (SELECT *, unnest(range(0, len(w) - {_SPAN - 1})) AS pos FROM items WHERE len(w) >= {_SPAN}), masks),
        hits AS (SELECT DISTINCT d.doc_id, b.item_id, d.pos AS i, b.pos AS j FROM doc_seeds d JOIN item_seeds b ON b.m = d.m AND b.seed = d.seed),
        rated AS (SELECT h.doc_id, h.item_id, len(b.w) AS size, list_sum(list_transform(
                range(-least(i, j, {_REACH}), least(len(d.w) - i, len(b.w) - j, {_SPAN + _REACH})),
                lambda k: CASE WHEN d.w[i + k + 1] = b.w[j + k + 1] THEN 1 ELSE 0 END)) AS equal
            FROM hits h JOIN docs d ON d.doc_id = h.doc_id JOIN items b ON b.item_id = h.item_id),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(equal) AS most_equal FROM rated
            WHERE equal >= CASE WHEN size < {spaced_seeds.SHORT_WORDS} THEN ceil(size * {spaced_seeds.SHORT_SHARE}) ELSE {spaced_seeds.MIN_EQUAL} END GROUP BY 1)
        SELECT d.doc_id, coalesce(n_items, 0) AS n_items, CAST(coalesce(most_equal, 0) AS BIGINT) AS most_equal, n_items IS NOT NULL AS contaminated
        FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "op7_line_templates": f"""
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        masked AS (SELECT doc_id, num, list_transform(list_filter(string_split_regex(lines[num + 1], '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''),
                lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{line_templates.FIELD}' ELSE w END) AS w
            FROM (SELECT *, unnest(range(0, len(lines))) AS num FROM split)),
        placed AS (SELECT *, len(w) || '|' || array_to_string(w[1:{line_templates.LEADING}], chr(31)) AS leaf, array_to_string(w, ' ') AS line
            FROM masked WHERE len(w) >= {line_templates.MIN_WORDS}),
        mixed AS (SELECT leaf FROM placed GROUP BY 1 HAVING count(DISTINCT line) > 1 AND count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}),
        words AS (SELECT leaf, doc_id, num, place, w[place] AS word
            FROM (SELECT p.*, unnest(range(1, len(w) + 1)) AS place FROM placed p JOIN mixed m ON m.leaf = p.leaf)),
        modes AS (SELECT leaf, place, first(word ORDER BY n DESC, word) AS mode
            FROM (SELECT leaf, place, word, count(*) AS n FROM words GROUP BY 1, 2, 3) GROUP BY 1, 2),
        near AS (SELECT x.leaf, doc_id, num FROM words x JOIN modes m ON m.leaf = x.leaf AND m.place = x.place
            GROUP BY 1, 2, 3 HAVING avg(CASE WHEN word = mode THEN 1.0::DOUBLE ELSE 0 END) >= {line_templates.SIMILAR}),
        general AS (SELECT * FROM near WHERE leaf IN (SELECT leaf FROM near GROUP BY 1 HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS})),
        same AS (SELECT doc_id, num, line FROM placed
            WHERE line IN (SELECT line FROM placed GROUP BY 1 HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS})
              AND (doc_id, num) NOT IN (SELECT (doc_id, num) FROM general)),
        recurring AS (SELECT 'leaf' AS kind, leaf AS template, doc_id, num FROM general UNION ALL SELECT 'line', line, doc_id, num FROM same),
        gone AS (SELECT doc_id, list(num) AS nos FROM (
                SELECT *, row_number() OVER (PARTITION BY kind, template ORDER BY doc_id, num) AS rn FROM recurring) WHERE rn > 1 GROUP BY 1)
        SELECT s.doc_id, CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_transform(
                   list_filter(range(0, len(lines)), lambda k: NOT list_contains(nos, k)), lambda k: lines[k + 1]), chr(10)) END AS text,
               CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(nos), 0) AS BIGINT) AS n_dropped
        FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id""",
    "op11_ranked_search": """
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
        items AS (SELECT row_number() OVER () AS i, item_id, list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        whole AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM docs WHERE len(w) > 0),
        asked AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM items) GROUP BY 1, 2),
        held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
            FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), whole),
        scores AS (SELECT i, h.r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * big_n) // big_l)))) AS BIGINT) AS score
            FROM held h JOIN asked a ON a.term = h.term JOIN weights g ON g.term = h.term JOIN docs d ON d.r = h.r, whole GROUP BY 1, 2),
        ranked AS (SELECT i, s.r, score, doc_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, s.r) AS rank
            FROM scores s JOIN docs d ON d.r = s.r WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items ON items.i = ranked.i WHERE rank <= 20""",
    "op12_collocations": """
        WITH pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
                SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
        split AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
        runs AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
                SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest(range(1, 6)) AS k FROM split))),
        totals AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY 1),
        counts AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (SELECT lang, phrase, k AS size, w, f AS a, unnest(range(1, k)) AS k FROM counts WHERE k > 1),
        rated AS (SELECT c.lang, c.phrase, c.size, c.w, a, c.k, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
        lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_parts AS (SELECT lang, a, w, size, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM lowest WHERE size > 2)),
        covers AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_parts GROUP BY 1, 2),
        kept AS (SELECT l.* FROM lowest l LEFT JOIN covers c ON c.lang = l.lang AND c.phrase = l.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
}
