"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobweave.llm import alignment, avi, brown, decontaminate, html_text, licenses, minhash, negatives, packing, quality, reputation, suffix, warc
from jobweave.llm.common import table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.drop("record")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op4_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexity_scores(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.features(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"))


def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (
        op1_warc_derivatives, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_brown_class_lm, op5_best_fit_packing,
        op6_html_main_text, op7_avi_media, op8_license_scan, op9_benchmark_decontamination, op10_compression_quality,
        op11_tokenizer_alignment, op12_host_reputation, op13_hard_negatives, pipeline,
    )
    return {f.__name__: f for f in named}


OP9_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), items AS (SELECT row_number() OVER () AS r, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
words(kind, r, w) AS (
  SELECT 'd', r, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM docs
  UNION ALL
  SELECT 'i', r, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM items),
widths AS (SELECT *, least(5, len(w)) AS width FROM words WHERE kind = 'i' AND len(w) > 0),
places AS (SELECT kind, r, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM widths
  UNION ALL SELECT kind, r, w, k.width, unnest(range(1, len(w) - k.width + 2)) FROM words, (SELECT DISTINCT width FROM widths) k WHERE kind = 'd' AND len(w) >= k.width),
shingles AS (SELECT DISTINCT kind, r, width, array_to_string(w[p:p + width - 1], ' ') AS s FROM places),
sizes AS (SELECT r, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY r),
hits AS (SELECT d.r AS d, i.r AS i, count(*) AS shared FROM shingles d JOIN shingles i ON d.s = i.s AND d.width = i.width AND d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2),
found AS (SELECT d, item_id, max(shared / n) AS containment FROM hits JOIN sizes ON i = sizes.r JOIN items ON i = items.r WHERE 100 * shared >= 80 * n GROUP BY 1, 2),
grouped AS (SELECT d, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(containment) AS containment FROM found GROUP BY d)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(containment, 0.0) AS containment, n_items IS NOT NULL AS contaminated
FROM docs LEFT JOIN grouped ON r = d
"""


def op8_sql() -> str:
    """Lines and whole texts, in windows of each template class that overlap by half, against each template's words."""
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in words)}], {need}, {block})" for _, label, words, need, block in licenses.template_rows())
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())
    cut = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    windows = " UNION ALL ".join(f"SELECT doc, {b} AS block, w, unnest(range(1, greatest(1, len(w) - {b // 2}) + 1, {b // 2})) AS a FROM lines" for b in licenses.BLOCKS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
cut AS (SELECT doc, doc_id, {cut.format("low")} AS w FROM docs),
phrases(phrase, label, k) AS (VALUES {phrases}),
places AS (SELECT doc, w, unnest(range(0, len(w))) AS p FROM cut),
base AS (SELECT doc, label, p FROM places, phrases WHERE array_to_string(w[p + 1:p + k], ' ') = phrase),
templates(label, tw, need, block) AS (VALUES {templates}),
lines AS (SELECT doc, {cut.format("line")} AS w FROM (SELECT doc, unnest(string_split(low, chr(10))) AS line FROM docs) UNION ALL SELECT doc, w FROM cut),
starts AS ({windows}),
blocks AS (SELECT doc, block, w[a:a + block - 1] AS w FROM starts),
met AS (SELECT doc, label, len(list_intersect(tw, w)) / len(tw) AS containment FROM blocks JOIN templates USING (block) WHERE len(list_intersect(tw, w)) >= need),
best AS (SELECT doc, max(containment) AS containment FROM met GROUP BY 1),
labels AS (SELECT doc, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc, label FROM met UNION SELECT doc, label FROM base) GROUP BY 1),
bases AS (SELECT doc, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM base GROUP BY 1),
named AS (SELECT doc, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc, label FROM base) GROUP BY 1)
SELECT c.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS score
FROM cut c LEFT JOIN bases USING (doc) LEFT JOIN named USING (doc) LEFT JOIN labels USING (doc) LEFT JOIN best USING (doc)
"""


def op12_sql() -> str:
    """Counts of hosts, domains and suffixes, each level shrunk to the posterior mean of the one above."""
    r = reputation
    rules = ", ".join(f"('{act}', '{h}', '{p}')" for act, h, p in r.RULES)
    suffixes = ", ".join(f"'{s}'" for s in r.SUFFIXES)
    rho = f"CASE WHEN most = 0 THEN {r.NO_RHO} ELSE least(greatest(CAST(beyond AS DOUBLE) / CAST(most AS DOUBLE), {r.LEAST_RHO}), {r.MOST_RHO}) END"
    moments = "SELECT coalesce(sum(CAST(floor(((k - n * p) * (k - n * p) - n * p * (1 - p)) * 1000000) AS BIGINT)), 0) AS beyond, coalesce(sum(CAST(floor(n * p * (1 - p) * (n - 1) * 1000000) AS BIGINT)), 0) AS most FROM {0} WHERE n > 1"
    level = f"(SELECT *, mean * (1 - mean) / (n + (strength + 1)) + share * share * v AS var FROM (SELECT *, strength / (n + strength) AS share, (k + strength * p) / (n + strength) AS mean FROM {{0}}, (SELECT (1 - rho) / rho AS strength FROM (SELECT CAST({rho} AS DOUBLE) AS rho FROM ({moments})))))"
    tail = "array_to_string(list_slice(parts, greatest(len(parts) - {0} + 1, 1), len(parts)), '.')"
    return f"""
WITH own AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
split AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM own),
outcomes AS (SELECT doc_id, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good, count(*) AS labelled FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k, CAST(coalesce(sum(labelled), 0) AS DOUBLE) AS n FROM split LEFT JOIN outcomes ON page_id = doc_id GROUP BY host),
names AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM counts),
parted AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^[0-9.]*$|^\\[') AS address FROM names),
sized AS (SELECT *, CASE WHEN {tail.format(2)} IN ({suffixes}) THEN 2 ELSE 1 END AS parts_of FROM parted),
hosts AS (SELECT host, k, n, CASE WHEN address THEN name ELSE {tail.format("parts_of")} END AS suffix, CASE WHEN address THEN name ELSE {tail.format("(parts_of + 1)")} END AS domain FROM sized),
domains AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM hosts GROUP BY 1, 2),
total AS (SELECT rate AS p, rate * (1 - rate) / (n + 3) AS v FROM (SELECT (sum(k) + 1) / (sum(n) + 2) AS rate, sum(n) AS n FROM hosts)),
tops AS (SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(p) AS p, any_value(v) AS v FROM domains, total GROUP BY 1),
tops2 AS {level.format("tops")},
domains1 AS (SELECT d.domain, d.suffix, d.k, d.n, t.mean AS p, t.var AS v FROM domains d JOIN tops2 t USING (suffix)),
domains2 AS {level.format("domains1")},
hosts1 AS (SELECT h.host, h.k, h.n, d.mean AS p, d.var AS v FROM hosts h JOIN domains2 d USING (domain, suffix)),
hosts2 AS {level.format("hosts1")},
known AS (SELECT host, CAST(n AS BIGINT) AS n_labelled, mean AS reputation, mean + {r.Z} * sqrt(var) AS upper FROM hosts2),
rules(action, h, p) AS (VALUES {rules}),
fits AS (SELECT DISTINCT s.host, s.path, action, h || p AS rule, length(h || p) AS size FROM (SELECT DISTINCT host, path FROM split) s, rules WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)),
longest AS (SELECT host, path, arg_max(action, size) AS action, arg_max(rule, size) AS rule FROM fits GROUP BY 1, 2)
SELECT page_id, s.host, s.path, rule, coalesce(action, CASE WHEN upper < {r.FLOOR} THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, reputation, upper
FROM split s LEFT JOIN known USING (host) LEFT JOIN longest l ON s.host = l.host AND s.path = l.path
"""


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS a, s.vec_id AS s, a.label = s.label AS same, CAST(list_dot_product(a.q, s.q) AS BIGINT) AS score FROM rows a, rows s WHERE a.vec_id % 100 = 0 AND a.vec_id <> s.vec_id),
positives AS (SELECT a, s AS p, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, s) <= 5)
SELECT a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY a, p ORDER BY n.score DESC, n.s) AS INTEGER) AS rank, n.s AS negative_id, x.score AS positive_score, n.score AS negative_score
FROM positives x JOIN scores n USING (a)
WHERE NOT n.same AND 30 * x.score <= 100 * n.score AND 100 * n.score <= 90 * x.score
QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY n.score DESC, n.s) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": op8_sql(), "op9_benchmark_decontamination": OP9_SQL, "op12_host_reputation": op12_sql(), "op13_hard_negatives": OP13_SQL}
