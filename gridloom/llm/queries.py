"""The corpus operators as registered queries, and DuckDB SQL where it can express their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_scan as licenses
from . import url_filters as urls
from .bpe_codec import bpe_round_trip
from .collocations import LEAST, LONGEST, SHARE, TOP, collocations
from .common import LOWER, UPPER, table
from .fingerprints import fingerprint_edits
from .hmm_lm import hmm_scores
from .ngram_join import ngram_join
from .packing import packing
from .piece_codec import piece_round_trip
from .quality_rules import quality_rules, train
from .source_audit import MIN_DOCS, TERM, TOP_TERMS, UNIT, source_audit
from .suffix_dedup import suffix_dedup
from .token_records import token_records


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"), repeats=True)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filters(table(spark, sf_dir, "pages"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("doc_id", "at")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_license_scan, op2_quality_rules, op3_ngram_join, op4_fingerprints, op5_token_records, op6_url_filters, op7_bpe_codec, op8_suffix_dedup, op9_packing, op10_hmm_lm, op11_source_audit, op12_piece_codec, op13_collocations, pipeline)
    return {f.__name__: f for f in own}


def _values(rows) -> str:
    sql = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


def license_sql() -> str:
    return f"""
WITH posted(template, label, exact, word, t_pos, is_key) AS ({_values(licenses.postings())}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs),
hits AS (SELECT * FROM w WHERE word IN (SELECT word FROM posted)),
df AS (SELECT word, count(DISTINCT rid) AS df FROM hits GROUP BY word),
ranked AS (SELECT p.*, round(ln(((SELECT count(*) FROM docs) + 1) / (coalesce(df, 0) + 1)) + 1, 6) AS idf FROM posted p LEFT JOIN df USING (word)),
post AS (SELECT *, (row_number() OVER (PARTITION BY template ORDER BY idf DESC, word, t_pos) <= {licenses.ANCHORS}) OR exact AS anchor, sum(idf) OVER (PARTITION BY template) AS weight, sum(is_key::INT) OVER (PARTITION BY template) AS n_key FROM ranked),
rare AS (SELECT rid, word FROM (SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY idf DESC, word) AS k FROM (SELECT DISTINCT rid, word FROM hits) JOIN (SELECT DISTINCT word, idf FROM ranked) USING (word)) WHERE k <= {licenses.LOOKUP}),
candidates AS (SELECT DISTINCT rid, template FROM rare JOIN posted USING (word) WHERE NOT exact),
aligned AS (SELECT rid, template, label, exact, pos - t_pos AS start, least(1.0, round(sum(idf) / any_value(weight), 6)) AS share FROM hits JOIN post USING (word)
  WHERE exact OR (rid, template) IN (SELECT (rid, template) FROM candidates)
  GROUP BY rid, template, label, exact, pos - t_pos HAVING bool_or(anchor) AND sum(is_key::INT) = any_value(n_key)),
found AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score, count(*) AS n_aligned
  FROM aligned WHERE share >= {licenses.MIN_COVERAGE} GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_aligned, 0)::BIGINT AS n_aligned FROM docs LEFT JOIN found USING (rid)"""


def url_sql() -> str:
    return f"""
WITH rules(verdict, host, path) AS ({_values(urls.RULES)}),
cut AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT rid, max({{'n': length(r.host || r.path), 'h': length(r.host), 'rule': r.host || r.path, 'verdict': r.verdict}}) AS best FROM u JOIN rules r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY rid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{urls.DEFAULT_VERDICT}') AS verdict FROM u LEFT JOIN fits USING (rid)"""


def audit_sql() -> str:
    p = "1 + ({unit}::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
w AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
whole AS (SELECT lang, term, {p.format(unit=UNIT, n="n", total="total")} AS q FROM kept JOIN langs USING (lang)),
groups AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, count(*) AS n FROM w JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, {p.format(unit=UNIT, n="coalesce(u.n, 0)", total="coalesce(t.total, 0)")} AS p
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""


def collocation_sql() -> str:
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
runs AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM starts, range(1, {LONGEST + 1}) t(k) WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*) AS n FROM runs WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS a, string_split(phrase, ' ') AS w FROM runs GROUP BY lang, phrase, k HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a), cut) AS nth
  FROM cuts c JOIN totals USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[: cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 :], ' ')),
inner_runs AS (SELECT lang, a, w, k AS whole, unnest(range(1, k)) AS i FROM f WHERE k > 2),
around AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS around FROM inner_runs, range(2, {LONGEST}) t(m) WHERE m < whole AND i + m - 1 <= whole GROUP BY ALL),
ranked AS (SELECT s.lang, s.phrase, a, l, r, n, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase WHERE nth = 1 AND (around IS NULL OR 100 * around < {SHARE} * a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op6_url_filters": url_sql(), "op11_source_audit": audit_sql(), "op13_collocations": collocation_sql()}
