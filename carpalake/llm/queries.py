"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import pack_best_fit
from .common import table
from .decontamination import find_leaks
from .exact_dedup import exact_groups
from .hard_negatives import mine_negatives
from .importance import resample
from .langid import held_out, identify
from .lm_scoring import score_documents
from .packing import pack
from .periodic import collapse_runs
from .simhash import near_groups
from .substring_dedup import remove_repeats
from .toxicity import judge_toxicity
from .url_rules import judge_urls

#: Fixed values of the url rules: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("tag")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def byte_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), held_out())


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), byte_tokenizer())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """documents with the periods that the query of op12 puts into one text in ten: from some word on, the words that follow are repeated."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", (h % 10).alias("part"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    some = some.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) AS int)]), ' ')")
    return some.select("doc_id", F.when((F.col("part") == 0) & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", F.expr("if(strongest IS NULL, NULL, runs[strongest - 1])"))
    lines: Column = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    columns = [F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli")]
    return found.select("doc_id", *columns, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    return mine_negatives(items.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 100 == 0, id_col="vec_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_exact_dedup, op3_simhash, op4_quality, op5_substring_dedup, op6_lm_score, op7_url_filter, op8_toxicity, op9_packing, op10_language, op11_best_fit, op12_periodic_runs, op13_hard_negatives)}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op5_substring_dedup": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        bytes AS (SELECT doc_id, n, h, unnest(range(n)) AS pos FROM docs),
        keyed AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 2) AS pair, CASE WHEN pos <= n - 100 THEN md5(substr(h, 2 * pos + 1, 200)) END AS piece FROM bytes),
        seen AS (SELECT doc_id, pos, pair, piece IS NOT NULL AND row_number() OVER (PARTITION BY piece ORDER BY doc_id, pos) > 1 AS again FROM keyed),
        gone AS (SELECT doc_id, pos, pair, coalesce(max(CASE WHEN again THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) >= pos - 99, false) AS covered FROM seen),
        runs AS (SELECT *, covered AND NOT coalesce(lag(covered) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM gone),
        found AS (SELECT doc_id, count(*) FILTER (covered) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(pair, '' ORDER BY pos) FILTER (NOT covered) AS kept FROM runs GROUP BY doc_id)
        SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "op7_url_filter": r"""
        WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
                 ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        best AS (SELECT p.page_id, p.host, p.path, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS b
                 FROM parts p LEFT JOIN rules r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path)
                 GROUP BY ALL)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best""",
    "op13_hard_negatives": """
        WITH items AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM items a JOIN items b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5""",
}
