"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbel.llm import exact_dedup, hash_forest, language_id, license_scan, mixing, packing, periodic_runs, prefix_trie, quality_model, quality_rules, sharding, simhash, tokens
from umbel.llm.store import keyed_lookup, numbered, settle, words_column
from umbel.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(id_col: str, n: int):
    """crc32 of an id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of the built-in templates in ``documents``."""
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("row_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("row_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text; two batches, larger ids first, go through one index."""
    index = exact_dedup.new_index(ship(spark))
    decided = exact_dedup.decide(_table(spark, sf_dir, "documents"), index, parts=2).drop("row_id")
    index.close()  # decisions are settled; this run keeps no index
    return decided


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; texts that stand in several sources are offered by all of them."""
    mixed = settle(mixing.mix(_table(spark, sf_dir, "documents"), F.col("source"), mixing.cycling), "mix")
    sizes = settle(mixed.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    return keyed_lookup(mixed, sizes, ["source"], "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that learned from the other folds' labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels, _remainder("doc_id", 5) != 0)
    return quality_model.score(docs, model).select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document in 8 shards whose counts are at most one apart."""
    docs, rid = numbered(_table(spark, sf_dir, "documents"))
    docs = docs.select(rid, "doc_id", "text", sharding.text_bytes(F.col("text")).alias("size"), sharding.text_crc(F.col("text")).alias("text_crc32"))
    placed = sharding.shuffled(docs, 8, ["doc_id", "size", "text_crc32"], row_id=rid)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of ``documents`` with what each of its lengths gives as a context limit."""
    hist = settle(tokens.histogram(tokens.lengths(_table(spark, sf_dir, "documents"))), "lengths")
    return tokens.length_report(hist)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network that learned from the other folds' languages."""
    docs = _table(spark, sf_dir, "documents")
    net = language_id.train(docs, _remainder("doc_id", 4) != 2)
    return language_id.identify(docs, net).select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` in which, for each tenth crc32 of an id, the words from one place on repeat the first of them in turn."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words, g, n = F.col("__words"), F.floor(h / 10), F.size("__words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int")
    i = F.sequence(F.lit(0), n - 1)
    shifted = F.transform(i, lambda x: F.get(words, F.when(x < F.col("__a"), x).otherwise(F.col("__a") + (x - F.col("__a")) % F.col("__p"))))
    chosen = docs.where(h % 10 == 0).withColumn("__words", words_column(F.col("text"))).withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p))
    changed = chosen.withColumn("text", F.when(n > 0, F.array_join(shifted, " ")).otherwise(F.col("text"))).drop("__words", "__a", "__p")
    return docs.where(h % 10 != 0).unionByName(changed)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated word sequences of every document, in a tenth of which repeats are laid in, and the text without them."""
    found = periodic_runs.find_runs(with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the greatest exponent as an exact fraction; of equal ones the first
    better = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.transform("runs", lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]))
    found = found.withColumn("best", best)
    start, length, period = (F.col(f"best.{c}").alias(c) for c in ("start", "length", "period"))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start, length, period,
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row of ``embeddings`` whose id is divisible by 20."""
    return hash_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each of which begins with turns of the first of its five."""
    c = F.col("conv_id")
    seqs = settle(prefix_trie.sequences(_table(spark, sf_dir, "conversations")), "turns")
    rebuilt = prefix_trie.grafted(seqs, c - c % 5, (F.crc32(c.cast("string").cast("binary")) % 9).cast("int"))
    return prefix_trie.trie(rebuilt).drop("node_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline; its module stands at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_quality_rules, op3_exact_dedup, op4_source_mix, op5_quality_classifier, op6_sharding, op7_token_counts,
            op8_language_id, op9_simhash, op10_best_fit_packing,
            op11_periodic_runs, op12_hash_forest, op13_prefix_trie, pipeline,
        )
    }


def _sql_bucket(value: str) -> str:
    gamma = (1 + quality_rules.ALPHA) / (1 - quality_rules.ALPHA)
    return f"CASE WHEN {value} < 1 THEN 0 ELSE CAST(ceil(ln({value}) / {math.log(gamma)!r} - 1e-9) AS INT) + 1 END"


def _sql_quality() -> str:
    gamma = (1 + quality_rules.ALPHA) / (1 - quality_rules.ALPHA)
    blank = r"[\x20\x09-\x0D]+"
    parts = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "word_length": "word_chars"}
    value = {m: f"CASE WHEN n_words > 0 THEN 1000.0::DOUBLE * {c} / n_words ELSE 0.0::DOUBLE END" for m, c in parts.items()}
    length = quality_rules.LENGTH
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_sql_bucket(v)} AS bucket FROM counted WHERE NOT base_failed" for m, v in [*value.items(), (length, "n_words::DOUBLE")])
    upper = " ".join(f"WHEN '{m}' THEN {u}::DOUBLE" for m, u in [*((m, x[0]) for m, x in quality_rules.METRICS.items()), (length, 0.5)])
    lower = " ".join(f"WHEN '{m}' THEN {1 - u!r}::DOUBLE" for m, u in [*((m, x[0]) for m, x in quality_rules.METRICS.items()), (length, 0.5)])
    units = " ".join(f"WHEN '{m}' THEN {1000.0 * n}::DOUBLE" for m, (_, n, _) in quality_rules.METRICS.items())
    center = f"CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE 2 * pow({gamma!r}::DOUBLE, bucket - 1) / {gamma + 1!r}::DOUBLE END"
    shrink = lambda own, rest: f"(({own}.total::DOUBLE) * {own}.%s + {quality_rules.SHRINK} * {rest}) / ({own}.total::DOUBLE + {quality_rules.SHRINK})"
    chosen = ", ".join(f"{shrink('a', '(' + shrink('b', 'c.' + x) + ')').replace('%s', x)} AS {x}" for x in ("high", "low"))
    bad = " OR ".join(
        [f"({value[m]}) > (SELECT high FROM chosen c WHERE c.lang IS NOT DISTINCT FROM d.lang AND c.source IS NOT DISTINCT FROM d.source AND c.metric = '{m}')" for m in parts]
        + [f"({value[m]}) < (SELECT low FROM chosen c WHERE c.lang IS NOT DISTINCT FROM d.lang AND c.source IS NOT DISTINCT FROM d.source AND c.metric = '{m}')" for m, (_, _, low) in quality_rules.METRICS.items() if low]
    )
    return rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM split WHERE len(w) > 2),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM grams JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
counted0 AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{blank}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
counted AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted0),
long AS ({long}),
sketch AS (
  SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM long GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM long GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM long GROUP BY metric, bucket),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM sketch),
tails AS (
  SELECT level, lang, source, metric, any_value(total) AS total,
         min(CASE WHEN seen >= greatest(1, ceil((CASE metric {upper} END) * total)) THEN bucket END) AS bu, min(CASE WHEN seen >= greatest(1, ceil((CASE metric {lower} END) * total)) THEN bucket END) AS bl
  FROM run GROUP BY level, lang, source, metric),
q AS (SELECT level, lang, source, metric, total, {center.replace('bucket', 'bu')} AS u, {center.replace('bucket', 'bl')} AS l FROM tails),
spread AS (
  SELECT q.*, greatest(q.u - q.l, (CASE q.metric {units} END) / w.u) AS d FROM q JOIN q w
  ON w.metric = '{length}' AND q.metric <> '{length}' AND w.level = q.level AND w.lang IS NOT DISTINCT FROM q.lang AND w.source IS NOT DISTINCT FROM q.source),
fence AS (SELECT *, u + {quality_rules.FENCE} * d AS high, l - {quality_rules.FENCE} * d AS low FROM spread),
chosen AS (
  SELECT a.lang, a.source, a.metric, {chosen}
  FROM fence a JOIN fence b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM a.lang AND b.metric = a.metric JOIN fence c ON c.level = 2 AND c.metric = a.metric
  WHERE a.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce({bad}, false)) AS kept FROM counted d
"""


SQL = {
    "op3_exact_dedup": """
WITH g AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM g GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g JOIN k USING (t)
""",
}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _sql_quality()} | SQL
