"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm import chat, countjoin, crosstoken, decontaminate, forest, langid, lexical, mixing, sharding, sketch, substring, tokencount, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply trees (each turn answers the one before), formatted and read back."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    odd = "</s>[INST] ok [/INST]"
    said = said.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = said.withColumn("node", at).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.length("text").cast("double"))
    paths = chat.reply_paths(nodes, "conv_id", "node", "parent", "score", top=1)
    out = chat.format_paths(paths, nodes, "conv_id", "node", "role", "text")
    out = out.withColumn("_turns", chat.parse_turns(F.col("formatted"))).withColumn("_loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    told = F.array_join(F.transform("_turns", lambda z: F.concat(z["role"], F.lit("\n"), z["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
told AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS ex,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS er FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[ROLE]' || er || '[/ROLE]' || ex || '</s>')) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""


def op3_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law of rows: capacities differ by one at most and are all filled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.ring_shards(docs, "doc_id", 8, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rates = mixing.mix_rates(docs, "doc_id", "source", "size")
    return rates.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM totals),
levels AS (
  SELECT *, CAST(sum(size) OVER () - 3 * coalesce(sum(size) OVER (ORDER BY size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed),
one AS (SELECT level FROM levels WHERE level * w <= 3 * CAST(size AS DOUBLE) ORDER BY size / w, source IS NULL, source LIMIT 1),
targets AS (
  SELECT l.source, l.size AS source_size, coalesce(least(3 * CAST(l.size AS DOUBLE), (SELECT level FROM one) * CAST(w AS DOUBLE)), 3 * CAST(l.size AS DOUBLE)) AS target FROM levels l),
rates AS (SELECT *, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS rate FROM targets),
digests AS (
  SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS a,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 9, 8)) AS BIGINT) | 1 AS b FROM sized),
drawn AS (
  SELECT d.doc_id, d.source, d.size, k.seed, r.source_size, r.target, CAST(floor(rate) AS BIGINT) AS whole,
    (a + k.seed * b) % 4294967296 < (rate - floor(rate)) * 4294967296.0 AS hit
  FROM digests d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(64)) AS seed) k),
offs AS (SELECT source, seed, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN hit THEN size ELSE 0 END) - any_value(target)) AS gap FROM drawn GROUP BY source, seed),
best AS (SELECT source, arg_min(seed, (gap, seed)) AS seed FROM offs GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST((d.whole + CASE WHEN hit THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.seed = b.seed
"""


def op8_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return forest.near_duplicates(docs, "doc_id", "text")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) > 1 THEN ws[i] || ' ' || ws[i + 1] ELSE ws[1] END AS s
  FROM w, unnest(range(1, greatest(len(ws), 2))) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM (SELECT doc_id, md5(string_agg(s, chr(1) ORDER BY s)) AS sig FROM sh GROUP BY doc_id)),
reps AS (SELECT s.doc_id, s.s FROM sh s JOIN classes c ON s.doc_id = c.doc_id AND c.rep = c.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
  UNION SELECT rep, doc_id FROM classes WHERE rep <> doc_id),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def op10_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.drop_repeats(docs, "doc_id", "text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM wins) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, unnest(range(50)) AS t(k)),
kept AS (
  SELECT w.doc_id, i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.i = t.i)),
joined AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS x FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM w LEFT JOIN joined j ON w.doc_id = j.doc_id
"""


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest overlap of each document with each benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"))


def learned_language(docs: DataFrame) -> langid.Model | None:
    """A model from the documents whose id's CRC-32 leaves a remainder modulo 5."""
    return langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "doc_id", "text", "lang")


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned_language(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), "text", model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sketch.edited_fingerprints(docs, "doc_id", "text")


def op6_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits: a deletion, an insertion and a new ending."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = tokencount.build_trees(docs, "doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda a, b, x: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(x).alias("replacement"))
    edits = F.array(edit(F.floor(n / 5), F.floor(n / 5) + 7, ""), edit(F.floor(n / 2), F.floor(n / 2), " edited text 42"), edit(n, n + 8, "\nThe end."))
    after = tokencount.apply_edits(trees.withColumn("edits", edits), "doc_id")
    return after.select(
        "doc_id",
        "tokens_before",
        F.col("char_tree")[1].cast("long").alias("n_chars"),
        F.col("token_tree")[1].cast("long").alias("n_tokens"),
        "chars_encoded",
        F.sha2("text", 256).alias("text_sha256"),
    )


def op11_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return countjoin.jaccard_classes(docs, "doc_id", "text").select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) > 3 THEN ws[i:i + 3] ELSE ws END, ' ') AS s
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM (SELECT doc_id, md5(string_agg(s, chr(1) ORDER BY s)) AS sig FROM sh GROUP BY doc_id)),
reps AS (SELECT s.doc_id, s.s FROM sh s JOIN classes c ON s.doc_id = c.doc_id AND c.rep = c.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
  UNION SELECT rep, doc_id FROM classes WHERE rep <> doc_id),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def op12_hybrid_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical.search(docs, "doc_id", "text", items, "item_id", "text")


OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY ALL),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM lens),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM dfs, totals),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN lens USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_consistent_hash_sharding": op3_consistent_hash_sharding,
        "op4_hierarchical_language_id": op4_hierarchical_language_id,
        "op5_scaled_fingerprints": op5_scaled_fingerprints,
        "op6_edit_aware_token_counts": op6_edit_aware_token_counts,
        "op7_url_filters": op7_url_filters,
        "op8_minhash_lsh_forest": op8_minhash_lsh_forest,
        "op9_source_mixing": op9_source_mixing,
        "op10_relative_lz_dedup": op10_relative_lz_dedup,
        "op11_count_vector_join": op11_count_vector_join,
        "op12_hybrid_lexical_search": op12_hybrid_lexical_search,
        "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": OP2_SQL,
        "op7_url_filters": OP7_SQL,
        "op8_minhash_lsh_forest": OP8_SQL,
        "op9_source_mixing": OP9_SQL,
        "op10_relative_lz_dedup": OP10_SQL,
        "op11_count_vector_join": OP11_SQL,
        "op12_hybrid_lexical_search": OP12_SQL,
    }
