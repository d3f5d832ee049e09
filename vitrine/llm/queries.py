"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import chat_format, embedding_join, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_rules, secret_scan, sharding, source_divergence, substring_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_read(spark, sf_dir, "documents"))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_read(spark, sf_dir, "documents"), own=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


_OP3_SQL = """
WITH l AS (SELECT doc_id, source, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, source, whole, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
b AS (SELECT bare FROM k WHERE bare <> '' AND source IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= 8 AND count(DISTINCT whole) >= 8),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.bare IS NOT NULL) AS hit,
             string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.bare IS NULL) AS cut
      FROM k LEFT JOIN b USING (bare) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(hit, 0) AS n_removed, CASE WHEN hit > 0 THEN coalesce(cut, '') ELSE text END AS text
FROM documents LEFT JOIN d USING (doc_id)
"""

#: Target shares of the tokens by domain; the budget keeps the clean domain at its present size.
SHARES = {"clean": 0.97, "low": 0.03, "toxic": 0.0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), SHARES, anchor="clean")
    p = [F.round(F.col("p")[i], 6).alias(f"p_{k}") for i, k in enumerate(SHARES)]
    return rates.select("doc_id", "n_words", *p, F.round("rate", 6).alias("rate"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "rule")


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(_read(spark, sf_dir, "embeddings"))


_OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: host/path rules; the longest that fits decides.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Blocked where no rule fits: a list of hosts, and one page path in each language and domain for every multiple of seven.
URL_HOSTS = ("tionsh.example.net", "m.example.org")
URL_STEP, URL_PAGES = 7, 2000


def url_listed() -> list[str]:
    return [*URL_HOSTS, *(f"example.{d}/{lang}/{URL_STEP * k}" for d in ("com", "net", "org") for lang in ("de", "en", "es", "fr") for k in range(1, URL_PAGES + 1))]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES, url_listed()).drop("listed")


def _op8_sql() -> str:
    rows = [(*url_filter.split_rule(r), v, 1) for r, v in URL_RULES] + [(r, "", "block", 0) for r in URL_HOSTS]
    values = ", ".join(f"('{h}', '{p}', '{v}', {k})" for h, p, v, k in rows)
    return f"""
WITH r(h, p, v, k) AS (VALUES {values} UNION ALL
  SELECT 'example.' || d, '/' || lang || '/' || {URL_STEP} * n, 'block', 0
  FROM unnest(['com', 'net', 'org']) a(d), unnest(['de', 'en', 'es', 'fr']) b(lang), range(1, {URL_PAGES} + 1) c(n)),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT page_id, h || p AS entry, v, k, row_number() OVER (PARTITION BY page_id, k ORDER BY length(h || p) DESC, length(h) DESC) AS n
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, s.host, s.path, a.entry AS rule, coalesce(a.v, b.v, 'allow') AS verdict
FROM s LEFT JOIN m a ON a.page_id = s.page_id AND a.k = 1 AND a.n = 1 LEFT JOIN m b ON b.page_id = s.page_id AND b.k = 0 AND b.n = 1
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard(narrow, 40, "doc_id", ("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


_OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS ln, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS lt
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * v) AS q FROM a JOIN v USING (lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 50
"""


#: A conversation that says the control strings of a template, beside those of the table.
CHAT_ODD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    odd = spark.createDataFrame(CHAT_ODD, "conv_id long, turn long, role string, text string")
    conversations = _read(spark, sf_dir, "conversations").select(odd.columns).unionByName(odd)
    return chat_format.read_back(chat_format.windows(conversations, public_tokenizers.path("word_bpe_49k.json")))


def _repeated(docs: DataFrame) -> DataFrame:
    """One text in ten, by the checksum of its id, goes on from some word with the words from there repeated."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.get(F.transform(F.array(words), again), F.lit(0))  # the words are bound once
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_repeated(_read(spark, sf_dir, "documents")))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    # greatest length, then smallest start and period
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("_b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.s").alias("start"),
        (-F.col("_b.l")).alias("length"),
        F.col("_b.p").alias("period"),
        F.floor(-1000 * F.col("_b.l") / F.col("_b.p")).alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.coalesce("collapsed", F.lit(""))).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_substring_dedup, op2_paragraph_dedup, op3_line_dedup, op4_mixing, op5_quality_rules, op6_embedding_join, op7_packing, op8_url_filter, op9_sharding, op10_secret_scan, op11_source_divergence, op12_chat_format, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3_SQL, "op6_embedding_join": _OP6_SQL, "op8_url_filter": _op8_sql(), "op11_source_divergence": _OP11_SQL}
