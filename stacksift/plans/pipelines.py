"""Queries that need more than one relational plan: graphs, streams, UDFs and greedy steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import components, resolved, shared_folder
from ..operators.recommend import diversified, taste_clusters
from ..sources.records import by_subject, n_triples
from ..streaming import windows as S
from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS component FROM part")
def record_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a key are one group; records and keys are nodes of two kinds."""
    node = lambda kind, id_, name: F.struct(F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"))
    key = node(1, F.col("p_size").cast("long"), F.col("p_brand"))
    found = components(read(spark, sf_dir, "part").select(node(0, F.col("p_partkey"), F.lit("")).alias("a"), key.alias("b")))
    return found.filter("node.kind = 0").select(F.col("node.id").alias("node"), F.col("component.id").alias("component"))


@query("SELECT c_custkey AS old, c_custkey // 16 AS new FROM customer WHERE c_custkey >= 16")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids followed through four aliases, each a halving."""
    customer = read(spark, sf_dir, "customer")
    aliases = customer.select(F.col("c_custkey").alias("old"), F.floor(F.col("c_custkey") / 2).alias("new"))
    live = customer.filter("c_custkey < 0").select(F.col("c_custkey").alias("id"))
    return resolved(aliases, live, 4).filter("old >= 16")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS since, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.tumbling(S.events(spark, f"{sf_dir}/events.parquet")), "update", ["since", "event_type"]).withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("SELECT since, count(*) AS n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS since FROM events UNION ALL SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY FROM events) x GROUP BY since")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.sliding(S.events(spark, f"{sf_dir}/events.parquet")), "update", ["since"]).withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS since, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.sessions(S.events(spark, f"{sf_dir}/events.parquet")), "complete").withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = S.events(spark, f"{sf_dir}/events.parquet")
    return S.drained(S.deduplicated(stream.unionByName(S.events(spark, f"{sf_dir}/events.parquet"))), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS pages FROM events GROUP BY 1, 2")
def stream_daily_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.daily_pages(S.events(spark, f"{sf_dir}/events.parquet")), "update", ["user_id", "day"])


@query("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.rate_limited(S.events(spark, f"{sf_dir}/events.parquet")), "update", ["user_id", "hour"]).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.debounced(S.events(spark, f"{sf_dir}/events.parquet")), "complete")


@query("SELECT DISTINCT ts::DATE AS day FROM events")
def stream_day_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.day_ticks(S.events(spark, f"{sf_dir}/events.parquet")), "append").select(F.to_date("day").alias("day"))


@query("SELECT user_id, arg_min(event_type, struct_pack(t := ts, e := event_id)) AS pack, count(*) AS seen FROM events GROUP BY user_id")
def stream_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.sticky(S.events(spark, f"{sf_dir}/events.parquet")), "update", ["user_id"])


@query("""WITH p AS (SELECT user_id, floor(value)::BIGINT - lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT user_id, coalesce(sum(step) FILTER (step BETWEEN 1 AND 5), 0)::BIGINT AS heard FROM p GROUP BY user_id""")
def stream_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.heard(S.events(spark, f"{sf_dir}/events.parquet")), "update", ["user_id"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, 1::BIGINT AS versions FROM events GROUP BY event_type")
def stream_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, versions = S.live_view(S.events(spark, f"{sf_dir}/events.parquet"), lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))
    return view.withColumn("versions", F.lit(versions).cast("long"))


@query("SELECT event_id, user_id, CASE WHEN user_id % 5 <> 0 THEN 'new ' || user_id END AS name FROM events")
def stream_snapshot_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events looked up in the newest finished snapshot of two."""
    root = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    ids = read(spark, sf_dir, "events").select("user_id").distinct()
    ids.withColumn("name", F.lit("old")).write.parquet(f"{root}/2024-01")
    ids.filter("user_id % 5 <> 0").withColumn("name", F.concat(F.lit("new "), F.col("user_id").cast("string"))).write.parquet(f"{root}/2024-02")
    return S.refreshed(S.events(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id"), root, "user_id")


@query()
def stream_decay_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.decaying(S.events(spark, f"{sf_dir}/events.parquet")), "append")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(replace(replace(text, chr(39), ''), '’', '')), 'ß', 'ss')), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, CAST(flatten([[t[1 + 24 * k : 24 + 24 * k] FOR k IN range((length(t) + 23) // 24)] FOR t IN w]) AS VARCHAR[]) AS tokens FROM w""")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode tokens of whole texts."""
    return read(spark, sf_dir, "documents").select("doc_id", T.udf(T.tokens, "array<string>")("text").alias("tokens"))


@query()
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.udf(T.sentences, "array<struct<at:int,sentence:string>>")("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.at", "s.sentence")


@query()
def dialogue_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.udf(T.dialogue, "array<struct<at:int,kind:string,said:string>>")("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("s")).select("conv_id", "turn", "s.at", "s.kind", "s.said")


@query("""WITH d AS (SELECT p_partkey AS work, p_partkey * 104729 % 1000000000 AS n, p_size FROM part), h AS (SELECT work, n, '978' || lpad(n::VARCHAR, 9, '0') AS s FROM d WHERE p_size % 4 <> 0)
SELECT work, s || (10 - list_sum([substr(s, i, 1)::INT * if(i % 2 = 0, 3, 1) FOR i IN range(1, 13)]) % 10)::INT % 10 AS isbn FROM h""")
def isbn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in three ways, of ten and of thirteen digits, in one form; those with a false check digit go."""
    part = read(spark, sf_dir, "part")
    nine = F.lpad((F.col("p_partkey") * 104729 % 1000000000).cast("string"), 9, "0")
    digit = lambda s, i: F.substring(s, i + 1, 1).cast("int")
    whole = F.concat(F.lit("978"), nine)
    ean = (10 - sum((digit(whole, i) * (3 if i % 2 else 1) for i in range(12)), F.lit(0)) % 10) % 10
    old = (11 - sum((digit(nine, i) * (10 - i) for i in range(9)), F.lit(0)) % 11) % 11
    ten = F.concat(nine, F.when(old == 10, "x").otherwise(old.cast("string")))
    kind = F.col("p_size") % 4
    raw = F.when(kind == 0, F.concat(whole, ((ean + 1) % 10).cast("string"))).when(kind == 1, F.concat(F.lit("ISBN 978-"), nine, F.lit("-"), ean.cast("string"))).when(kind == 2, ten).otherwise(F.concat(whole, ean.cast("string")))
    return part.select(F.col("p_partkey").alias("work"), T.udf(T.isbn13, "string")(raw).alias("isbn")).filter("isbn IS NOT NULL")


@query("""SELECT c_custkey AS id, lower(hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, [ascii(substr(c_name, i, 1))::UHUGEINT FOR i IN range(1, length(c_name) + 1)]), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT)) AS fnv FROM customer""")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of names, in hexadecimal."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.udf(lambda x: format(T.fnv1a64(x.encode()), "X").lower(), "string")("c_name").alias("fnv"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were read as Windows-1252 as they were before; what can't have been stays."""
    spoil = T.udf(lambda x: bytes(x.encode()).decode("cp1252") if all(b not in x.encode() for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else x, "string")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.udf(T.repaired, "string")(spoil("text"))).alias("text"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 1")
def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within one edit: such pairs share the name itself or a spelling with one letter left out; then verified."""
    nation = read(spark, sf_dir, "nation")
    shorter = F.transform(F.sequence(F.lit(1), F.length("n_name")), lambda i: F.concat(F.substring("n_name", F.lit(1), i - 1), F.substring("n_name", i + 1, F.length("n_name"))))
    spelt = nation.select("n_name", "n_nationkey", F.explode(F.array_distinct(F.concat(F.array("n_name"), shorter))).alias("spelling"))
    a, b = spelt.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i"), "spelling"), spelt.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"), "spelling")
    return a.join(b, "spelling").filter("i < j").filter(F.levenshtein("a", "b") <= 1).select("a", "b", "i", "j").distinct().select("a", "b")


@query()
def recommend_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reader: candidates by tag and price, made diverse; readers with the same candidates share one choice."""
    part = read(spark, sf_dir, "part")
    readers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.pmod("c_custkey", F.lit(50)).cast("long").alias("p_size"))
    found = part.select(F.col("p_size").alias("request"), F.col("p_partkey").alias("work"), F.col("p_brand").alias("author"), F.col("p_type").alias("cluster"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"))
    chosen = diversified(found).withColumnRenamed("request", "p_size")
    return chosen.join(readers, "p_size").select("request", "work", "place")


@query()
def taste_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's works clustered by the tags they share."""
    part = read(spark, sf_dir, "part")
    return taste_clusters(part.select(F.pmod("p_partkey", F.lit(64)).alias("request"), F.col("p_partkey").alias("work"), F.col("p_retailprice").alias("weight"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("tags")))


@query("SELECT concat('c/', CAST(c_custkey AS VARCHAR)) AS subject, 2 AS properties FROM customer")
def triples_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written out as lines, read back and grouped by subject."""
    c = read(spark, sf_dir, "customer")
    line = F.explode(F.array(F.concat(F.lit("<c/"), F.col("c_custkey"), F.lit('> <name> "'), F.col("c_name"), F.lit('"@en .')), F.concat(F.lit("<c/"), F.col("c_custkey"), F.lit("> <of> <n/"), F.col("c_nationkey"), F.lit("> ."))))
    return by_subject(n_triples(c.select(line.alias("record")))).select("subject", F.size("properties").alias("properties"))


@query("""WITH v AS (SELECT vec_id, label, CAST(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT * FROM v WHERE vec_id % 20 = 0)
SELECT s.vec_id AS seed, round(max(list_dot_product(s.e, v.e) / (sqrt(list_dot_product(s.e, s.e)) * sqrt(list_dot_product(v.e, v.e)))), 6) AS cosine, count(*) AS compared FROM s JOIN v ON s.label = v.label AND s.vec_id <> v.vec_id GROUP BY 1""")
def embedding_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest vector of a seed's own label, by cosine; every twentieth row is a seed."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.withColumn("norm", F.sqrt(dot("e", "e")))
    s = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("seed"), "label", F.col("e").alias("q"), F.col("norm").alias("q_norm"))
    both = s.join(v, "label").filter(F.col("seed") != F.col("vec_id"))
    return both.groupBy("seed").agg(F.round(F.max(dot("q", "e") / (F.col("q_norm") * F.col("norm"))), 6).alias("cosine"), F.count("*").alias("compared"))
