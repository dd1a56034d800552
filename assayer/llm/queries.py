"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import (
    centroids, decontamination, exact_dedup, langid, licenses, mixing, perplexity, pii, simhash, toxicity, urls, warc, whitening,
)
from assayer.llm.text import configure
from assayer.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return plan

    return add


@query(
    "op1_exact_dedup",
    """
    WITH hashed AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
         groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM hashed JOIN groups USING (body)
    """,
)
def op1_exact_dedup(t: Tables) -> DataFrame:
    return exact_dedup.owners(t.documents.select("doc_id", "text"), keep="largest")


@query("op2_toxicity")
def op2_toxicity(t: Tables) -> DataFrame:
    network = toxicity.train(t.documents.select("doc_id", "text"), t.labels)
    return toxicity.score(t.documents, network)


def virtual_path(source: Column, doc_id: Column) -> Column:
    """Documents have no paths: they are laid in a tree of their source, 64 files a directory and 64 directories a level."""
    level, folder = F.floor(doc_id / 4096).cast("string"), (F.floor(doc_id / 64) % 64).cast("string")
    return F.concat_ws("/", F.coalesce(source, F.lit("unknown")), level, folder, F.concat(doc_id.cast("string"), F.lit(".txt")))


@query("op3_licenses")
def op3_licenses(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", virtual_path(F.col("source"), F.col("doc_id")).alias("path"), "text")
    return licenses.licences(files)


@query(
    "op4_mixing",
    r"""
    WITH sized AS (
        SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
        FROM sized GROUP BY source),
    weighed AS (
        SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 2 * source_size AS cap FROM sources),
    levels AS (
        SELECT a.place, any_value(a.cap) AS cap, any_value(a.weight) AS weight,
               (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - coalesce(sum(b.cap), 0))
               / ((SELECT sum(weight) FROM weighed) - coalesce(sum(b.weight), 0)) AS level
        FROM weighed a LEFT JOIN weighed b
          ON b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.place < a.place)
        GROUP BY a.place),
    aims AS (
        SELECT source, place, source_size,
               least(cap::DOUBLE, (SELECT max(level) FROM levels WHERE level * weight <= cap) * weight) AS target
        FROM weighed),
    drawn AS (
        SELECT doc_id, name, place, size, ('0x' || md5('mix-1|' || name)[1:15])::BIGINT AS draw,
               ('0x' || md5('mix-1-shard|' || name)[1:15])::BIGINT
               % greatest(1, ceil(source_size / 1048576.0)::BIGINT) AS shard
        FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source WHERE size > 0),
    pieces AS (
        SELECT place, shard, sum(size)::BIGINT AS shard_size, ((sum(size) + 15) // 16)::BIGINT AS blocks
        FROM drawn GROUP BY place, shard),
    source_quotients AS (
        SELECT place, target / (2 * j + 1) AS quotient
        FROM (SELECT place, unnest(range(2 * sum(blocks)::BIGINT)) AS j FROM pieces GROUP BY place) JOIN aims USING (place)),
    source_quotas AS (
        SELECT place, count(*) AS quota
        FROM (SELECT place FROM source_quotients ORDER BY quotient DESC, place
              LIMIT (SELECT round(sum(target) / 16)::BIGINT FROM aims))
        GROUP BY place),
    shard_quotients AS (
        SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size::DOUBLE / (2 * j + 1) DESC, shard) AS n
        FROM (SELECT *, unnest(range(2 * blocks)) AS j FROM pieces)),
    selection AS (
        SELECT place, shard, any_value(blocks) AS blocks, count(*) FILTER (n <= quota) AS quota,
               ('0x' || md5('mix-1-start|' || place || '|' || shard)[1:15])::BIGINT % any_value(blocks) AS start_block
        FROM shard_quotients JOIN pieces USING (place, shard) JOIN source_quotas USING (place) GROUP BY place, shard),
    laid AS (
        SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY draw, name, size ROWS UNBOUNDED PRECEDING) AS stop
        FROM drawn),
    cut AS (
        SELECT doc_id, place, size, stop, stop - size AS start, quota // blocks AS rounds, 16 * start_block AS low,
               16 * (start_block + quota % blocks) AS high, 16 * blocks AS span
        FROM laid JOIN selection USING (place, shard)),
    taken AS (
        SELECT doc_id, place, size,
               rounds * size + greatest(0, least(stop, high) - greatest(start, low))
               + greatest(0, least(stop, high - span) - start) AS taken
        FROM cut
        UNION ALL
        SELECT doc_id, place, size, 0 FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source WHERE size = 0)
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM taken JOIN aims USING (place)
    """,
)
def op4_mixing(t: Tables) -> DataFrame:
    return mixing.mix(t.documents)


@query("op5_pii")
def op5_pii(t: Tables) -> DataFrame:
    return pii.personal_data(t.documents)


@query("op6_decontamination")
def op6_decontamination(t: Tables) -> DataFrame:
    return decontamination.contaminated(t.documents, t.benchmark)


@query("op7_langid")
def op7_langid(t: Tables) -> DataFrame:
    return langid.predict(t.documents, langid.train(t.documents))


@query(
    "op8_warc",
    """
    WITH payloads AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    sized AS (
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM payloads),
    firsts AS (
        SELECT payload_digest, max(page_id) AS original FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN original IS NOT NULL AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> original THEN original END AS refers_to, true AS verified
    FROM sized LEFT JOIN firsts USING (payload_digest)
    """,
)
def op8_warc(t: Tables) -> DataFrame:
    return warc.archived(t.pages)


@query("op9_simhash")
def op9_simhash(t: Tables) -> DataFrame:
    found = simhash.near_duplicates(t.documents)
    printed = F.lpad(F.lower(F.hex("fingerprint")), simhash.BITS // 4, "0")
    return found.select("doc_id", printed.alias("fingerprint"), "component_id")


@query("op10_urls")
def op10_urls(t: Tables) -> DataFrame:
    return urls.judge(t.pages)


def _lloyd_sql(rounds: int) -> str:
    """Assignments and centroids of each round, as common table expressions a0, c1, a1, ..."""

    def assigned(i: int) -> str:
        return f"""a{i} AS (
        SELECT row_no, min(cluster) AS cluster, any_value(distance) AS distance FROM (
            SELECT row_no, cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
            FROM v JOIN c{i} c USING (dim) GROUP BY row_no, cluster
            QUALIFY rank() OVER (PARTITION BY row_no ORDER BY distance) = 1) GROUP BY row_no)"""

    parts = [assigned(0)]
    for i in range(rounds):
        parts.append(f"""c{i + 1} AS (
        SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
            SELECT cluster, dim, ((sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS x
            FROM a{i} JOIN v USING (row_no) GROUP BY cluster, dim) m USING (cluster, dim))""")
        parts.append(assigned(i + 1))
    return ",\n    ".join(parts)


@query(
    "op11_centroids",
    f"""
    WITH kept AS (
        SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    v AS (SELECT row_no, unnest(range(64)) AS dim, unnest(x) AS x FROM kept),
    chosen AS (SELECT * FROM kept ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x LIMIT 16),
    c0 AS (
        SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS cluster,
               unnest(range(64)) AS dim, unnest(x) AS x FROM chosen),
    {_lloyd_sql(3)},
    digests AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY cluster)
    SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
           (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a3 JOIN kept USING (row_no) JOIN digests USING (cluster)
    """,
)
def op11_centroids(t: Tables) -> DataFrame:
    return centroids.clustered(t.embeddings)


@query("op12_whitening")
def op12_whitening(t: Tables) -> DataFrame:
    return whitening.whiten(t.embeddings)


@query("op13_quality")
def op13_quality(t: Tables) -> DataFrame:
    return perplexity.quality(t.documents)
