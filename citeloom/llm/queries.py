"""The registered queries of this folder: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import langid, linededup, media, neardup, packing, pii, sentencepieces, sharding, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, is_query=vectors["vec_id"] % topk.QUERY_EVERY == 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.piece_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_media": op1_media,
    "op2_sharding": op2_sharding,
    "op3_pieces": op3_pieces,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_lines": op8_lines,
    "op9_topk": op9_topk,
    "op10_minmax": op10_minmax,
}

#: One layer of the dynamic programme over bucket boundaries: the least padding of the i shortest lengths in k buckets, and the last cut.
_LAYER = """
        ), l{k} AS MATERIALIZED (
            SELECT {k} AS k, e.i, min({{'cost': b.cost + e.len * (e.size - c.size) - (e.mass - c.mass), 'cut': b.i}}) AS m
            FROM p e JOIN b{j} b ON b.i < e.i JOIN p c ON c.i = b.i GROUP BY e.i
        ), b{k} AS MATERIALIZED (
            SELECT i, m.cost AS cost FROM l{k} UNION ALL SELECT 0, 0"""

ORACLE_SQL: dict[str, str] = {
    "op5_packing": r"""
        WITH RECURSIVE n AS (
            SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents
        ), h AS (
            SELECT n AS len, count(*) AS c FROM n WHERE n <= 16384 GROUP BY n
        ), p AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY len) AS i, len, CAST(sum(c) OVER (ORDER BY len) AS BIGINT) AS size, CAST(sum(c * len) OVER (ORDER BY len) AS BIGINT) AS mass FROM h
            UNION ALL SELECT 0, 0, 0, 0
        ), b0 AS (
            SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cost""" + "".join(_LAYER.format(k=k, j=k - 1) for k in range(1, 9)) + r"""
        ), layers AS (
            """ + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, 9)) + r"""
        ), top AS (
            SELECT k, i FROM layers WHERE i = (SELECT max(i) FROM p) ORDER BY m.cost, k LIMIT 1
        ), walk(k, i) AS (
            SELECT k, i FROM top UNION ALL SELECT w.k - 1, l.m.cut FROM walk w JOIN layers l ON l.k = w.k AND l.i = w.i WHERE l.m.cut > 0
        ), ends AS (
            SELECT coalesce(list(p.len ORDER BY p.len), []) AS ends FROM walk JOIN p ON p.i = walk.i
        ), r AS (
            SELECT doc_id, n, n > 16384 AS over, CASE WHEN n > 16384 THEN len(ends) ELSE len(list_filter(ends, lambda e: e < n)) END AS bucket, ends FROM n, ends
        ), s AS (
            SELECT *, CASE WHEN over THEN n ELSE ends[bucket + 1] END AS bucket_length,
                   row_number() OVER (PARTITION BY bucket ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 2), doc_id, n) - 1 AS rank FROM r
        ), f AS (
            SELECT *, greatest(1, 16384 // greatest(1, bucket_length)) AS fit FROM s
        )
        SELECT doc_id, n AS n_tokens, CAST(bucket AS INT) AS bucket, bucket_length, rank // fit AS batch, rank % fit AS slot, bucket_length - n AS padding, over AS over_budget FROM f
    """,
    "op8_lines": r"""
        WITH l AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), e AS (
            SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS value FROM l
        ), f AS (
            SELECT value, min({'doc': doc_id, 'line': line}) AS place FROM e WHERE length(trim(value, ' ')) > 0 GROUP BY value
        ), near AS (
            SELECT DISTINCT a.value FROM f a JOIN f b ON b.place < a.place AND length(b.value) BETWEEN length(a.value) - 1 AND length(a.value) + 1
                AND (left(a.value, greatest(0, length(a.value) // 2 - 1)) = left(b.value, greatest(0, length(a.value) // 2 - 1)) OR right(a.value, greatest(0, length(a.value) // 2 - 1)) = right(b.value, greatest(0, length(a.value) // 2 - 1)))
            WHERE levenshtein(a.value, b.value) <= 4 -- of bytes: a character has four at most
                AND len(list_filter(range(greatest(length(a.value), length(b.value))), lambda i: left(a.value, i) = left(b.value, i)
                    AND substr(a.value, CAST(i + 1 + (length(a.value) >= length(b.value))::INT AS BIGINT)) = substr(b.value, CAST(i + 1 + (length(b.value) >= length(a.value))::INT AS BIGINT)))) > 0
        ), k AS (
            SELECT e.*, f.value IS NULL OR (f.place = {'doc': e.doc_id, 'line': e.line} AND n.value IS NULL) AS stays
            FROM e LEFT JOIN f ON f.value = e.value LEFT JOIN near n ON n.value = e.value
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_gone,
               sha256(coalesce(string_agg(value, chr(10) ORDER BY line) FILTER (WHERE stays), '')) AS text_sha256
        FROM k GROUP BY doc_id
    """,
    "op10_minmax": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s
            FROM w
        ), n AS (
            SELECT w.doc_id, count(s.s) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
        ), i AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
        ), e AS (
            SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b
            WHERE 100 * i.i >= 85 * (x.n_shingles + y.n_shingles - i.i)
        ), u AS (
            SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), r(doc_id, seen) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen
        )
        SELECT n.doc_id, n.n_shingles, min(r.seen) AS component_id, min(r.seen) = n.doc_id AS kept
        FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
    """,
    "op2_sharding": """
        WITH k AS (  -- the table of CRC-32, by its polynomial
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda j: CAST(j AS BIGINT))),
                lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS k
        ), d AS (
            SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS g, coalesce(text, '') AS t FROM documents
        ), g AS (
            SELECT g, sum(size) AS bytes FROM d GROUP BY g
        ), p AS (
            SELECT g, bytes, CAST(sum(bytes) OVER (ORDER BY g) AS BIGINT) AS e FROM g
        ), a AS (
            SELECT list(e ORDER BY e) AS ends, max(e) AS total, CAST(max(bytes) AS BIGINT) AS most, (max(e) + 15) // 16 AS mean FROM p
        ), c AS (
            SELECT ends, total, list_reduce(
                list_prepend({'lo': greatest(mean, most), 'hi': mean + most}, list_transform(range(48), lambda i: {'lo': CAST(i AS BIGINT), 'hi': CAST(i AS BIGINT)})),
                lambda s, i: CASE WHEN s.lo >= s.hi THEN s
                    WHEN list_reduce(list_prepend(CAST(0 AS BIGINT), range(16)), lambda pos, k: coalesce(list_max(list_filter(ends, lambda e: e <= pos + (s.lo + s.hi) // 2)), 0)) >= total
                    THEN {'lo': s.lo, 'hi': (s.lo + s.hi) // 2} ELSE {'lo': (s.lo + s.hi) // 2 + 1, 'hi': s.hi} END).hi AS cap
            FROM a
        ), n AS (
            SELECT *, list_transform(range(16), lambda j: list_reduce(list_prepend(total, range(j)),
                lambda pos, k: CASE WHEN pos - cap <= 0 THEN 0 ELSE list_min(list_filter(ends, lambda e: e >= pos - cap)) END)) AS needed
            FROM c
        ), s AS (
            SELECT list_transform(range(1, 16), lambda j: list_reduce(list_prepend(CAST(0 AS BIGINT), range(1, j + 1)), lambda pos, k: greatest(needed[17 - k], least(
                coalesce(list_max(list_filter(ends, lambda e: e <= pos + cap)), 0),
                CASE WHEN coalesce(list_max(list_filter(ends, lambda e: e <= pos + (total - pos + 16 - k) // (17 - k))), 0) <= pos
                     THEN list_min(list_filter(ends, lambda e: e >= least(pos + 1, total)))
                     ELSE list_max(list_filter(ends, lambda e: e <= pos + (total - pos + 16 - k) // (17 - k))) END)))) AS cuts
            FROM n
        ), r AS (
            SELECT d.*, CAST(len(list_filter(s.cuts, lambda x: x <= p.e - p.bytes)) AS INT) AS shard
            FROM d JOIN p USING (g), s
        )
        SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                   lambda v, b: xor(v >> 8, k.k[(xor(v, b) & 255) + 1]))) AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY substr(g, 1, 2), CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS INT) % 64, doc_id, g) - 1 AS slot,
               CAST(NULL AS INT) AS grown_shard
        FROM r, k
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
        )
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM f
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
