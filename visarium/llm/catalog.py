"""Queries of this subpackage: opN_<name> over the whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visarium.llm.chunks import tokenizer_path
from visarium.llm.decontaminate import contamination
from visarium.llm.exact_dedup import exact_groups
from visarium.llm.filter_audit import filter_audit
from visarium.llm.jaccard_join import jaccard_classes
from visarium.llm.language import languages
from visarium.llm.merkle import verified_manifest
from visarium.llm.packing import packed
from visarium.llm.piece_counts import token_counts
from visarium.llm.revisits import crawl_of, resolve_revisits
from visarium.llm.sharding import shard_table
from visarium.llm.simhash import near_duplicates
from visarium.llm.toxicity import toxicity
from visarium.llm.wavelet import token_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(_table(spark, sf_dir, "documents"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_of(_table(spark, sf_dir, "pages")))
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "url_key", "outcome", F.coalesce("response_id", F.lit(-1)).alias("response_id"), F.array_join(F.array_sort(entries), "; ").alias("headers"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("matches")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_simhash,
        op3_token_files,
        op4_packing,
        op5_language,
        op6_token_counts,
        op7_sharding,
        op8_revisits,
        op9_decontamination,
        op10_toxicity,
        op11_jaccard_join,
        op12_filter_audit,
        op13_merkle,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_sharding": r"""
        WITH RECURSIVE bits(n, k, c) AS (
            SELECT n, 0, n::BIGINT FROM range(256) AS r(n)
            UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        d AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
            FROM documents, crc),
        keys AS (SELECT DISTINCT coalesce(doc_id, 0)::BIGINT AS id FROM documents),
        walk(id, key, b, j) AS (
            SELECT id, (id::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT FROM keys
            UNION ALL
            SELECT id, k, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
            FROM (SELECT id, j, (((key % 4294967296) * 2862933555777941757) % 18446744073709551616 + (((key // 4294967296) * 2862933555777941757) % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS k FROM walk WHERE j < 9)),
        shards AS (SELECT id, max(b) FILTER (b < 8)::INT AS shard, max(b) FILTER (b < 9)::INT AS grown_shard FROM walk GROUP BY id),
        placed AS (SELECT d.*, shard, grown_shard, ('0x' || substr(md5(concat_ws(':', doc_id, text_crc32)), 1, 3))::INT AS bucket FROM d JOIN shards ON id = coalesce(doc_id, 0))
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed""",
    "op8_revisits": r"""
        WITH p AS (
            SELECT page_id, url, '"' || substr(md5(html), 1, 16) || '"' AS tag, CAST(octet_length(encode(html)) AS VARCHAR) AS size,
                regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
        q AS (
            SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host,
                regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM p),
        r AS (
            SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&') AS params FROM q),
        k AS (
            SELECT *, CASE WHEN scheme <> '' THEN scheme || '://' ELSE '' END
                || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
                || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url_key FROM r),
        j AS (
            SELECT v.page_id AS v, v.url_key, f.page_id AS f, f.tag AS f_tag, f.size,
                CASE WHEN v.page_id % 4 = 3 THEN '"changed"' ELSE 'W/' || v.tag END AS v_tag,
                row_number() OVER (PARTITION BY v.page_id ORDER BY f.page_id DESC NULLS LAST) AS n
            FROM k v LEFT JOIN k f ON v.url_key = f.url_key AND f.page_id < v.page_id + 43200 AND f.page_id % 10 <> 9),
        o AS (
            SELECT *, CASE WHEN f IS NULL THEN 'no_response' WHEN v % 7 = 3 THEN 'no_validator' WHEN replace(v_tag, 'W/', '') = f_tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE n = 1)
        SELECT v * 2 + 1 AS record_id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN f * 2 ELSE -1 END AS response_id,
            CASE WHEN outcome = 'resolved' THEN 'content-length=' || size || '; content-type=text/html; date=' || (v + 43200) || '; etag=' || v_tag END AS headers
        FROM o""",
    "op9_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s
            FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
        pos AS (
            SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
            FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
        hit AS (SELECT doc_id, item_id, p.n, k FROM pos p JOIN win USING (n, s)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(j) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_filter_audit": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
        fails AS (
            SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
                + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM texts),
        marks AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        classes AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
        orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(f) WHERE NOT contains(o, f)),
        steps AS (
            SELECT o, k AS step, (1 << (ascii(o[k]) - 65))::INT AS bit, list_sum([0] || list_transform(range(1, k), lambda j: 1 << (ascii(o[j]) - 65)))::INT AS done
            FROM orders, range(1, 6) AS t(k) WHERE length(o) = 5),
        found AS (
            SELECT part, o, step, bit,
                coalesce(sum(n) FILTER (mask & (done | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & done = 0 AND mask & bit > 0), 0) AS removed,
                coalesce(sum(n) FILTER (mask & done > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                coalesce(sum(n) FILTER (mask & done = 0 AND mask & bit > 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (mask & done = 0 AND mask & bit > 0 AND toxic), 0) AS toxic_lost
            FROM classes, steps GROUP BY ALL)
        SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found""",
    "op13_merkle": r"""
        WITH RECURSIVE bits(n, k, c) AS (
            SELECT n, 0, n::BIGINT FROM range(256) AS r(n)
            UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        docs AS (
            SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0 AS hit FROM documents, crc),
        fields AS (
            SELECT doc_id, source, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
                text, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM docs),
        hashed AS (
            SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS claimed FROM fields),
        leaves AS (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM hashed),
        nodes(tree, level, size, idx, digest) AS (
            SELECT tree, 0, size, idx, leaf FROM leaves
            UNION ALL
            SELECT tree, level + 1, (size + 15) // 16, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE size > 1 GROUP BY tree, level, size, idx // 16),
        subroots AS (SELECT tree, level AS height, digest AS subroot, count(*) OVER () AS size FROM nodes WHERE size = 1),
        tops(level, size, idx, digest) AS (
            SELECT 0, size, tree, subroot FROM subroots
            UNION ALL
            SELECT level + 1, (size + 15) // 16, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE size > 1 GROUP BY level, size, idx // 16),
        root AS (SELECT level AS height, digest AS root FROM tops WHERE size = 1),
        beside AS (
            SELECT n.tree, n.level, n.idx, coalesce(string_agg(m.digest, '' ORDER BY m.idx) FILTER (m.idx < n.idx), '') AS l, coalesce(string_agg(m.digest, '' ORDER BY m.idx) FILTER (m.idx > n.idx), '') AS r
            FROM nodes n JOIN nodes m ON n.tree = m.tree AND n.level = m.level AND n.idx // 16 = m.idx // 16 WHERE n.size > 1 GROUP BY ALL
            UNION ALL
            SELECT -1, n.level, n.idx, coalesce(string_agg(m.digest, '' ORDER BY m.idx) FILTER (m.idx < n.idx), ''), coalesce(string_agg(m.digest, '' ORDER BY m.idx) FILTER (m.idx > n.idx), '')
            FROM tops n JOIN tops m ON n.level = m.level AND n.idx // 16 = m.idx // 16 WHERE n.size > 1 GROUP BY n.level, n.idx),
        walk(doc, tree, level, height, idx, up, digest, proof) AS (
            SELECT row_number() OVER (), tree, 0, height, idx, tree, claimed, '' FROM leaves JOIN subroots USING (tree)
            UNION ALL
            SELECT doc, CASE WHEN w.level = w.height THEN -1 ELSE w.tree END, CASE WHEN w.level = w.height THEN 0 ELSE w.level + 1 END, CASE WHEN w.level = w.height THEN root.height ELSE w.height END,
                CASE WHEN w.level = w.height THEN up ELSE w.idx // 16 END, up,
                CASE WHEN w.level = w.height THEN w.digest ELSE sha256(b.l || w.digest || b.r) END, CASE WHEN w.level = w.height THEN proof ELSE proof || b.l || b.r END
            FROM walk w CROSS JOIN root LEFT JOIN beside b ON b.tree = w.tree AND b.level = w.level AND b.idx = w.idx
            WHERE NOT (w.tree = -1 AND w.level = w.height))
        SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root, w.digest = root.root AS verified
        FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN root
        JOIN (SELECT wt.up AS tree, wl.idx AS first_idx, wt.digest, wt.proof FROM walk wt JOIN walk wl ON wt.doc = wl.doc AND wl.level = 0 AND wl.tree >= 0 WHERE wt.tree = -1 AND wt.level = wt.height) w
            ON w.tree = l.tree AND w.first_idx = l.idx""",
}
