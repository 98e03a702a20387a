"""The registered text queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, infill, merkle, ppm, quality, token_records, toxicity, warc
from fleetlens.llm.common import part_of, table, written
from fleetlens.llm.decontaminate import decontaminate
from fleetlens.llm.exact_dedup import exact_dedup
from fleetlens.llm.line_dedup import line_dedup
from fleetlens.llm.simhash import near_dedup
from fleetlens.llm.token_counts import token_counts

TEXT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    TEXT_QUERIES[run.__name__] = run
    return run


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(docs, path, 512, added_tokens=True)


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op2_decontaminate"] = r"""
WITH doc AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), sized AS (SELECT item_id, words, least(len(words), 13) AS n FROM item WHERE len(words) > 0
), place AS (SELECT *, unnest(generate_series(1, len(words) - n + 1)) AS s FROM sized
), want AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS w FROM place
), spot AS (
    SELECT doc_id, n, words, unnest(generate_series(1, len(words) - n + 1)) AS s
    FROM doc CROSS JOIN (SELECT DISTINCT n FROM want)
), hit AS (
    SELECT doc_id, s, spot.n, item_id FROM spot JOIN want
    ON spot.n = want.n AND array_to_string(words[s:s + spot.n - 1], ' ') = want.w
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id
), held AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.judged(docs, labels, part_of("doc_id", 4) == 2, 0.3)


@query
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


ORACLES["op4_exact_dedup"] = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archived(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH page AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), named AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM page)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM named
"""


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(table(spark, folder, "documents"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.judged(docs, labels, part_of("doc_id", 4) == 2, 0.7)


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op9_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score(table(spark, folder, "documents"), part_of("doc_id", 5) == 1)


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents"))


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in columns]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest(changed))
    found = merkle.manifest(table(spark, folder, "documents"), columns, more={"tampered": tampered})
    return merkle.verified(found.withColumn("candidate", F.coalesce("tampered", "leaf")), candidate_col="candidate")


ORACLES["op11_merkle"] = r"""
WITH RECURSIVE value AS (
    SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
    FROM documents
), byte AS (  -- CRC-32 by table
    SELECT list(list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7],
                            lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
    FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
), leaf AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree,
           sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
           sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) AS other,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                           lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 7 = 0 AS tampered
    FROM value CROSS JOIN byte
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
    FROM leaf
), node AS (
    SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, lvl, pos // 2, n
), sub AS (
    SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
    SELECT 0 AS lvl, pos, n, subroot AS h FROM sub
    UNION ALL
    SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
), fold AS (
    SELECT tree, pos AS spot, 0 AS lvl, pos, n, CASE WHEN tampered THEN other ELSE leaf END AS h, '' AS proof FROM placed
    UNION ALL
    SELECT f.tree, spot, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
           sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
    FROM fold f LEFT JOIN node s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1
), rise AS (
    SELECT fold.tree, spot, 0 AS lvl, sub.pos, sub.n, h, proof FROM fold JOIN sub ON sub.tree = fold.tree WHERE fold.n = 1
    UNION ALL
    SELECT f.tree, spot, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
           sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
    FROM rise f LEFT JOIN top s ON s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, rise.h AS folded_root, rise.h = top.h AS verified
FROM placed JOIN sub ON sub.tree = placed.tree JOIN rise ON rise.tree = placed.tree AND rise.spot = placed.pos AND rise.n = 1
JOIN top ON top.n = 1
"""


@query
def op12_infill(spark: SparkSession, folder: str) -> DataFrame:
    packed = written(infill.pack(table(spark, folder, "documents")), "frames")
    return infill.with_digests(infill.transform(packed))


ORACLES["op12_infill"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
           sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, units, len(units) AS n,
           CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d
    FROM cut
), parted AS (
    SELECT doc_id, text, CAST(n AS BIGINT) AS n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
                WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
           array_to_string(units[greatest(a, b) + 1:n], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""


@query
def op13_token_records(spark: SparkSession, folder: str) -> DataFrame:
    found = token_records.stored(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
