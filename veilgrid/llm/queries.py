"""The queries of the training-data operators: each over its whole table, with the oracle's SQL where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilgrid.llm.common import table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.hpylm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilgrid.llm.common import crc_mod
    from veilgrid.llm.quality_pairs import fit, quality_scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    return quality_scores(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.chat_windows import chat_windows, digests

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L AS conv_id, explode(array(0L, 1L)) AS turn").selectExpr("conv_id", "turn", "if(turn = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return digests(chat_windows(turns.unionByName(odd)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.piece_sampling import sample_segmentations

    return sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilgrid.llm.line_dedup import host_of, html_text, line_dedup

    return line_dedup(table(spark, sf_dir, "pages"), host_of(F.col("url")), html_text(F.col("html")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.warc_shards import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.simhash_anchors import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrid.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op3_chat_windows": """
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        a AS (SELECT *, ceil(length(text) / 4.0)::BIGINT + 4 AS tokens, row_number() OVER o AS n FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        b AS (SELECT *, n = 1 AND role = 'system' AS sys FROM a),
        c AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS own,
                greatest(1, floor((2048 - 256 - first(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n)) / 2.0))::BIGINT AS room FROM b),
        d AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY n)::BIGINT AS done, CASE WHEN own > room THEN 1 ELSE 0 END AS big FROM c),
        e AS (SELECT *, done - own AS start, 2 * sum(big) OVER (PARTITION BY conv_id ORDER BY n) - big AS ca, (done - own) // room AS cb FROM d),
        f AS (SELECT *, CASE WHEN n = 1 OR lag(sys) OVER o OR (lag(ca) OVER o = ca AND lag(cb) OVER o = cb) THEN 0 ELSE 1 END AS opens FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY n)),
        g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY n)::BIGINT AS win FROM f),
        h AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, max(done) OVER (PARTITION BY conv_id, win) AS win_end FROM g),
        i AS (SELECT *, CASE WHEN sys THEN last + 1 WHEN win < last AND win_end - start <= 256 THEN 2 ELSE 1 END AS copies,
                24 - 4 - 3 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS chars FROM h)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 * (max(last) + 1) + sum(copies * chars))::BIGINT AS formatted_chars
        FROM i GROUP BY conv_id""",
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op6_line_dedup": r"""
        WITH a AS (SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*?)\.?(?:[:/?#]|$)', 1), '') AS host,
              regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                '<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'gis'),
                '</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|title|nav|header|footer|article|section|main|aside|body|head|html|blockquote|pre|form|option)\b[^>]*>', chr(10), 'gi'),
                '<[^>]*>', '', 'g') AS x FROM pages),
        b AS (SELECT page_id, host, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)),
              lambda s: regexp_replace(s, '^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$', '', 'g')), lambda s: s <> '') AS lines FROM a),
        c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM b) GROUP BY ALL),
        d AS (SELECT host, list(line) AS gone FROM c JOIN (SELECT host, count(*) AS pages FROM b GROUP BY host) USING (host) WHERE n >= 3 AND n > 0.2 * pages GROUP BY host)
        SELECT page_id, b.host, len(lines) AS n_lines, len(list_filter(lines, lambda s: list_contains(coalesce(gone, []), s))) AS n_dropped,
               array_to_string(list_filter(lines, lambda s: NOT list_contains(coalesce(gone, []), s)), chr(10)) AS text
        FROM b LEFT JOIN d ON b.host = d.host""",
    "op8_warc_shards": """
        WITH a AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
        b AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM a),
        c AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1) AS v FROM b),
        d AS (SELECT *, list_transform(range(0, 160), lambda j: (v[(j // 4) + 1] >> (3 - j % 4)) & 1) AS bits FROM c)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + bits[5*k+1]*16 + bits[5*k+2]*8 + bits[5*k+3]*4 + bits[5*k+4]*2 + bits[5*k+5]]), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
