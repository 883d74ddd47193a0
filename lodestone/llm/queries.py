"""The corpus operators' queries and their SQL, where SQL can express them."""

from __future__ import annotations

from lodestone.llm.bpe import op6_bpe
from lodestone.llm.chat import op1_chat_format
from lodestone.llm.dac import op4_token_dac
from lodestone.llm.decon import op8_decontaminate
from lodestone.llm.exact import op7_exact_dedup
from lodestone.llm.html import op5_html_text
from lodestone.llm.near import op2_near_dedup
from lodestone.llm.quality import op10_quality_qda
from lodestone.llm.shard import op3_shard_rendezvous
from lodestone.llm.unigram import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_near_dedup, op3_shard_rendezvous, op4_token_dac, op5_html_text, op6_bpe, op7_exact_dedup, op8_decontaminate, op9_token_counts, op10_quality_qda)}

#: Lower-casing of A-Z alone; DuckDB's lower() would change other letters too.
_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A byte's CRC-32 table by its rule, and the checksum of a text's UTF-8 bytes.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END))"
_BYTES = "list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT))"


def _shard(n: int) -> str:
    scores = f"list_transform(range({n}), lambda i: md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || i))"
    return f"CAST(list_position({scores}, list_min({scores})) - 1 AS INTEGER)"


ORACLES = {
    "op3_shard_rendezvous": f"""
        WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
        d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_shard(8)} AS shard, {_shard(9)} AS grown_shard,
                CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS BIGINT) AS text_crc32
              FROM documents, t)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM d""",
    "op1_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        rendered AS (
            SELECT *, CASE WHEN regexp_matches(text, '\\|### (System|User|Assistant): |### =|</turn>')
                           THEN regexp_replace(text, '(\\|### (System|User|Assistant): |### =|</turn>)', '\\\1', 'g') ELSE text END AS body,
                CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
                          ELSE '### =' || regexp_replace(role, '([\\:])', '\\\1', 'g') || ': ' END AS head FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum(length(head) + length(body) + 8) AS BIGINT) AS formatted_chars
        FROM rendered GROUP BY conv_id""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex({_NORMAL}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex({_NORMAL}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, array_to_string(ws[i + 1:i + 10], ' ') AS win, least(len(ws), 10) AS k
              FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
        lens AS (SELECT DISTINCT k FROM w),
        g AS (SELECT doc_id, i, k, array_to_string(ws[i + 1:i + k], ' ') AS win
              FROM (SELECT doc_id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM d, lens WHERE len(ws) >= k)),
        m AS (SELECT g.doc_id, g.i, g.k, w.item_id FROM g JOIN w ON g.win = w.win AND g.k = w.k),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
