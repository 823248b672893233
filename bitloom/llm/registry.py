"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, embed, langid, media, packing, pieces, pii, quality, simhash, toxicity

QUERIES = {
    "op1_media": media.op1_media,
    "op2_langid": langid.op2_langid,
    "op3_pieces": pieces.op3_pieces,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_chat": chat.op6_chat,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_embed": embed.op10_embed,
}

ORACLE = {
    "op6_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum(length(role) + 5 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 8) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op10_embed": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
            r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links,
            least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
            vec_id = least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS kept
        FROM embeddings""",
}
