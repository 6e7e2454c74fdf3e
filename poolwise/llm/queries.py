"""The operators' registered queries and, where SQL can express them, their
DuckDB texts. Each applies its operator to the whole of its table."""

from __future__ import annotations

from . import chat, cuckoo, decontam, grammar, lm, mixing, repair, sharding, simhash, spelling, token_counts, toxicity, warc
from .common import table


def op1_warc_revisits(spark, sf_dir):
    return warc.deduplicated_pages(table(spark, sf_dir, "pages"))


def op2_chat_transcripts(spark, sf_dir):
    return chat.parsed_transcripts(table(spark, sf_dir, "conversations"))


def op3_simhash(spark, sf_dir):
    return simhash.simhash_table(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mixing_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scores(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_token_shards(spark, sf_dir):
    return grammar.token_table(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_warc_revisits, op2_chat_transcripts, op3_simhash, op4_decontamination, op5_sharding, op6_exact_dedup, op7_mixing,
    op8_lm_scores, op9_token_counts, op10_toxicity, op11_spelling_variants, op12_token_shards, op13_conversation_repair)}

#: The unsigned CRC-32 of a list ``bytes`` with its table ``tab``, as DuckDB has none.
_CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i:
                 CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"""
_CRC = """xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLES = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first_id FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
        FROM g""",
    "op4_decontamination": r"""
        WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                 lambda x: x <> '') AS w FROM benchmark),
        wins AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1),
                 lambda s: w[s + 1 : s + 10])) AS win FROM w WHERE len(w) > 0),
        win AS (SELECT item_id, len(win) AS n, array_to_string(win, ' ') AS gram FROM wins),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                 lambda x: x <> '') AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM win),
        grams AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS s,
                 unnest(list_transform(range(0, len(w) - n + 1), lambda s: array_to_string(w[s + 1 : s + n], ' '))) AS gram
                 FROM d, sizes WHERE len(w) >= n),
        hit AS (SELECT doc_id, item_id, s, g.n FROM grams g JOIN win USING (n, gram)),
        spots AS (SELECT doc_id, count(*) AS n_hit FROM (
                 SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (
                 SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS d
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, d AS text_sha256
        FROM n WINDOW w AS (PARTITION BY d)""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE crc AS (""" + _CRC_TABLE + r"""),
        tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL),
        runs AS (SELECT w, count(*) AS k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
                 lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                 ELSE [192 | (unicode(x)::BIGINT >> 6), 128 | (unicode(x)::BIGINT & 63)] END)) AS bytes FROM tok GROUP BY doc_id, w),
        hashed AS (SELECT w, k, """ + _CRC + r""" AS h FROM runs, crc),
        vocab AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word,
                 sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6),
        del AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d
                 FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
        near AS (SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
                 UNION SELECT a.word, b.word, b.n FROM del a JOIN vocab b ON a.d = b.word
                 UNION SELECT b.word, a.word, a.n FROM del a JOIN vocab b ON a.d = b.word),
        best AS (SELECT word, count(*) AS n_near, min({'n': -n, 'w': other}) AS b FROM near GROUP BY word),
        forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.b.n >= 5 * v.n THEN b.b.w END AS form,
                 CASE WHEN -b.b.n >= 5 * v.n THEN -b.b.n END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
        walk AS (SELECT word, word AS at, form AS next FROM forms
                 UNION ALL SELECT k.word, k.next, f.form FROM walk k JOIN forms f ON f.word = k.next WHERE k.next IS NOT NULL)
        SELECT word, form, w.at AS root, n, n_near, form_n FROM forms JOIN walk w USING (word) WHERE w.next IS NULL""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc AS (""" + _CRC_TABLE + r"""),
        ids AS (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid FROM conversations),
        keyed AS (SELECT c.conv_id, cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
                 list_transform(string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                 lambda x: unicode(x)::BIGINT) AS bytes FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
        hashed AS (SELECT *, """ + _CRC + r""" % 20 AS h FROM keyed, crc),
        rows_ AS (SELECT cid, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt,
                 unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS cp FROM hashed WHERE h <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, txt, cp) AS p,
                 rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS ini FROM rows_),
        seen AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY cid, role, txt ORDER BY p) > 1 AS again,
                 right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(ini) OVER (PARTITION BY cid ORDER BY p) AS prev FROM placed),
        r AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS trunc, blank OR again AS must FROM seen),
        ins(st, too, c, a, t) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
                 (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
                 (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
                 (3, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:'])),
        stay(st, ini, too) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        reput(st, role, too) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
        ops AS (SELECT cid, p, s.st, s.st AS too, 3 AS c, 'D' AS a, []::VARCHAR[] AS t FROM r, (VALUES (0), (1), (2), (3)) s(st)
                 UNION ALL SELECT cid, p, st, too, trunc::INT, 'K', [role || ':' || txt] FROM r JOIN stay USING (ini) WHERE NOT must
                 UNION ALL SELECT cid, p, st, too, 2 + trunc::INT, 'R', [reput.role || ':' || txt] FROM r, reput WHERE NOT must),
        steps AS (SELECT o.cid, o.p, i.st, o.too, i.c + o.c AS c, i.a || o.a AS a, i.t || o.t AS t FROM ins i JOIN ops o ON o.st = i.too),
        best AS (SELECT cid, 0::BIGINT AS p, 0 AS st, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS b FROM ids
                 UNION ALL SELECT b.cid, b.p + 1, s.too, min({'c': b.b.c + s.c, 'a': b.b.a || s.a, 't': b.b.t || s.t})
                 FROM best b JOIN steps s ON s.cid = b.cid AND s.p = b.p + 1 AND s.st = b.st GROUP BY b.cid, b.p, s.too),
        final AS (SELECT b.cid, min({'c': b.b.c + i.c, 'a': b.b.a || i.a, 't': b.b.t || i.t}) AS b FROM best b JOIN ins i ON i.st = b.st
                 WHERE b.p = (SELECT count(*) FROM r WHERE r.cid = b.cid) AND i.too IN (0, 3) GROUP BY b.cid),
        stats AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
                 sum(dup::INT) AS dup, sum(trunc::INT) AS trunc,
                 sum((prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM r GROUP BY cid)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate,
               coalesce(trunc, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit,
               sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
        FROM ids JOIN final USING (cid) LEFT JOIN stats USING (cid)""",
}
