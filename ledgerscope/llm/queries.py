"""Registered queries of the corpus operators and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm import (conversation_repair, decontaminate, disclosure, language_id, line_dedup, mixing, secret_scan, simhash, spot_signatures,
                             substring_dedup, toxicity, warc, whitening)
from ledgerscope.llm.shared import table
from ledgerscope.session import shared_folder

_PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def register(plan):
        _PLANS[name] = plan
        if statement is not None:
            _SQL[name] = statement
        return plan

    return register


_LINES = r"""WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM parts),
stripped AS (SELECT *, trim(line, concat(' ', chr(9), chr(13), chr(11), chr(12))) AS s FROM lines),
numbered AS (SELECT doc_id, pos, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM stripped WHERE s <> ''),
windows AS (SELECT doc_id, i, CASE WHEN lead(i, 2) OVER w IS NOT NULL THEN concat(s, chr(10), lead(s, 1) OVER w, chr(10), lead(s, 2) OVER w) END AS run
            FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i FROM windows WHERE run IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(3) r(k)),
marked AS (SELECT n.*, g.i IS NOT NULL AS dead FROM numbered n LEFT JOIN gone g USING (doc_id, i)),
runs AS (SELECT *, dead AND NOT coalesce(lag(dead) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dead) AS n_removed, count(*) FILTER (begins) AS n_runs FROM runs GROUP BY doc_id),
kept AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) AS text FROM stripped s LEFT JOIN marked m USING (doc_id, pos)
         WHERE NOT coalesce(m.dead, false) GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
 sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


@query("op1_line_dedup", _LINES)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


@query("op2_spot_signatures")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return spot_signatures.report(table(spark, folder, "documents"))


@query("op3_warc", """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                   min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages))""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, folder, "pages"), path)
    return warc.pages_read(spark, path)


@query("op4_substring_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removals(table(spark, folder, "documents")).drop("spans")


@query("op5_decontaminate")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


@query("op9_disclosure")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.report(table(spark, folder, "documents"))


@query("op10_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.slots(table(spark, folder, "documents")).drop("key", "text_key")


_CONVERSATIONS = r"""WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
              FROM range(256) r(i)),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),
          lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind <> 0),
numbered AS (SELECT *, substr(role, 1, 1) AS l, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS s,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(concat(length(role), ':', role, text)), 1, 32), copy) AS i FROM damaged),
faulted AS (SELECT *, s = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(s, 1) NOT IN ('.', '!', '?') AS cut,
            lead(l) OVER (PARTITION BY conv_id ORDER BY i) AS next_l FROM numbered),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
            count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (next_l IS NOT NULL AND concat(l, next_l) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM faulted GROUP BY conv_id),
inserts(q, letters, cost, ins, q1) AS (VALUES (0, '', 0, NULL, 0), (1, '', 0, NULL, 1), (2, '', 0, NULL, 2), (3, '', 0, NULL, 3), (0, 'I', 5, 'user:', 2), (1, 'I', 5, 'user:', 2),
            (3, 'I', 5, 'user:', 2), (2, 'I', 5, 'assistant:', 3), (0, 'II', 10, concat('user:', chr(10), 'assistant:'), 3), (1, 'II', 10, concat('user:', chr(10), 'assistant:'), 3)),
edits(q1, l, letter, cost, q2) AS (VALUES (0, NULL, 'D', 2, 0), (1, NULL, 'D', 2, 1), (2, NULL, 'D', 2, 2), (3, NULL, 'D', 2, 3), (0, NULL, 'R', 1, 2), (1, NULL, 'R', 1, 2), (3, NULL, 'R', 1, 2),
            (2, NULL, 'R', 1, 3), (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (3, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3)),
moves AS (SELECT i.q, concat(letters, letter) AS letters, letter, i.cost + e.cost AS cost, ins, l, q2 FROM inserts i JOIN edits e ON i.q1 = e.q1),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, CAST(NULL AS VARCHAR) AS body FROM counted
         UNION ALL
         SELECT conv_id, i, q, best.cost, best.audit, body FROM (
           SELECT w.conv_id, f.i, m.q2 AS q, min({'cost': w.cost + m.cost + CASE WHEN f.cut AND m.letter <> 'D' THEN 5 ELSE 0 END, 'audit': concat(w.audit, m.letters)}) AS best,
                  arg_min(nullif(concat_ws(chr(10), w.body, m.ins, CASE m.letter WHEN 'K' THEN concat(f.role, ':', f.text) WHEN 'R' THEN concat(CASE m.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END, f.text) END), ''),
                          {'cost': w.cost + m.cost + CASE WHEN f.cut AND m.letter <> 'D' THEN 5 ELSE 0 END, 'audit': concat(w.audit, m.letters)}) AS body
           FROM walk w JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
           JOIN moves m ON m.q = w.q AND (m.letter = 'D' OR NOT (f.blank OR f.again)) AND (m.l IS NULL OR m.l = f.l)
           GROUP BY w.conv_id, f.i, m.q2)),
done AS (SELECT w.conv_id, w.cost + x.cost AS cost, concat(w.audit, x.letters) AS audit, concat_ws(chr(10), w.body, x.ins) AS body
         FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts x ON x.q = w.q AND x.q1 IN (0, 3)
         QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + x.cost, concat(w.audit, x.letters)) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op11_secret_scan")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_conversation_repair", _CONVERSATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    convs = table(spark, folder, "conversations")
    return conversation_repair.report(conversation_repair.damaged(convs), convs)


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_PLANS)


def statements() -> dict[str, str]:
    return dict(_SQL)
