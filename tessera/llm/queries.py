"""One query per operation, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, conversation_repair, decontaminate, fill_middle, html_text, importance, mixing, near_dup, pii, quality_rules, secrets, sharding, token_shards

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are another template's control strings."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(probe)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shards(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.training_order(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


_ALL = (
    op1_html_extraction,
    op2_importance_resampling,
    op3_pii,
    op4_chat_formatting,
    op5_decontamination,
    op6_sharding,
    op7_mixing,
    op8_ngram_jaccard,
    op9_quality_rules,
    op10_token_shards,
    op11_secrets,
    op12_fill_middle,
    op13_conversation_repair,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: How many signs the escapes of a text add
_ADDED = lambda x: f"(length({x}) - length(replace({x}, chr(92), '')))" + "".join(
    f" + (length({x}) - length(replace({x}, '{s}', ''))) // {len(s)}" for s in ("<|", "<s>", "</s>", "[INST]", "[/INST]")
)
_BUDGET, _HISTORY = chat.BUDGET, chat.HISTORY
_SHOWN = sum(map(len, (chat.TURN, chat.TEXT, chat.END)))
_CHAT_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_ADDED("role")} + {_ADDED("text")} AS more, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
c AS (SELECT *, length(role) + length(text) + more AS chars, strlen(role) + strlen(text) + more AS octets, n = 1 AND role = 'system' AS lead FROM e),
k AS (SELECT *, CAST(ceil((3 * octets - 2 * chars) / 4) AS BIGINT) + 4 AS tokens FROM c),
k2 AS (SELECT *, CASE WHEN lead THEN 0 ELSE tokens END AS cost FROM k),
p AS (SELECT *, coalesce(sum(cost) OVER b, 0) AS pos, greatest(1, {_BUDGET - _HISTORY} - max(CASE WHEN lead THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) AS room,
        coalesce(max(CASE WHEN lead THEN chars + {_SHOWN} END) OVER (PARTITION BY conv_id), 0) AS again
      FROM k2 WINDOW b AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, max(CASE WHEN 2 * cost > room THEN 0 ELSE cost END) OVER (PARTITION BY conv_id) AS others, count(*) FILTER (2 * cost > room) OVER b AS run,
        coalesce(max(CASE WHEN 2 * cost > room THEN pos + cost END) OVER b, 0) AS since
      FROM p WINDOW b AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN 2 * cost > room THEN 4611686018427387904 ELSE CAST((pos - since) // greatest(1, room - others) AS BIGINT) END AS place,
        coalesce(sum(CASE WHEN lead THEN 0 ELSE chars + {_SHOWN} END) OVER (PARTITION BY conv_id ORDER BY pos RANGE BETWEEN {_HISTORY} PRECEDING AND 1 PRECEDING), 0) AS told FROM r),
s2 AS (SELECT *, CASE WHEN lead THEN coalesce(lead(place) OVER (PARTITION BY conv_id ORDER BY n), place) ELSE place END AS spot FROM s),
w AS (SELECT conv_id, run, spot, sum(chars + {_SHOWN}) + min_by(told, n) + CASE WHEN min(n) > 1 THEN max(again) ELSE 0 END AS formatted FROM s2 GROUP BY conv_id, run, spot),
f AS (SELECT conv_id, CAST(sum(formatted) AS BIGINT) AS formatted_chars FROM w GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said,
         coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS learnt
  FROM e GROUP BY conv_id)
SELECT g.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id"""

_DECONTAMINATION_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
met AS (SELECT p.r, p.i, p.k, v.item FROM places p JOIN windows v ON p.win = v.win AND p.k = v.k),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM met) GROUP BY r),
own AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""

_NEAR_DUP_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_of JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS n_links FROM reach GROUP BY a"""

_DRAW = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
_FILL_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_DRAW(0)} % (len(u) + 1) AS x, {_DRAW(1)} % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW(2)} % 100 >= {fill_middle.RATE} THEN 'plain' WHEN {_DRAW(3)} % 100 < {fill_middle.SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1 : least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1 :], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: Repairs as a walk over the rows that keeps the least (cost, letters) for each state; CRC-32 from its polynomial
_REPAIR_SQL = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
hit AS (SELECT said.*, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what FROM said, crc),
dam AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
num AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM dam),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
  WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 0 ELSE 3 END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM num),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)) AS v(q, more, r)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, {'c': CAST(0 AS BIGINT), 'a': ''} AS m FROM sums
  UNION ALL SELECT conv_id, n, q, min(m) FROM (
    SELECT w.conv_id, f.n, CASE letter WHEN 'D' THEN r WHEN 'R' THEN CASE r WHEN 2 THEN 3 ELSE 2 END ELSE CASE WHEN r = 0 AND ini = 's' THEN 1 WHEN r <> 2 AND ini = 'u' THEN 2 WHEN r = 2 AND ini = 'a' THEN 3 END END AS q,
      {'c': w.m.c + 3 * more + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN fault = 3 AND letter <> 'D' THEN 3 ELSE 0 END, 'a': w.m.a || repeat('I', more) || letter} AS m
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN ins ON ins.q = w.q CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS e(letter)
    WHERE letter = 'D' OR fault IN (0, 3)) WHERE q IS NOT NULL GROUP BY conv_id, n, q),
best AS (SELECT w.conv_id, min({'c': w.m.c + 3 * more, 'a': w.m.a || repeat('I', more)}) AS m FROM walk w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.last = w.n JOIN ins ON ins.q = w.q WHERE r IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, l, i, count(*) FILTER (l <> 'I') OVER w AS n, count(*) FILTER (l <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(string_split(m.a, '')) AS l, unnest(range(length(m.a))) AS i FROM best WHERE m.a <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
led AS (SELECT g.conv_id FROM letters g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.n = g.n WHERE g.o = 1 AND l = 'K' AND ini = 's'),
rows AS (SELECT g.conv_id, i, CASE WHEN l = 'K' THEN f.role WHEN (o - CASE WHEN led.conv_id IS NULL THEN 0 ELSE 1 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE f.text END AS line
  FROM letters g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.n = g.n LEFT JOIN led ON led.conv_id IS NOT DISTINCT FROM g.conv_id WHERE l <> 'D'),
whole AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.m.c, 0) AS BIGINT) AS cost, coalesce(b.m.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""

SQL: dict[str, str] = {
    "op4_chat_formatting": _CHAT_SQL,
    "op5_decontamination": _DECONTAMINATION_SQL,
    "op7_mixing": mixing.SQL,
    "op8_ngram_jaccard": _NEAR_DUP_SQL,
    "op12_fill_middle": _FILL_SQL,
    "op13_conversation_repair": _REPAIR_SQL,
}
