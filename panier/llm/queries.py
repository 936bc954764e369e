"""The thin queries ``opN_<name>`` over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import columns, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import write_store

    return write_store(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), tokenizer("byte_bpe_50k.json"), 2).per_document()


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(columns(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("key", "keep")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_media, store_media

    return read_media(*store_media(columns(table(spark, sf_dir, "documents"), "doc_id", "text")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import REPLY, linked, turns_as_calls

    return linked(turns_as_calls(columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")), REPLY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs, labels = columns(table(spark, sf_dir, "documents"), "doc_id", "text"), columns(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import scores

    return scores(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    return secrets(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), columns(table(spark, sf_dir, "benchmark"), "item_id", "text")).drop("th")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pii

    return pii(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_files, op2_simhash, op3_media, op4_chat, op5_toxicity, op6_suffix_tree, op7_secrets, op8_packing, op9_decontamination, op10_pseudonyms, pipeline)}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(x) AS n, x FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: w[s:s + 9])) AS x FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, (SELECT DISTINCT n FROM win)), hit AS (SELECT DISTINCT doc_id, s, win.n, item_id FROM dw JOIN win ON win.n = dw.n AND x = w[s:s + dw.n - 1]),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit), np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN it USING (doc_id)"""

_ID = "conv_id || '-' || (turn + {})"
_PROMPT = "'\"prompt\":' || to_json(coalesce(text, ''))::VARCHAR"
OP4 = f"""WITH RECURSIVE c AS (SELECT conv_id, turn::BIGINT AS turn, role, text, count(*) AS copies, row_number() OVER () AS item, conv_id % 4 AS sort, conv_id + turn AS mix FROM conversations GROUP BY ALL),
k AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE WHEN role = 'user' THEN {_ID.format(0)} WHEN role = 'assistant' AND sort = 3 THEN {_ID.format(1)} WHEN role = 'assistant' THEN {_ID.format(-1)} END AS call_id, CASE WHEN mix % 7 = 6 THEN 'search' ELSE 'reply' END AS name,
  CASE WHEN sort = 0 THEN [{_ID.format(-2)}, {_ID.format(-1)}] WHEN sort = 1 THEN [{_ID.format(1)}, {_ID.format(2)}] WHEN sort = 2 AND turn = 0 THEN [{_ID.format(2)}] WHEN sort = 2 AND turn = 2 THEN [{_ID.format(-2)}] ELSE [] END AS after,
  CASE mix % 5 WHEN 1 THEN '{{"turn":' || turn || '}}' WHEN 2 THEN '{{' || {_PROMPT} || ',"turn":"' || turn || '"}}' WHEN 3 THEN '{{"n":1,' || {_PROMPT} || ',"turn":' || turn || '}}' ELSE '{{' || {_PROMPT} || ',"turn":' || turn || '}}' END AS arguments,
  CASE WHEN role <> 'user' THEN '' WHEN mix % 7 = 6 THEN 'unknown tool' ELSE CASE mix % 5 WHEN 1 THEN 'prompt is missing' WHEN 2 THEN 'turn is no integer' WHEN 3 THEN 'n is unknown' ELSE '' END END AS problems FROM c),
p AS (SELECT call_id, arg_min(item, (turn, item)) AS parent FROM k WHERE kind = 'call' GROUP BY 1),
e AS (SELECT DISTINCT item AS child, parent FROM (SELECT item, call_id FROM k WHERE kind = 'result' UNION ALL SELECT item, unnest(after) FROM k WHERE kind = 'call') JOIN p USING (call_id)),
a AS (SELECT item, item AS up, 0 AS dist FROM k UNION SELECT a.item, e.parent, a.dist + 1 FROM a JOIN e ON e.child = a.up WHERE a.dist < (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY conv_id))),
y AS (SELECT DISTINCT item FROM a WHERE up IN (SELECT item FROM a WHERE item = up AND dist > 0)),
o AS (SELECT a.item, max((u.turn, a.dist)) AS s FROM a JOIN c u ON u.item = a.up GROUP BY 1),
l AS (SELECT k.*, y.item IS NOT NULL AS cyclic, s, EXISTS (SELECT 1 FROM k o WHERE o.kind = 'result' AND o.call_id = k.call_id) AS answered, p.parent FROM k LEFT JOIN y USING (item) JOIN o USING (item) LEFT JOIN p USING (call_id))
SELECT conv_id, CASE WHEN cyclic THEN turn ELSE s[1] END AS place, CASE WHEN cyclic THEN 0 ELSE s[2] END AS depth, turn, 0 AS n, kind, call_id,
CASE WHEN cyclic THEN 'cycle' WHEN kind = 'result' AND parent IS NULL THEN 'orphan' WHEN kind = 'call' AND parent <> item THEN 'repeated' WHEN problems <> '' THEN 'invalid' WHEN kind = 'call' AND NOT answered THEN 'open' ELSE 'ok' END AS status, problems, copies,
CASE kind WHEN 'call' THEN '{{"role":' || to_json(role)::VARCHAR || ',"tool_calls":[{{"arguments":' || arguments || ',"id":' || to_json(call_id)::VARCHAR || ',"name":"' || name || '"}}]}}'
WHEN 'result' THEN '{{"content":' || to_json(text)::VARCHAR || ',"role":"tool","tool_call_id":' || to_json(call_id)::VARCHAR || '}}' ELSE '{{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}}' END AS json FROM l"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a fitted model, a bitwise hash of shingles, a keyed permutation or look-around in patterns."""
    return {"op4_chat": OP4, "op9_decontamination": OP9}

