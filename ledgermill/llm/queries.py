"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, divergence, fill_in_middle, fingerprints, langid, line_dedup, mixing, secrets, sentencepiece_sampling, simhash_dedup, token_counts, toxicity
from .common import small_batches, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.sample_documents(documents(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_examples(chat.with_extra(table(spark, sf_dir, "conversations"))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return mixing.sample(documents(spark, sf_dir)).withColumn("probability", F.round("probability", 6))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.restore(fill_in_middle.transform(documents(spark, sf_dir))))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(documents(spark, sf_dir)))


def _op6_sql() -> str:
    esc = lambda c: f"replace(replace(replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length('<s>[INST][/INST]</s>' || {esc("role")} || {esc("text")}) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows
), g AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM f
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR rn = n)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant' OR rn = n) AS n_examples
FROM g GROUP BY conv_id
"""


def _op9_sql() -> str:
    steps = ["w0 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM cells)"]
    for i in range(mixing.ROUNDS * len(mixing.MARGINS)):
        m = mixing.MARGINS[i % 3]
        steps.append(
            f"w{i + 1} AS MATERIALIZED (SELECT w{i}.* EXCLUDE (w), least(w * g.target / sum(w) OVER (PARTITION BY w{i}.{m}), most) AS w FROM w{i} JOIN goal_{m} g USING ({m}))"
        )
    goals = [
        f"goal_{m} AS (SELECT {m}, pow(sum(tokens), {mixing.TEMPERATURE}) / sum(pow(sum(tokens), {mixing.TEMPERATURE})) OVER () AS target FROM cells GROUP BY {m})"
        for m in mixing.MARGINS
    ]
    some = lambda letters: " OR ".join(f"contains(text, '{x}')" for x in letters)
    return f"""
WITH counted AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
rows AS (
  SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang,
         CASE WHEN (contains(text, '|') OR contains(text, chr(9))) AND (2 * n - length(replace(text, '|', '')) - length(replace(text, chr(9), ''))) * 50 >= n THEN 'table'
              WHEN NOT ({some("aeiou")}) THEN CASE WHEN {some("AEIOU")} THEN 'shout' ELSE 'other' END
              WHEN n < 200 THEN 'short' WHEN n >= 5000 THEN 'long' ELSE 'prose' END AS topic,
         greatest(1, ceil(n / 4.0))::BIGINT AS tokens
  FROM counted
), cells AS MATERIALIZED (
  SELECT *, tokens / sum(tokens) OVER () / {mixing.BUDGET} AS most
  FROM (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)
),
{", ".join(goals)},
{", ".join(steps)},
last AS (SELECT source, lang, topic, least(1.0, {mixing.BUDGET} * sum(tokens) OVER () * w / tokens) AS p FROM w{mixing.ROUNDS * 3})
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
       (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0) < p AS kept
FROM rows JOIN last USING (source, lang, topic)
"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op11_sql() -> str:
    share = "1 + ((1000000000::HUGEINT * ({c} + 5)) // ({n} + 5 * v))"
    return f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(ts)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= {divergence.LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM held GROUP BY lang),
c AS (SELECT lang, source, t, count(*)::HUGEINT AS c FROM (SELECT lang, source, unnest(ts) AS t FROM d) SEMI JOIN held USING (lang, t) GROUP BY lang, source, t),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY lang, source),
whole AS (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang),
p AS MATERIALIZED (
  SELECT lang, source, t, coalesce(c, 0) AS c, {share.format(c="coalesce(c, 0)", n="n")} AS p
  FROM n JOIN v USING (lang) JOIN held USING (lang) LEFT JOIN c USING (lang, source, t)
), q AS (
  SELECT lang, t, {share.format(c="tc", n="n")} AS q
  FROM (SELECT lang, t, sum(c)::HUGEINT AS tc FROM c GROUP BY lang, t) JOIN whole USING (lang) JOIN v USING (lang)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS other, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t GROUP BY ALL) g
    ON g.lang = a.lang AND one = a.source AND other = b.source
  UNION ALL
  SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


def _op12_sql() -> str:
    draw = ", ".join(f"('0x' || substr(s, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    tags = " OR ".join(f"contains(text, '{m}')" for m in fill_in_middle.MARKS.values())
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents
), h AS (SELECT *, len(u) AS n, {draw} FROM d),
k AS (
  SELECT *, CASE WHEN text = '' OR {tags} OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM h
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _op13_sql() -> str:
    blanks = " || ".join(f"chr({i})" for i in (32, 9, 10, 11, 12, 13))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {blanks}), {_AZ}) AS key FROM l),
many AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {line_dedup.LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {line_dedup.LEAST_DOCUMENTS}
), m AS (SELECT k.*, many.key IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM k LEFT JOIN many ON k.key = many.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_sentencepiece, op3_simhash_dedup, op4_nearest_neighbours, op5_language_id,
        op6_chat_formatting, op7_token_counts, op8_toxicity, op9_mixing, op10_fingerprints,
        op11_source_divergence, op12_fill_in_middle, op13_line_dedup,
    )
}
ORACLE: dict[str, str] = {"op6_chat_formatting": _op6_sql(), "op9_mixing": _op9_sql(), "op11_source_divergence": _op11_sql(), "op12_fill_in_middle": _op12_sql(), "op13_line_dedup": _op13_sql()}
