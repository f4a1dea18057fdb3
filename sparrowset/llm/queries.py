"""The opN_ queries, one for each operator, and their SQL where SQL can state them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowset.llm import chat, exact_dedup, mixing, packing, quality, simhash, token_counts, token_files, toxicity, urls
from sparrowset.llm.common import checkpointed, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(rows))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_files.read_index(spark, folder)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, names = mixing.mix_plan(table(spark, sf_dir, "documents"))
    size, copies = F.col(names["size"]), F.col(names["copies"])
    return mix.select("doc_id", size.alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), (size * copies).alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured, names = quality.measures(table(spark, sf_dir, "documents"))
    measured = checkpointed(measured.drop("text"))
    judged, names = quality.judge(measured, names, quality.cutoffs_for(measured, names, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *[F.col(names[c]).alias(c) for c in (*quality.MEASURES, "base_failed", "kept")])


RULES = (
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, names = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", *[F.col(names[c]).alias(c) for c in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored, score, toxic = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.3).cast("int").alias("predicted"), F.col(toxic).alias("toxic"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
}

def _op1_sql() -> str:
    """Turns as rows; texts with their control strings escaped by a regular expression for each first character."""
    t = chat.DEFAULT
    rest = lambda first: "|".join(re.escape(c[1:]).replace("'", "''") for c in t.controls if c[0] == first)
    escaped = lambda x: f"regexp_replace(regexp_replace({x}, '(<)(\\\\*(?:{rest('<')}))', '\\1\\\\\\2', 'g'), '(\\[)(\\\\*(?:{rest('[')}))', '\\1\\\\\\2', 'g')"
    around = " ".join(f"WHEN '{name}' THEN {len(r.before + r.after)}" for name, r in t.roles.items())
    known, loss = (", ".join(f"'{name}'" for name, r in t.roles.items() if ok(r)) for ok in (lambda r: True, lambda r: r.loss))
    # while all turns are in order, the state is that of the role before
    steps = ", ".join(f"('{state}', '{role}')" for state, to in t.transitions.items() for role in to)
    accepting = ", ".join(f"'{x}'" for x in t.accepting)
    return f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c
), f AS (
    SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 'start') AS before, role IN ({loss}) AS trained,
           length({escaped("text")}) + CASE WHEN role IN ({known}) THEN CASE role {around} END ELSE {len("".join(t.other))} + length({escaped("role")}) END AS chars
    FROM n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (trained), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and((before, role) IN ({steps})) AND last(role ORDER BY i) IN ({accepting}) AS valid
FROM f GROUP BY conv_id
"""


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5_SQL = """
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           concat(doc_id, ':', md5(coalesce(text, '')), ':', row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1, ':20') AS name
    FROM documents
), s AS (
    SELECT source, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), l AS (
    SELECT a.source, any_value(a.cap / a.w) AS ratio,
           CAST((SELECT sum(source_size) FROM s) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0) AS BIGINT)
           / CAST(sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS BIGINT) AS level
    FROM s a CROSS JOIN s b GROUP BY a.source
), t AS (
    SELECT source, source_size, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * w) END AS target
    FROM s, (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level)
), r AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5(name), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def _op6_sql() -> str:
    """The same rules, with windows and lines as rows and each binomial bound summed from its lowest term."""
    risk = quality.Risk()
    scores = {s.name: s.score.replace(" div ", " // ").format_map({c: c for c in quality.MEASURES}) for s in quality.SIGNALS}
    cuts = ", ".join(f"('{s.name}', {j}, {c})" for s in quality.SIGNALS for j, c in enumerate(s.cutoffs))
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in risk.strata)}) THEN lang ELSE '{risk.other}' END AS stratum FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs
), g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i : i + 4], ' ')) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), rep AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r
), dup AS (
    SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r
), m AS (
    SELECT r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
), b AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), scored AS (
    {" UNION ALL ".join(f"SELECT r, doc_id, stratum, base_failed, '{k}' AS signal, CASE WHEN n_words > 0 THEN {v.replace('nullif(n_words, 0)', 'n_words')} END AS score FROM b" for k, v in scores.items())}
), cut(signal, step, cutoff) AS (VALUES {cuts}), cells AS (
    SELECT stratum, signal, step, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND score > cutoff) AS k, count(*) FILTER (quality = 0 AND score > cutoff) AS bad
    FROM scored JOIN labels USING (doc_id) JOIN cut USING (signal) WHERE NOT base_failed AND quality IN (0, 1) GROUP BY ALL
), tested AS (
    SELECT *, n > 0 AND k < n * {risk.signal_alpha!r}::DOUBLE AND list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk.signal_alpha!r}::DOUBLE) + (n - j) * ln(1 - {risk.signal_alpha!r}::DOUBLE)) FOR j IN range(0, k + 1)]) <= {risk.level!r}::DOUBLE AS passed FROM cells
), chosen AS (
    SELECT stratum, signal, first(cutoff ORDER BY bad - k DESC, step) AS cutoff
    FROM (SELECT *, min(CASE WHEN NOT passed THEN step END) OVER (PARTITION BY stratum, signal) AS failed_at FROM tested)
    WHERE bad > k AND (failed_at IS NULL OR step < failed_at) GROUP BY ALL
), rejected AS (
    SELECT DISTINCT r FROM scored JOIN chosen USING (stratum, signal) WHERE score > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.r IS NULL AS kept
FROM b LEFT JOIN rejected USING (r)
"""


def _op7_sql() -> str:
    """Rules as rows, terms as patterns with a look at both sides; \\x01 never occurs in a term."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    has = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    # hits of one term, also those that share a boundary: every boundary is doubled first
    count = lambda t: f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){t.replace('-', '--')}([^a-z0-9]|$)'))"
    return f"""
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages
), h AS (
    SELECT *, regexp_extract(low, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
           CAST({" + ".join(map(count, urls.STRICT))} AS INTEGER) AS strict_hits, {" + ".join(f"CAST({has(t)} AS INTEGER)" for t in urls.SOFT)} AS soft_hits FROM p
), rules(verdict, rule_host, rule_path) AS (VALUES {rules}), best AS (
    SELECT r, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rule,
           first(verdict ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS said
    FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM h LEFT JOIN best USING (r)
"""


ORACLE = {
    "op1_chat_formatting": _op1_sql(),
    "op4_exact_dedup": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op6_quality_rules": _op6_sql(),
    "op7_url_filters": _op7_sql(),
}
