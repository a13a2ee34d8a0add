"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from evidentia.llm import language, quality_model, toxicity
from evidentia.llm.byte_bpe import encode_digests, tokenizer_json
from evidentia.llm.minhash import near_duplicates
from evidentia.llm.packing import pack_documents
from evidentia.llm.periodic_runs import periodic_runs
from evidentia.llm.quality_rules import judge
from evidentia.llm.sharding import STEP, shard_rows
from evidentia.llm.token_counts import count_tokens, fresh_cache
from evidentia.llm.url_reputation import LEAST_SPREAD, LOWER, MOST_SPREAD, UNKNOWN_SPREAD, UPPER, judge_urls
from evidentia.llm.vectors import near_vectors
from evidentia.llm.whitening import whiten
from evidentia.plans.common import registry, sql_r6, table

REG = registry()


@REG.add("op2_quality_rules")
def op2_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _jump(shards: int) -> str:
    """The walk of every doc_id through ``shards`` shards, in exact whole numbers."""
    state = f"((state * {STEP} + 1) % 18446744073709551616::HUGEINT)"
    ahead = "floor((ahead + 1) * (2147483648::DOUBLE / ({s} // 8589934592 + 1)::DOUBLE))::BIGINT"
    start = f"((key * {STEP} + 1) % 18446744073709551616::HUGEINT)"
    first = f"floor(2147483648::DOUBLE / ({start} // 8589934592 + 1)::DOUBLE)::BIGINT"
    return (
        f"SELECT key, {start} AS state, 0::BIGINT AS place, {first} AS ahead FROM keys UNION ALL "
        f"SELECT key, {state}, ahead, {ahead.format(s=state)} FROM walk{shards} WHERE ahead < {shards}"
    )


# The checksum byte by byte, over rows that are made from its polynomial.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_ROWS = f"list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: {_BIT}, i))"
_BYTES = "list_transform(range(length(hexed) // 2), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, crc_rows[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
OP5_SQL = (
    f"WITH RECURSIVE crc AS MATERIALIZED (SELECT {_ROWS} AS crc_rows), "
    "texts AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hexed FROM documents), "
    "keys AS (SELECT DISTINCT coalesce(doc_id, 0)::HUGEINT AS key FROM documents), "
    f"walk40 AS ({_jump(40)}), walk41 AS ({_jump(41)}), "
    "s40 AS (SELECT key, max(place)::INTEGER AS shard FROM walk40 GROUP BY key), "
    "s41 AS (SELECT key, max(place)::INTEGER AS grown_shard FROM walk41 GROUP BY key) "
    f"SELECT doc_id, (strlen(text) + 16)::BIGINT AS size, {_CRC} AS text_crc32, 'key' AS law, shard, grown_shard, "
    "(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot "
    "FROM texts CROSS JOIN crc JOIN s40 ON s40.key = coalesce(doc_id, 0) JOIN s41 ON s41.key = coalesce(doc_id, 0)"
)


@REG.add("op5_jump_shards", OP5_SQL)
def op5_jump_shards(spark, sf_dir) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


@REG.add("op7_token_counts")
def op7_token_counts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), fresh_cache(docs))


@REG.add("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir) -> DataFrame:
    spec = tokenizer_json(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encode_digests(table(spark, sf_dir, "documents"), spec)


@REG.add("op4_toxicity_network")
def op4_toxicity_network(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@REG.add("op10_byte_language")
def op10_byte_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@REG.add("op3_ordinal_quality")
def op3_ordinal_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.grade_rows(docs, quality_model.fit(docs, quality_model.ratings_of(table(spark, sf_dir, "labels"))))


@REG.add("op9_genetic_packing")
def op9_genetic_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@REG.add("op1_minhash_duplicates")
def op1_minhash_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@REG.add("op6_graph_vectors")
def op6_graph_vectors(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@REG.add("op11_jacobi_whitening")
def op11_jacobi_whitening(spark, sf_dir) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@REG.add("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rehearse=True)


URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
SUFFIXES = ("example.com", "example.net", "example.org")  # names are registered below these
BAD_LIMIT, DEVIATIONS = 0.5, 3.0


def _spread(groups: str) -> str:
    """The strength of the prior of ``groups(labelled, bad, center)``, one row."""
    n, x, chance = "labelled::DOUBLE", "bad::DOUBLE", "(center * (1 - center))"
    over, scale = f"sum(({x} - {n} * center) * ({x} - {n} * center) - {n} * {chance})", f"sum({n} * ({n} - 1) * {chance})"
    return (
        f"SELECT 1 / (CASE WHEN coalesce({scale}, 0) = 0 THEN {UNKNOWN_SPREAD}::DOUBLE ELSE least(greatest({over} / {scale}, {LEAST_SPREAD}::DOUBLE), "
        f"{MOST_SPREAD}::DOUBLE) END) - 1 AS k FROM {groups} WHERE labelled > 0"
    )


def _posterior(groups: str, strength: str) -> str:
    return f"SELECT g.*, k * center + bad AS a, k * (1 - center) + labelled - bad AS b FROM {groups} g, {strength}"


def _suffix_sql() -> str:
    cases = " ".join(f"WHEN host = '{s}' OR ends_with(host, '.{s}') THEN '{s}'" for s in sorted(SUFFIXES, key=lambda s: (-len(s), s)))
    return f"CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN '' {cases} ELSE regexp_extract(host, '([^.]*)$', 1) END"


def _rule_sql(part: int) -> str:
    cases = []
    for rule in sorted(URL_RULES, key=lambda r: (len(r[0]), r[0]), reverse=True):
        name, slash, rest = rule[0].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{rule[part]}'")
    return f"CASE {' '.join(cases)} END"


OP13_SQL = (
    r"WITH p AS MATERIALIZED (SELECT page_id, "
    rf"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, "
    r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages), "
    r"marks AS (SELECT doc_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels "
    r"WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id), "
    r"outcomes AS (SELECT host, count(*) AS labelled, sum(bad) AS bad FROM p JOIN marks ON doc_id = "
    r"try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT) GROUP BY host), "
    r"named AS (SELECT host, coalesce(labelled, 0)::BIGINT AS labelled, coalesce(bad, 0)::BIGINT AS bad, "
    rf"{_suffix_sql()} AS suffix FROM (SELECT DISTINCT host FROM p) LEFT JOIN outcomes USING (host)), "
    r"hosts AS MATERIALIZED (SELECT *, CASE WHEN suffix = '' OR host = suffix THEN host ELSE "
    r"regexp_extract(substr(host, 1, length(host) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix END AS domain FROM named), "
    r"s0 AS (SELECT suffix, sum(labelled) AS labelled, sum(bad) AS bad, "
    r"(SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0) FROM hosts) AS center FROM hosts GROUP BY suffix), "
    rf"sk AS ({_spread('s0')}), s AS ({_posterior('s0', 'sk')}), "
    r"d0 AS (SELECT h.domain, h.suffix, sum(h.labelled) AS labelled, sum(h.bad) AS bad, any_value(s.a / (s.a + s.b)) AS center "
    r"FROM hosts h JOIN s USING (suffix) GROUP BY h.domain, h.suffix), "
    rf"dk AS ({_spread('d0')}), d AS ({_posterior('d0', 'dk')}), "
    r"h0 AS (SELECT h.*, d.a / (d.a + d.b) AS center FROM hosts h JOIN d ON d.domain = h.domain), "
    rf"hk AS ({_spread('h0')}), h AS ({_posterior('h0', 'hk')}), "
    rf"judged AS (SELECT host, labelled, bad, a / (a + b) AS share, a / (a + b) - {DEVIATIONS} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS least FROM h) "
    rf"SELECT page_id, host, path, {_rule_sql(0)} AS rule, coalesce({_rule_sql(1)}, CASE WHEN least > {BAD_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, "
    rf"labelled, bad, {sql_r6('share')} AS bad_share, {sql_r6('least')} AS bad_least FROM p JOIN judged USING (host)"
)


@REG.add("op13_host_reputation", OP13_SQL)
def op13_host_reputation(spark, sf_dir) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judge_urls(pages, labels, URL_RULES, SUFFIXES, BAD_LIMIT, DEVIATIONS)
