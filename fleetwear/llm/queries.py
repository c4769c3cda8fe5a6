"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwear.llm import (
    decontamination,
    imatch,
    jaccard_join,
    packing,
    phrases,
    pii,
    quality,
    secrets,
    sharding,
    spans,
    substrings,
    token_counts,
    toxicity,
    whitening,
)
from fleetwear.llm.common import documents, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *[spans.count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans.listed(base), 256).alias("base_sha256"),
        spans.listed(F.col("secret_spans")).alias("spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *[spans.count(base, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(spans.listed(base), 256).alias("base_sha256"),
        spans.listed(F.col("pii_spans")).alias("spans"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.grouped(documents(spark, sf_dir), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["b"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.judged(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "score", "item_ids")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_pairs(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(documents(spark, sf_dir)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "slot", "shard")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason"
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(documents(spark, sf_dir))


OP10_SQL = f"""
with owners as (select [{",".join(map(str, sharding.fill(sharding.SHARDS)))}] as o),
slots as (
  select doc_id, cast(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) % {sharding.SIZE} as integer) as slot
  from documents)
select doc_id, slot, 'shard-' || lpad(cast(o[slot + 1] as varchar), 2, '0') as shard from slots, owners
"""

OP13_SQL = """
with texts as (
  select doc_id, row_number() over () as doc, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
pieces as (
  select lang, doc, generate_subscripts(p, 1) as piece, unnest(p) as s
  from (select lang, doc, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') as p from texts)),
words as (
  select lang, doc, piece, generate_subscripts(w, 1) as pos, unnest(w) as w
  from (select lang, doc, piece, regexp_extract_all(s, '[^\\x20\\x09]+') as w from pieces)),
runs as (
  select lang, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3
  from words window o as (partition by lang, doc, piece order by pos)),
f1 as (select lang, w as phrase, count(*) as a from runs group by all),
f2 as (select lang, w as x, w2 as y, w || ' ' || w2 as phrase, count(*) as a from runs where w2 is not null group by all having count(*) >= 10),
f3 as (
  select lang, w as x, w2 as y, w3 as z, w || ' ' || w2 || ' ' || w3 as phrase, count(*) as a
  from runs where w3 is not null group by all having count(*) >= 10),
cuts as (
  select f2.lang, f2.phrase, f2.a, 1 as k, p.a as l, q.a as r
  from f2 join f1 p on p.lang = f2.lang and p.phrase = x join f1 q on q.lang = f2.lang and q.phrase = y
  union all
  select f3.lang, f3.phrase, f3.a, 1, p.a, q.a
  from f3 join f1 p on p.lang = f3.lang and p.phrase = f3.x join f2 q on q.lang = f3.lang and q.phrase = f3.y || ' ' || f3.z
  union all
  select f3.lang, f3.phrase, f3.a, 2, p.a, q.a
  from f3 join f2 p on p.lang = f3.lang and p.phrase = f3.x || ' ' || f3.y join f1 q on q.lang = f3.lang and q.phrase = f3.z),
scores as (
  select *, cast(1000000 * cast(a as hugeint) * cast(a as hugeint) // (cast(l as hugeint) * cast(r as hugeint)) as bigint) as score
  from cuts),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, phrase, max(a) as longer
  from (select lang, x || ' ' || y as phrase, a from f3 union all select lang, y || ' ' || z, a from f3) group by all),
left_over as (
  select best.* from best left join inside using (lang, phrase) where longer is null or 100 * longer < 50 * a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score
from ranked join (select lang, sum(a) as n from f1 group by all) using (lang)
where rank <= 2000
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substrings": op5_substrings,
    "op6_decontamination": op6_decontamination,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_quality": op11_quality,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op10_sharding": OP10_SQL,
    "op13_phrases": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
