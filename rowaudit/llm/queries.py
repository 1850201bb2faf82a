"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_lm, exact_dedup, filter_audit, language_id, ngram_join, packing, periodic_runs, pii, secret_scan, token_counts, toxicity, vector_join, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.gram_links(_table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.vector_links(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def _remainder(modulus: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(_remainder(4) != 2), labels.filter(_remainder(4) != 2))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(_table(spark, sf_dir, "documents"), _remainder(5) == 1)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def _looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the loops of op11's contract put in: of a tenth of the ids, by their checksum, the words from one on repeat."""

    def put_in(batches):
        for b in words.slices(batches):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
                if h % 10 == 0 and text:
                    own = words.split(pa.array([text]), lower=False)[0].to_pylist()
                    if own:
                        g, n = h // 10, len(own)
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        text = " ".join(own[:a] + [own[a + k % p] for k in range(n - a)])
                out.append(text)
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(put_in, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_looped(_table(spark, sf_dir, "documents")), least=24, power=3)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.expr("1000 * strongest.length div strongest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    model = language_id.train(docs.filter(_remainder(4) != 2), tokenizer)
    told = language_id.predict(docs, model, tokenizer)
    return told.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_secret_scans": op8_secret_scans,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL = {
    "op9_exact_dedup": """
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
        select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t
    """,
    "op12_filter_audit": """
        with d as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
                doc_id > min(doc_id) over (partition by coalesce(text, '')) as copy
            from documents
        ),
        l as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id),
        f as (
            select part, coalesce(good, false)::int as good, coalesce(toxic, false)::int as toxic,
                map {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(copy, false)} as fails
            from d left join l using (doc_id)
        ),
        c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
        x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
        o as (select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        s as (select filter_order, step, filter_order[step] as f, string_split(filter_order[1:step - 1], '') as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
        r as (
            select part, filter_order, step, f, n, good, toxic, fails[f] as failing, len(list_filter(before, lambda b: b <> '' and fails[b])) = 0 as reaches, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda b: fails[b])) = 1 as alone
            from c, s
        ),
        p as (
            select part, filter_order, step, f, sum(n) filter (reaches and not failing) as kept, sum(n) filter (reaches and failing) as removed, sum(n) filter (failing and not reaches) as redundant,
                sum(n) filter (failing and alone) as unique_fails, sum(good) filter (reaches and failing) as good_lost, sum(toxic) filter (reaches and failing) as toxic_lost
            from r group by part, filter_order, step, f
        )
        select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
            coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley
        from p
    """,
}
