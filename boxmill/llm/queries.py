"""Registered queries of the training-data operators, each over its whole table, with SQL where it has one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm import (
    bpe,
    byte_cnn,
    hilbert,
    host_rules,
    html_cut,
    licences,
    minmax,
    nnpu,
    periodic,
    pfair,
    site_lines,
    spelling,
    warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return html_cut.extract(pages)


def op2_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of all documents, and the verdicts of their hosts."""
    return host_rules.judge(_table(spark, folder, "documents"))


def op3_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return hilbert.nearest(_table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def remainder(parts: int) -> Column:
    """crc32 of the document id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _judged(scores: DataFrame, held_out: Column) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op4_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole text."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    texts, marks = byte_cnn.training_sample(docs, labels, "quality", remainder(4) != 2)
    return _judged(byte_cnn.score(docs, byte_cnn.train(texts, marks), carry=["doc_id"]), remainder(4) == 2)


def op5_nnpu(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    toxic, rest, prior = nnpu.training_sample(docs, labels, "toxic", remainder(3) != 1)
    return _judged(nnpu.score(docs, nnpu.fit(toxic, rest, prior), carry=["doc_id"]), remainder(3) == 1)


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text as ids and back, as digests."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op7_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return site_lines.drop_site_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op8_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minmax.near_duplicates(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.archive_pages(spark, _table(spark, folder, "pages"))


# slots of each source in a period of the mix
MIX_WEIGHTS = {"src0": 240, **{f"src{i}": 40 for i in range(1, 20)}, pfair.OTHER: 10}


def op10_pfair(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in the order of the mix."""
    return pfair.mix_sources(_table(spark, folder, "documents"), MIX_WEIGHTS)


def op11_licences(spark: SparkSession, folder: str) -> DataFrame:
    """What every whole text says of licences."""
    found = licences.scan_licences(_table(spark, folder, "documents"), carry=["doc_id"])
    starts = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join(F.transform("expressions", lambda e: e["expression"]), "; ").alias("expressions"),
        "terms",
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of all words of the documents."""
    return spelling.group_variants(spelling.count_words(_table(spark, folder, "documents")))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op13: for one id in ten, the tail of the text repeats its own beginning; a NULL id is none of them."""
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or last or not n:
        return words
    at = g % n
    part = words[at : at + 1 + (n - at) // (3 + g % 8)]
    return words[:at] + (part * (-(-(n - at) // len(part))))[: n - at]


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of all documents."""
    docs = _table(spark, folder, "documents")
    found = periodic.find_runs(docs, carry=["doc_id"], key="doc_id", rewrite=planted)
    best = F.expr(
        "array_sort(runs, (a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1"
        " WHEN a.length * b.period < b.length * a.period THEN 1"
        " WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1"
        " WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END)"
    )
    top = found.withColumn("best", F.try_element_at(best, F.lit(1)))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_QUERIES = [
    op1_html_cut,
    op2_host_rules,
    op3_hilbert,
    op4_byte_cnn,
    op5_nnpu,
    op6_bpe,
    op7_site_lines,
    op8_minmax,
    op9_warc,
    op10_pfair,
    op11_licences,
    op12_spelling,
    op13_periodic,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # which imports this module

    return {"pipeline": corpus_pipeline.run} | {run.__name__: run for run in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_host_rules": host_rules.judge_sql("documents"),
        "op7_site_lines": site_lines.drop_site_lines_sql("documents"),
        "op9_warc": warc.archive_pages_sql("pages"),
    }
