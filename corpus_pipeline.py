"""The corpus pipeline: documents in, token digests of the mixed and cleaned corpus and their places out.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the documents of the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import re
import uuid
from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm import bpe, byte_cnn, minmax, pfair, site_lines
from boxmill.llm.queries import MIX_WEIGHTS, remainder
from boxmill.operators.skew import lookup_join
from boxmill.session import scratch_root, settle

QUALITY_LIMIT = 0.5

# a trained network and the digests of an encoding have no SQL
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject; trained on the labels of ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, marks = byte_cnn.training_sample(docs, labels, "quality", remainder(4) != 2)
    quality = _unused(docs, "quality")
    scored = byte_cnn.score(docs, byte_cnn.train(texts, marks), out=quality)
    return scored.where(F.col(quality) >= QUALITY_LIMIT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; every document stays, n_chars follows its text."""
    clean = site_lines.drop_site_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class.

    Rows that repeat both id and text count once; an id with several texts keeps them all.  A document without
    an id cannot be told from others and stays, and so does one without words, which is like nothing.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named, bare = docs.where(worded & F.col("doc_id").isNotNull()), docs.where(~worded & F.col("doc_id").isNotNull())
    verdicts = minmax.near_duplicates(docs)
    rows = _unused(docs, "rows")
    kept = verdicts.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(rows))
    kept = settle(kept)
    found = named.join(kept.where(F.col(rows) == 1).select("doc_id").hint("merge"), "doc_id", "left_semi")
    several = kept.where(F.col(rows) > 1)
    if not several.isEmpty():
        repeated = lookup_join(named, several, ["doc_id"], "inner", weight=rows, written=True).select(*docs.columns)
        # dealt anew, so that an id with many rows is not one task's
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = found.unionByName(_once(repeated.repartition(parts)))
    return found.unionByName(_once(bare)).unionByName(docs.where("doc_id is null"))


def _once(docs: DataFrame) -> DataFrame:
    """One of the rows that share id and text, the first by the hash of all columns; each task passes on one of each."""
    row = F.struct(*docs.columns)
    first = F.xxhash64(F.to_json(row))
    one = docs.groupBy("doc_id", F.sha2("text", 256).alias("print")).agg(F.min_by(row, first).alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix: that of the partitions, and of the rows in them."""
    return pfair.mix_sources(docs, MIX_WEIGHTS).select(*docs.columns)


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``place``: the number of each row, from 0, in the order in which the table was written.

    A reader deals files to its tasks by their size; only the number of the part and the row of the file say
    where a row was.  A table that was not read from files is written first.
    """
    # metadata columns of what a longer plan reads would be those of its inputs
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = settle(docs)
    file, start, row = (_unused(docs, name) for name in ("file", "start", "row"))
    read = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    # one row per written file: at most those of one write
    sizes = {r[file]: r["count"] for r in read.groupBy(file).count().collect()}
    names = sorted(sizes, key=_part)
    starts = accumulate((sizes[n] for n in names), initial=0)
    table = docs.sparkSession.createDataFrame(list(zip(names, starts)), f"{file} string, {start} long")
    found = read.join(F.broadcast(table), file)
    kept = [c for c in docs.columns if c != "place"]
    return found.withColumn("place", F.col(start) + F.col(row)).select(*kept, "place")


def _part(name: str) -> tuple[int, int, str]:
    """Order of part files: by the task that wrote them, then by their number among its files."""
    found = re.match(r"part-(\d+)-.*?(?:-c(\d+))?\.", name)
    if found is None:
        raise ValueError(f"{name} is not a part of a written table")
    return int(found[1]), int(found[2] or 0), name


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each text, and of what they decode to, with its ``place`` in the mix."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    digests = bpe.round_trip(_placed(docs), ranks, public_tokenizers.PATTERN, carry=["place"])
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "place")


STAGES = [
    ("quality", keep_good),
    ("site lines", drop_lines),
    ("near copies", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        path = f"{root}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
