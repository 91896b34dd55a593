"""A corpus pipeline of the operators in the llm subpackage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents:

1. toxicity: documents that the classifier rejects go;
2. simhash: of documents whose fingerprints link, one stays; then of those
   that share four fifths of their runs of five words, which is exact where the
   fingerprints' 2 bits miss most, one stays;
3. decontaminate: documents that hold a benchmark item, be it edited, go;
4. mix: documents are repeated or left out so that sources meet their targets,
   and put in training order;
5. tokenize: documents are encoded in that order and written to token files;
   the result is their index: doc_id, start, n_tokens, ids_crc32.

A stage's scratch tables are deleted when the next one starts on docs that don't
read them, that is, on the written result.

A row is identified by its doc_id and a hash of its text, so null and repeated
doc_ids are told apart; of rows equal in both, simhash keeps one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retinaspark.llm import common, decontaminate, mixing, near, simhash, tokens, toxicity
from retinaspark.llm.queries import tokenizer_path


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    name = common.free_name(docs, "row_key")
    return docs.withColumn(name, F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"))), name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "toxic_score")
    return toxicity.classify(docs, model, score_col=name).where(F.col(name) < 0.3).drop(name)


def without_near_copies(docs: DataFrame) -> DataFrame:
    name = common.free_name(docs, "text_hash")
    rows = docs.withColumn(name, F.xxhash64(docs["text"]))
    common.let_go(docs.sparkSession)
    with common.temporary(docs.sparkSession):
        texts = common.written(rows.where(docs["text"].isNotNull()).select(F.col(name).alias("id"), docs["text"].alias("text")).dropDuplicates(["id"]), "near-all")
        gone = common.written(near.copies(texts).select(F.col("id").alias(name)), "near", stays=True)
    return rows.join(gone, name, "left_anti").drop(name)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    with common.temporary(spark):
        found = simhash.cluster(rows.select(F.col(key).alias("doc_id"), "text"))
        kept = common.written(found.where("doc_id = component_id").groupBy("doc_id").count().select(F.col("doc_id").alias(key), F.col("count").alias(f"{key}_n")), "kept", stays=True)
    once = rows.join(kept.where(f"{key}_n = 1").select(key), key, "left_semi")
    again = rows.join(kept.where(f"{key}_n > 1").select(key), key, "left_semi").dropDuplicates([key])
    return without_near_copies(common.written(once.union(again).drop(key), "distinct"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    found = decontaminate.find(rows.select(F.col(key).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    leaks = common.written(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return rows.join(leaks, key, "left_anti").drop(key)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.placed(docs)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = common.fresh_dir(spark, "corpus-tokens")
    # the mix is written in training order: by file, then by row
    placed = docs.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
    tokens.write(placed, out, tokenizer_path(), order=[placed["file_name"], placed["row_index"]])
    return tokens.read(spark, out).withColumnRenamed("key", "doc_id")


#: Scratch folders of the stage that ran last.
_scratch: list[str] = []


def _in_turn(stage):
    """A stage's scratch folders go when the next one starts, unless that one's docs still read them."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _scratch else []
        names = [folder.rsplit("/", 1)[-1] for folder in _scratch]
        common.remove(spark, [f for f, name in zip(_scratch, names) if not any(f"/{name}/" in r for r in read)])
        common.let_go(spark)
        with common.recorded() as made:
            out = stage(spark, docs, sf_dir)
        _scratch[:] = made
        return out

    return run


STAGES = [
    ("toxicity", _in_turn(toxicity_stage)),
    ("simhash", _in_turn(simhash_stage)),
    ("decontaminate", _in_turn(decontaminate_stage)),
    ("mix", _in_turn(mix_stage)),
    ("tokenize", _in_turn(tokenize_stage)),
]

#: The classifier and the tokenizer have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        done = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.remove(spark, before)
        docs, before = done, [path for path in done.inputFiles()[:1] for path in [path.rsplit("/", 1)[0]]]
    return docs
