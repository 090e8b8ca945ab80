"""The corpus pipeline: from raw documents to token digests, in five stages.

Each stage works on all that its predecessor kept, and is written as Parquet
before the next one reads it.  Toxic documents go; lines that match an earlier
line go, and documents that consist of such lines; of each group of similar
documents one stays; documents with windows of two or more benchmark items go,
and of the rest every verified benchmark passage; what is left is encoded and
decoded.

Defined cases, by stage.  Null, empty and blank texts: the toxicity stage
scores them like examples without neighbours, lines and n-grams never touch
them, the benchmark finds no words in them, and they have no tokens.  A null
doc_id is not held out, comes last among lines, goes when it is similar to a
document with an id, and has its own row of tokens.  Ties and repeated rows:
equal lines of one doc_id stay together, of rows with one doc_id and one set
of n-grams one stays.  Very long texts are worked on whole.  Empty tables:
each stage returns none; without labels no document is toxic, without a
benchmark nothing is cut.  Columns beside those of ``documents`` are left out
at the first stage, so that none can clash.
"""

from __future__ import annotations

from loomwright.llm import bpe, core, decontaminate, lines, ngram_join, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark, docs, sf_dir):
    """Documents that score below the threshold; fitted on labels outside the held-out fold."""
    docs = docs.select(*COLUMNS)
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark, docs, sf_dir):
    """Documents without the lines that match an earlier line; those of nothing else go."""
    return lines.clean(docs.select(*COLUMNS))


def ngram_stage(spark, docs, sf_dir):
    """Of each group of documents linked by similar sets of n-grams, that of the least doc_id."""
    return ngram_join.clean(docs.select(*COLUMNS))


def benchmark_stage(spark, docs, sf_dir):
    """Documents without verified benchmark passages; those with passages of two items or more go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="both")


def token_stage(spark, docs, sf_dir):
    """Per document its number of tokens, and the digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, core.tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: Nearest labelled examples and a fitted calibration aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage's own tables are deleted when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(core.saved)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = core.save(docs)
            core.discard(spark, core.saved[before:-1])
    return docs
