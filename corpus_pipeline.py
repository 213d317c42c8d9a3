"""A corpus from documents to packed windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents; what
it decides takes effect on the rows. `run` writes every stage as Parquet to the
shared folder and rereads it, so a stage starts from files that every executor can
reach and no lineage grows.
"""

from slatewise.llm import mixing, packing, secret_scan, simhash, toxicity
from slatewise.llm.common import stored, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the lexicon, learned from the labelled ones, does not call toxic."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    """The document of the smallest id from each class of near fingerprints."""
    return simhash.keep_one(docs)


def cut_secrets(spark, docs, sf_dir):
    """All documents, with secrets replaced by their kind."""
    return secret_scan.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """The words each source gives to the mix: one row for each pass over a document."""
    return mixing.mixed_documents(docs)


def pack_windows(spark, docs, sf_dir):
    """Pieces of documents in windows of tokens, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", cut_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learning, fingerprints and tokenizing are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
