"""Encoding of a corpus with a public tokenizer through a table of its distinct words."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits a text into words before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block, whose distinct words are joined as one; a block is what a Python worker holds at once.
BLOCK_BYTES = 12_000_000
#: Bytes of text that a byte of a columnar file is taken for, and the estimate from which on it is none.
EXPANSION, UNKNOWN = 4, 1 << 50

_coders: dict = {}


def _ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines())}


def _coder(blob: bytes):
    """The merges of a rank file, read once a Python worker; a text is one word to it."""
    if hash(blob) not in _coders:
        import tiktoken

        _coders[hash(blob)] = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=_ranks(blob), special_tokens={})
    return _coders[hash(blob)]


def _read(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def split_words(text: str):
    """Column of a text's words in order; joined they give the text again. White space and letters are Unicode's."""
    return F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))


def encode_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word, ids of each distinct word, encoded once; the first column of words is the word."""
    blob = _read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(blob).encode_ordinary
        for b in batches:
            ids = [encode(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _join_back(counts_only: bool):
    """Ids of each document of a block, from its words in order and the block's distinct words with their ids."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        texts = docs.column("words").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = texts.flatten()
        ids = words.column("ids").combine_chunks()
        starts = ids.offsets.to_numpy().astype(np.int64)
        values = ids.values.to_numpy(zero_copy_only=False)
        lens = np.diff(starts)
        at = pc.index_in(flat, value_set=words.column("word").combine_chunks()).to_numpy(zero_copy_only=False)
        if len(flat) and np.isnan(at.astype(float)).any():
            raise ValueError("a word of the block is not in its table")
        at = at.astype(np.int64)
        n = lens[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        if counts_only:
            return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(ends[bounds[1:]] - ends[bounds[:-1]], pa.int64())})
        take = np.repeat(starts[:-1][at] - ends[:-1], n) + np.arange(ends[-1])
        lists = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(values[take], pa.int32()))
        return pa.table({"doc_id": docs.column("doc_id"), "ids": lists})

    return run


def _blocks(docs: DataFrame) -> int:
    """Blocks for the texts, by the size that the planner knows of its files; where it knows none the texts are measured."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    size = EXPANSION * sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN:
        size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n)
    return max(1, -(-size // BLOCK_BYTES))


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of each row's text, or with counts_only doc_id, n_tokens (bigint).

    Null and empty texts give the empty list (0 tokens); the spelling of a special token is ordinary text; a row comes
    out once, so a repeated doc_id comes out as often. doc_id is a bigint and may be null. Columns other than doc_id
    and text play no part. Whole texts are encoded, whatever their length.

    Plan: texts are read once and shuffled once into blocks of about BLOCK_BYTES, each a task's work. A block's words are split in the JVM and made
    distinct in place and go out by word, once for both uses: the distinct words of all blocks are encoded once each; their ids go back to the blocks (a word
    is joined once a block, not once an occurrence, so frequent words are no hot key) and are put into the places of
    the words by position, vectorised over a block.
    """
    blocks = _blocks(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    # No fewer than any other shuffle has, or it would be shuffled again; more than blocks, so that few tasks have two.
    d = d.repartition(max(2 * blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    split = d.select("block", "doc_id", split_words("text").alias("words"))
    # explode_outer: for explode, a filter on the split text would be inferred and the text split before the shuffle too.
    # some, block: every use of the two shuffles reads the same columns, so each is made once.
    seen = split.select("block", "doc_id", F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())
    seen = seen.groupBy("block", "word").agg(F.min("doc_id").alias("some")).repartition("word")
    coded = encode_words(seen.groupBy("word").agg(F.min("block").alias("block"), F.min("some").alias("some")), vocabulary)
    per_block = seen.join(coded, "word").select(F.col("block").alias("of_block"), "word", "ids", "some")
    schema = "doc_id long, n_tokens long" if counts_only else "doc_id long, ids array<int>"
    return split.groupBy("block").cogroup(per_block.groupBy("of_block")).applyInArrow(_join_back(counts_only), schema)


def vocabulary_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece of the rank file: a fixed 50,256 rows."""
    rows = [(i, bytearray(piece)) for piece, i in _ranks(_read(vocabulary)).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text: the texts of doc_id, ids, by an id-to-piece join (the vocabulary's size is fixed, so it is broadcast).

    An empty or null list gives the empty text. doc_id must be unique. An id that the vocabulary lacks gives null.
    """
    pieces = vocabulary_table(coded.sparkSession, vocabulary)
    parts = coded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.hex("piece"), F.lit("?")).alias("h")))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda x: x["h"]), "")
    whole = whole.select("doc_id", F.when(~hexed.contains("?"), F.decode(F.unhex(hexed), "utf-8")).alias("text"), F.lit(True).alias("any"))
    return coded.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.when(F.col("any"), F.col("text")).otherwise("").alias("text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
