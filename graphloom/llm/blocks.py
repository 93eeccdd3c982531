"""Texts as blocks of word codes: split once, work on distinct words, put results back by position.

Long texts are cut into pieces in the JVM, at places where a word ends and white space begins; the pieces are split into
words, and Python joins pieces to documents and documents to blocks. A block has its own dictionary of distinct words,
and each document as codes into it, in word order. It is closed at the first document's end after `LIMIT` bytes of
words, so neither an Arrow batch (pieces) nor a block (bytes) grows with the texts or with their number; a document's
own words are the least that a block holds. What leaves a block for a shuffle is one row per distinct word of the block,
so a word in a third of all positions costs as many rows as there are blocks, and those of a hot word are salted.
Results per word come back as one array per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize, salted_join

SCHEMA = "block long, words array<string>, freqs array<int>, docs array<long>, sizes array<int>, codes binary"
#: Characters after which a piece ends with the next word; Arrow batches of 10,000 pieces stay near 40 MB.
PIECE = 4096
#: Bytes of words after which a block ends with the next document.
LIMIT = 4 << 20


def pieces(text: Column, space: str) -> Column:
    """The text as an array of pieces, each but the last ending where a word ends and a character of `space` (the
    inside of a character class) follows: a splitter whose words never hold white space after other characters splits
    the pieces as it splits the text. A text without such places stays whole. Null gives null."""
    cut = rf"(?s).{{1,{PIECE}}}[{space}]*+[^{space}]*+"
    return F.when(F.length(text) > PIECE, F.regexp_extract_all(text, F.lit(cut), F.lit(0))).otherwise(F.array(text))


def build(docs: DataFrame, doc_id: str, text: str, space: str, split: Callable[[Column], Column], label: str) -> DataFrame:
    """Blocks of the texts' words, `split` being the splitter of a piece into words (none null), written to the shared
    folder. A null text counts as empty; a null id is kept. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        made = 0
        held: list[tuple] = []  # (ids and words per piece, which pieces begin a document, the words)
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            starts = np.concatenate([h[1] for h in held])
            sizes = np.add.reduceat(np.concatenate([h[2] for h in held]), np.flatnonzero(starts)).astype(np.int32)
            ids = pa.concat_arrays([h[0] for h in held]).filter(pa.array(starts))
            coded = pa.concat_arrays([h[3] for h in held]).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            freqs = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            cols = [pa.array([base + made], pa.int64()), one(coded.dictionary), one(pa.array(freqs)), one(ids), one(pa.array(sizes)), pa.array([codes.tobytes()], pa.binary())]
            made += 1
            return pa.RecordBatch.from_arrays(cols, ["block", "words", "freqs", "docs", "sizes", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0).cast(pa.int64()), batch.column(2)
            begins = batch.column(1).to_numpy() == 0
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            words = lists.flatten()
            after = np.concatenate([[0], np.cumsum(counts)])  # words before each piece
            bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])[after]
            at = 0

            def hold(to: int) -> None:
                nonlocal at, size
                if to > at:
                    held.append((ids.slice(at, to - at), begins[at:to], counts[at:to], words.slice(after[at], after[to] - after[at])))
                    size += int(bytes_[to] - bytes_[at])
                    at = to

            for start in np.flatnonzero(begins).tolist():
                if size + int(bytes_[start] - bytes_[at]) >= LIMIT:
                    hold(start)
                    yield block()
                    held, size = [], 0
            hold(batch.num_rows)
        if held:
            yield block()

    each = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.posexplode(pieces(F.col(text), space)).alias("piece", "text"))
    return materialize(each.select("id", "piece", split(F.col("text"))).mapInArrow(run, SCHEMA), label)


def distinct_words(blocks: DataFrame) -> DataFrame:
    """(word, n): every distinct word with its number of occurrences in all texts."""
    each = blocks.select(F.explode(F.arrays_zip("words", "freqs")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.freqs").cast("bigint").alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def attach(blocks: DataFrame, results: DataFrame, keep_words: bool = False) -> DataFrame:
    """Blocks with `found`: an array of (slot, result) for those of their words that `results` (word, result) has.
    slot is the word's code in the block; a block's group is no larger than its dictionary."""
    slots = blocks.select("block", F.posexplode("words").alias("slot", "word"))
    joined = salted_join(slots, results, "word", "inner", F.col("block"))
    found = joined.groupBy("block").agg(F.collect_list(F.struct("slot", "result")).alias("found"))
    return (blocks.drop("freqs") if keep_words else blocks.drop("words", "freqs")).join(found, "block", "left")
