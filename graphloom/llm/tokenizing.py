"""Encoding a whole corpus with a public byte-level BPE tokenizer, through a table of its distinct words.

Words are split in Spark by the tokenizer's own pattern, each distinct word is encoded once, and the ids are joined
back by position. Encoding by words equals encoding whole texts, because merges never cross the pattern's words.
Decoding joins ids to their pieces of bytes. The vocabulary file is a parameter; it has a fixed size (about 1.5 MB,
50,257 pieces) and is all that is sent to the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import materialize
from . import blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# White space as the tokenizer's pattern means it (Java's \s is ASCII only).
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The tokenizer's pattern, with \s written out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


# The same words: most are ASCII letters up to something else, which takes fewer comparisons to see.
QUICK = PATTERN.replace(r"| ?\p{L}+|", r"| ?[A-Za-z]++(?!\p{L})| ?\p{L}+|", 1)
# A stretch from white space to white space with a character that Java's Unicode tables do not know.
UNKNOWN = rf"[{SPACE}]*+[^{SPACE}\p{{Cn}}]*+\p{{Cn}}[^{SPACE}]*+"


def split_words(text: Column) -> Column:
    """The tokenizer's words of a text in order; their concatenation is the text. A stretch between white space with
    characters that Java's Unicode tables do not know stays in one piece, with the white space before it: the tokenizer
    splits those itself, and no word of it crosses their ends. Null gives null, empty an empty array."""
    both = F.regexp_extract_all(text, F.lit(f"{UNKNOWN}|{QUICK}"), F.lit(0))
    return F.when(text.rlike(r"\p{Cn}"), both).otherwise(F.regexp_extract_all(text, F.lit(QUICK), F.lit(0)))


def encode_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, result array<int>): ids of each distinct word, without special tokens; their strings are plain text."""
    with open(vocabulary, encoding="utf-8") as f:
        model = words.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.value)
        tokenizer.encode_special_tokens = True
        for b in batches:
            ids = [e.ids for e in tokenizer.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "result"])

    return words.select("word").mapInArrow(run, "word string, result array<int>")


def encode(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of every row: an empty list for an empty or null text. Rows that repeat repeat in the
    result; other columns are ignored; an empty table gives no rows. Texts are processed whole."""
    made = blocks.build(docs, doc_id, text, SPACE, split_words, "tokens")
    coded = materialize(encode_words(blocks.distinct_words(made), vocabulary), "words")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs_, sizes = (b.column(c)[i].values for c in ("docs", "sizes"))
                codes = np.frombuffer(b.column("codes")[i].as_buffer(), np.int32)
                ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
                found = b.column("found")[i]
                if found.is_valid and len(codes):
                    slots = found.values.field("slot").to_numpy()
                    lists = found.values.field("result")
                    lengths = np.zeros(int(slots.max()) + 1, np.int64)
                    begins = np.zeros(len(lengths), np.int64)
                    offsets = lists.offsets.to_numpy()
                    lengths[slots], begins[slots] = np.diff(offsets), offsets[:-1] - offsets[0]
                    flat = lists.flatten().to_numpy()
                    n = lengths[codes]
                    upto = np.cumsum(n)
                    ids = flat[np.arange(upto[-1]) + np.repeat(begins[codes] - (upto - n), n)]
                    cuts = np.concatenate([[0], upto])[np.concatenate([[0], ends])]
                else:
                    ids, cuts = np.zeros(0, np.int32), np.zeros(len(ends) + 1, np.int64)
                step = 2000
                for at in range(0, len(docs_), step):
                    part = cuts[at : at + step + 1]
                    lists = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(ids[part[0] : part[-1]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([docs_.slice(at, step), lists], [doc_id, "ids"])

    placed = blocks.attach(made, coded).select("docs", "sizes", "codes", "found")
    return placed.mapInArrow(place, f"`{doc_id}` long, ids array<int>")


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece binary) of the vocabulary: the bytes of every id."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    # byte-level vocabularies write a byte as itself where it is printable, the others from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    rows = [(i, bytearray(byte[c] for c in p)) for p, i in model["model"]["vocab"].items()]
    rows += [(t["id"], bytearray(t["content"].encode())) for t in model.get("added_tokens", ())]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, doc_id: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): ids joined to their pieces, concatenated by position. doc_id is unique. An empty or null list
    gives an empty text; an id that is not in the vocabulary gives nothing. Bytes that are not UTF-8 are replaced."""
    table = pieces(encoded.sparkSession, vocabulary).select("id", F.hex("piece").alias("hex"))
    each = encoded.select(doc_id, F.posexplode_outer(ids).alias("pos", "id"))
    joined = each.join(F.broadcast(table), "id", "left")  # 50,257 rows, whatever the corpus
    parts = F.sort_array(F.collect_list(F.when(F.col("hex").isNotNull(), F.struct("pos", "hex"))))
    whole = joined.groupBy(doc_id).agg(parts.alias("parts"))
    return whole.select(doc_id, F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8").alias("text"))
