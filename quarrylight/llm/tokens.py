"""Operator 5, token counts: every distinct pre-token is encoded once and joined to the documents' frequencies."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import written

#: Fixed split pattern of the word-end vocabulary, applied to lower-case text, and its two special strings.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: Characters of texts that a task splits before it passes their pre-tokens and frequencies on as one block.
HELD = 32 << 20


def pieces(text: str) -> tuple[list[str], int]:
    """The pre-tokens of `text` and how many special strings it holds, which count as one token each."""
    parts = SPECIAL.split(text) if "<|" in text else [text]
    found: list[str] = []
    for part in parts:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each letter alone is put in lower case
        found += PIECE.findall(part.lower())
    return found, len(parts) - 1


@cache
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def _blocks(kind: pa.DataType):
    """Cuts (doc_id, n_bytes, text) into blocks, each text split once. Of a block there are three sorts of rows:

    (block, pos, piece) for each distinct pre-token, numbered; (block, pos, doc_id, n_bytes) for each text; and one
    (block, frequencies), which packs for each text its special strings, the numbers of its distinct pre-tokens and
    how often they occur.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        known: dict[str, int] = {}
        ids: list[pa.Array] = []
        sizes: list[pa.Array] = []
        texts: list[tuple[int, np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            block = task + number
            doc_ids, n_bytes = pa.chunked_array(ids, kind).combine_chunks(), pa.chunked_array(sizes).combine_chunks()
            packed = _packed([np.array([len(texts)], np.int32), np.array([t[0] for t in texts], np.int32), np.array([len(t[1]) for t in texts], np.int32), *(np.diff(t[1], prepend=np.int32(0)) for t in texts), *(t[2] for t in texts)])
            yield _row_kinds(block, len(known), piece=pa.array(list(known), pa.string()), doc_id=pa.nulls(len(known), kind))
            yield _row_kinds(block, len(texts), doc_id=doc_ids, n_bytes=n_bytes)
            yield _row_kinds(block, 1, frequencies=pa.array([packed], pa.binary()), doc_id=pa.nulls(1, kind))

        for batch in batches:
            begin, held = 0, 0
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                found, special = pieces(text)
                each = Counter(found)
                at = np.fromiter((known.setdefault(p, len(known)) for p in each), np.int32, len(each))
                order = np.argsort(at)
                texts.append((special, at[order], np.fromiter(each.values(), np.int32, len(each))[order]))
                held += len(text)
                if held >= HELD:
                    ids.append(batch.column(0)[begin : i + 1])
                    sizes.append(batch.column(1)[begin : i + 1])
                    yield from rows()
                    known, ids, sizes, texts, begin, held, number = {}, [], [], [], i + 1, 0, number + 1
            ids.append(batch.column(0)[begin:])
            sizes.append(batch.column(1)[begin:])
        if texts:
            yield from rows()

    return cut


def _row_kinds(block: int, n: int, doc_id: pa.Array, piece: pa.Array | None = None, n_bytes: pa.Array | None = None, frequencies: pa.Array | None = None) -> pa.RecordBatch:
    pos = pa.array(np.arange(n, dtype=np.int32))
    filled = lambda found, kind: pa.nulls(n, kind) if found is None else found
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block, np.int64)), pos, filled(piece, pa.string()), doc_id, filled(n_bytes, pa.int64()), filled(frequencies, pa.binary())],
        ["block", "pos", "piece", "doc_id", "n_bytes", "frequencies"],
    )


def _packed(parts: list[np.ndarray]) -> bytes:
    """32-bit numbers, small ones mostly, compressed with their low bytes first, then the next ones."""
    return zstandard.compress(np.concatenate(parts).astype(np.int32, copy=False).view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _encoded(tokenizer: str):
    """Number of tokens of each pre-token; equal ones come one after the other and are encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens = None, 0
        for batch in batches:
            piece = batch["piece"].to_numpy(object)
            new = np.append(True, piece[1:] != piece[:-1]) if len(piece) else np.zeros(0, bool)
            distinct = piece[new].tolist()
            known = distinct and distinct[0] == last
            found = _tokenizer(tokenizer).encode_batch(distinct[bool(known) :], add_special_tokens=False)
            each = np.array([*([tokens] if known else []), *(len(e.ids) for e in found)], np.int32)
            if distinct:
                last, tokens = distinct[-1], int(each[-1])
            yield pd.DataFrame({"block": batch["block"], "pos": batch["pos"], "tokens": each[np.cumsum(new) - 1]})

    return encode


def _summed(frequencies: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
    """(block, pos, n_tokens) of a block's texts, from its frequencies and the numbers of tokens of its pre-tokens."""
    data = _unpacked(frequencies["frequencies"].iloc[0])
    n = int(data[0])
    special, lengths = data[1 : n + 1], data[n + 1 : 2 * n + 1]
    total = int(lengths.sum())
    steps, counts = data[2 * n + 1 : 2 * n + 1 + total].astype(np.int64), data[2 * n + 1 + total :]
    first = np.cumsum(lengths) - lengths
    run = np.cumsum(steps)
    at = run - np.repeat(np.append(0, run)[first], lengths)
    each = np.zeros(len(tokens), np.int64)
    each[tokens["pos"].to_numpy()] = tokens["tokens"].to_numpy()
    sums = np.append(0, np.cumsum(each[at] * counts))
    return pd.DataFrame({"block": frequencies["block"].iloc[0], "pos": np.arange(n), "n_tokens": sums[first + lengths] - sums[first] + special})


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens and over_limit (n_tokens > `limit`) for every row, over whole texts.

    Every text is split once, in blocks of some 32 million characters; the distinct pre-tokens of all blocks meet by
    a shuffle, where each is encoded once, and go back to the texts' frequencies by another. A pre-token counts once
    a block, so no key is hot, and nothing passes the driver. Null and empty texts have no tokens and an empty table
    gives an empty one. Rows count by themselves, so ties, repeated rows and null ids keep their own counts; ids keep
    their type. A very long text is a block of its own, held by one task. Columns other than these two are left out,
    whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType
    schema = StructType([StructField(n, t) for n, t in (("block", LongType()), ("pos", IntegerType()), ("piece", StringType()), ("doc_id", kind), ("n_bytes", LongType()), ("frequencies", BinaryType()))])
    found = written(rows.mapInArrow(_blocks(to_arrow_type(kind)), schema), "frequencies", "zstd")
    pre_tokens = found.filter("piece is not null").select("piece", "block", "pos")
    tokens = pre_tokens.repartition("piece").sortWithinPartitions("piece").mapInPandas(_encoded(tokenizer), "block long, pos int, tokens int")
    packed = found.filter("frequencies is not null").select("block", "frequencies")
    counted = packed.groupBy("block").cogroup(tokens.groupBy("block")).applyInPandas(_summed, "block long, pos int, n_tokens long")
    texts = found.filter("n_bytes is not null").select("block", "pos", "doc_id", "n_bytes")
    return texts.join(counted, ["block", "pos"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
