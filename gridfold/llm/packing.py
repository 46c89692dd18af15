"""Packing by power-of-two decomposition: no sequence holds pieces of two documents.

A document's ids are cut into as many pieces of the full length as fit, then into pieces of
the binary digits of the rest, longest first. A piece is a sequence of its own, whose length
is a power of two; `bucket` (its binary logarithm) groups sequences of equal length, so a
batch drawn from one bucket has no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridfold.llm.common import whole_text

FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
#: Rows of an output batch, so that a very long document doesn't make a very large one.
ROWS = 20_000
#: A run of white space on which the faster library's pattern may exceed its stack.
BLANK = 10_000
BLANKS = re.compile(rf"(?<!\s)\s{{{BLANK}}}")


def load_encoder(path: str):
    """A function from a text to its ids, as the vocabulary file's own library gives them.

    For a byte-level BPE in .json form with ranks beside it (.tiktoken) the faster library is
    used; both hold the same vocabulary and give the same ids (checked in the tests). Texts
    with very long runs of white space, which it can't split, go through the other.
    """
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = Tokenizer.from_file(path)
        special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        marks = list(special)

        def encode(text: str) -> list[int]:
            if len(text) >= BLANK and BLANKS.search(text):
                return own.encode(text, add_special_tokens=False).ids
            if any(m in text for m in marks):
                return enc.encode(text, allowed_special="all")
            return enc.encode_ordinary(text)

        return encode
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; `most` is a power of two."""
    out = [(i, most) for i in range(0, n - n % most, most)]
    at = n - n % most
    while most := most >> 1:
        if n & most:
            out.append((at, most))
            at += most
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id",), most: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns `keep`, those of FIELDS, and `ids` if asked for.

    Null and empty texts have the one id `end_id` and so one piece of length 1. Repeated rows
    are packed each into sequences of their own; a text of any length is encoded as a whole.
    Extra columns are ignored unless kept. `sequence_id` is the task's number and a
    counter within it: unique in the result, and the same again if a lost task is run anew on
    the same input split.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(FIELDS), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    names, n = schema.names, len(keep)
    types = (*(pa.int64(),) * 6, pa.int32(), *((pa.binary(),) if with_ids else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        import public_tokenizers

        encode = load_encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            owners: list[int] = []
            for i, text in enumerate(batch.column(n)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = memoryview(array("I", ids).tobytes())
                for start, length in cut(len(ids), most):
                    piece = raw[4 * start : 4 * (start + length)]
                    rows.append((start, length, zlib.crc32(piece), len(ids), sequence, 0, length.bit_length() - 1, *((bytes(piece),) if with_ids else ())))
                    owners.append(i)
                    sequence += 1
                if len(rows) >= ROWS:
                    yield _batch(batch, owners, rows, n, types, names)
                    rows, owners = [], []
            if rows:
                yield _batch(batch, owners, rows, n, types, names)

    return docs.select(*keep, whole_text(docs).alias("_text")).mapInArrow(run, schema)


def _batch(batch, owners, rows, n, types, names):
    own = pa.array(owners, pa.int32())
    return pa.RecordBatch.from_arrays([*(c.take(own) for c in batch.columns[:n]), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names)
