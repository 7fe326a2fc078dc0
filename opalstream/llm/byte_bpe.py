"""Byte-level BPE by the tiktoken library and a local rank file: texts to ids, ids to raw bytes.

`encode_texts` adds a column of ids, `decode_ids` one of bytes; both take whole values, a batch of rows at a
time, and keep every other column.  A text's ids are those of its pre-tokens (matches of the pattern) one after
the other, so a long text may be cut wherever a match ends whatever stands around it, and its parts encoded one by one:

* between a character and white space after it, as no alternative of the pattern goes from one to the other and
  the look-ahead is of white space alone;
* before the last character of a run of white space that something follows: the run but for that character is
  one match.

A run of white space longer than RUN is one match of a look-ahead that the library's pattern engine can't go
back over (it ends the process's thread from some million characters on), so it is handed to the merges alone.  A
stretch without white space has no such place and is encoded as one part.

Null texts are as empty ones and give no ids; null ids give no bytes.  Ids that the vocabulary lacks, which no
encoder makes, give null bytes.  Special tokens have no meaning: their strings are ordinary text.  Equal rows give
equal rows; an empty table gives an empty one.  A column that has the name of the new one is replaced.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from opalstream.llm.common import light_batches
from opalstream.llm.tokens import vocabulary_path

RANKS = "byte_bpe_50k.tiktoken"
#: A long text is cut at the first safe place after so many characters.
PORTION = 1 << 16
RUN = 1 << 18
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
_WHITE = regex.compile(r"\p{White_Space}{2,}")


def safe_parts(text: str, portion: int = PORTION) -> Iterator[str]:
    """text in parts that are encoded independently; each of `portion` characters at least, but for the last."""
    at = 0
    while len(text) - at > portion and (m := _SAFE.search(text, at + portion)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Codec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {rank: token for token, rank in ranks.items()}

    def _ids(self, part: str, run: int) -> Iterator[list[int]]:
        at = 0
        if len(part) > run:
            for m in _WHITE.finditer(part):
                if m.end() - m.start() > run:
                    yield self.encoding.encode_ordinary(part[at : m.start()])
                    end = m.end() - (m.end() < len(part))
                    yield self.encoding._encode_single_piece(part[m.start() : end].encode())
                    at = end
        yield self.encoding.encode_ordinary(part[at:] if at else part)

    def encode(self, text: str | None, portion: int = PORTION, run: int = RUN) -> np.ndarray:
        ids = [np.array(x, np.int32) for part in safe_parts(text or "", portion) for x in self._ids(part, run)]
        return ids[0] if len(ids) == 1 else np.concatenate(ids)

    def decode(self, ids: np.ndarray) -> bytes | None:
        try:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        except KeyError:
            return None


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _with_column(df: DataFrame, name: str, kind, of, source: str) -> DataFrame:
    """df with a column made by `of` from the Arrow array of `source`, batch by batch."""
    light_batches(df.sparkSession)
    df = df.drop(name) if name != source and name in df.columns else df
    schema = StructType([f for f in df.schema.fields if f.name != name] + [StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = of(b.column(b.schema.get_field_index(source)))
            kept = [(f, b.column(i)) for i, f in enumerate(b.schema) if f.name != name]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), new], schema=pa.schema([*(f for f, _ in kept), pa.field(name, new.type)]))

    return df.mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the ids of each whole text, array<int>."""
    path, pattern = path or vocabulary_path(RANKS), pattern or _pattern()

    def of(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        rows = [own.encode(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        if ends[-1] >= 1 << 31:
            raise ValueError("a batch of texts has more than two thousand million ids: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    return _with_column(df, ids, ArrayType(IntegerType()), of, text)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "bytes", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the bytes that each row's ids stand for; not text, as any ids may be cut within a character."""
    path, pattern = path or vocabulary_path(RANKS), pattern or _pattern()

    def of(lists: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([None if x.as_py() is None else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists], pa.binary())

    return _with_column(df, out, BinaryType(), of, ids)


def bpe_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op11: each text's ids, and the bytes decoded from them."""
    both = decode_ids(encode_texts(docs.select("doc_id", "text")).drop("text"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
