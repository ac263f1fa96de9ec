"""The whole corpus as ids of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-splitting pattern that belongs to the rank files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are cut at safe boundaries into pieces of about so many characters.
PIECE = 20_000
#: Places that no token of PATTERN spans: before white space that follows
#: something else, and between letters and digits. Only characters that every
#: engine takes for white space, and for none, count.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \t\r\n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The rank file ``name`` in ``folder``, or else in the installed package of public tokenizers."""
    if folder:
        return f"{folder}/{name}"
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a rank file, once per Python worker; it has no special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at safe boundaries, so that its ids are the pieces' ids in order.

    A stretch without any boundary stays whole, however long.
    """
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of ``text``; null and empty texts have none."""
    if not text:
        return np.empty(0, dtype=np.int32)
    if len(text) <= PIECE:
        return np.asarray(enc.encode_ordinary(text), dtype=np.int32)
    return np.concatenate([np.asarray(enc.encode_ordinary(p), dtype=np.int32) for p in pieces(text)])


def decode(enc, ids: Iterable[int]) -> bytes:
    """The raw bytes of ``ids``; a text's bytes come back exactly."""
    return enc.decode_bytes(list(ids))


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` array<int> of every row; no shuffle, one pass over the texts in Arrow batches.

    Null and empty texts give an empty list; what spells a special token is
    ordinary text. Repeated rows are encoded each, other columns not read.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            ids = [encode(enc, t) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    kind = dict(df.dtypes)[key]
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(encoded_rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``n_tokens`` of :func:`encoded` rows."""
    return encoded_rows.select(key, F.size("ids").alias("n_tokens"))
