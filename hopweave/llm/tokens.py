"""Token counts with a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids; characters that UTF-8 lacks count as replacement characters."""
    return encoder(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` without its text, with the text's token count; a null text has none (0)."""
    import pyarrow as pa

    keep = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [0 if x is None else len(e.encode_ordinary(x)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, out])

    return df.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(run, schema)
