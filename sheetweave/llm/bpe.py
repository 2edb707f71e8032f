"""Byte-level BPE encoding and decoding as a monoid reduced over a tree.

A text is halved until pieces are short; pieces are encoded and neighbours joined. A join re-encodes a window around
the seam that grows until it begins and ends at positions where the splitting pattern always ends a match, whatever
stands around: from text that is not white space to white space; from a letter or a digit to another class; from
other signs to a letter or digit, but for the apostrophe, which may open a contraction. No match spans such a
position and none looks beyond it, so tokens outside the window are final. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, pieces, text_bytes

LEAF = 4096
WINDOW = 64
_SIGN = r"!-&(-/:-@\[-`{-~"  # ASCII signs without the apostrophe
_SURE = rf"(?<=[\p{{L}}\p{{N}}{_SIGN}'])(?=[ \n\t])|(?<=\p{{L}})(?=[\p{{N}}{_SIGN}'])|(?<=\p{{N}})(?=[\p{{L}}{_SIGN}'])|(?<=[{_SIGN}])(?=[\p{{L}}\p{{N}}])"


class Codec:
    """Encodes and decodes by the ranks of one file, with the pattern given."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.sure = regex.compile(_SURE)

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= LEAF:
            return self.library.encode_ordinary(text[lo:hi])
        cut = (lo + hi) // 2
        return self._join(text, lo, cut, hi, self.encode(text, lo, cut), self.encode(text, cut, hi))

    def _join(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        reach = WINDOW
        while True:
            a, b = max(lo, cut - reach), min(hi, cut + reach)
            # Edges of the window count only with a character before and behind them, and lo and hi are edges themselves.
            start = lo if a == lo else next((m.start() for m in self.sure.finditer(text, a, cut) if m.start() > a), None)
            end = hi if b == hi else next((m.start() for m in self.sure.finditer(text, cut + 1, b)), None)
            if start is not None and end is not None:
                keep = self._places(left, len(text[start:cut].encode()), -1)
                skip = self._places(right, len(text[cut:end].encode()), 1)
                if keep is not None and skip is not None:
                    return left[: len(left) - keep] + self.library.encode_ordinary(text[start:end]) + right[skip:]
            if a == lo and b == hi:
                return self.library.encode_ordinary(text[lo:hi])
            reach *= 2

    def _places(self, ids: list[int], n: int, step: int) -> int | None:
        """Tokens from one end that make up n bytes exactly, or None."""
        used = 0
        for i in ids if step > 0 else reversed(ids):
            if n <= 0:
                break
            n -= len(self.bytes[i])
            used += 1
        return used if n == 0 else None

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def transcode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "bpe") -> tuple[DataFrame, str]:
    """docs with one more column (struct: ids, decoded), named `out` or a longer name if docs has that.

    ids are those that the tiktoken library gives for the whole text, without special tokens; decoded are the bytes
    that they stand for. A null text is encoded as an empty one: no ids, no bytes. Bytes that are no UTF-8 are replaced
    before encoding. Texts of any length are encoded whole, by the tree. Rows, also repeated ones, neither appear nor go;
    other columns stay whatever their names; an empty table stays empty. ranks_path is read on the workers.
    """

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(ranks_path, pattern)
        for batch in pieces(texts):
            ids, decoded, at = [], [], [0]
            for x in batch:
                got = own.encode(x.as_py().decode("utf-8", "replace"))
                ids.append(np.array(got, dtype=np.int32))
                decoded.append(own.decode(got))
                at.append(at[-1] + len(got))
            values = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    name = free_name(docs, out)
    return docs.withColumn(name, both(text_bytes(column(docs, text_col)))), name


def digest(s: Column) -> list[Column]:
    """The contract's columns of a transcoding."""
    ids = F.array_join(s["ids"].cast("array<string>"), " ")
    return [F.size(s["ids"]).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(s["decoded"], 256).alias("decoded_sha256")]
