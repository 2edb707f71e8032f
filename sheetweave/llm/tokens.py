"""Token counts with overlap resynchronisation for huge documents.

A document longer than a chunk is encoded as overlapping chunks, with offsets. Two neighbours are spliced at a
position that both cannot help but share: the tokenizer drops white space before its merges, its normalisation (NFC,
lower case) never joins across ASCII white space, and none of its special strings holds white space. So what stands
between two ASCII white spaces encodes alike in any chunk that holds both. The tokens between the first and the last
such position of an overlap are compared; where they differ, or an overlap holds fewer than two such positions, the
overlap is widened, in the end to the whole of both chunks.

A document within one chunk needs no splice. For the same reason its count is the sum of those of its words between
ASCII white spaces, so each distinct word goes through the library once and is remembered.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, text_bytes

CHUNK = 16_384
OVERLAP = 256
LIMIT = 2048
#: Words that a worker remembers, about 100 MB, also from task to task; beyond that, those of the latest batch only.
REMEMBERED = 500_000
#: A word longer than this is not remembered.
LONG_WORD = 256
_EDGE = re.compile(r"(?<=[^ \t-\r])(?=[ \t-\r])")


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _known(path: str) -> dict[bytes, int]:
    """Counts of words by one tokenizer, for all tasks of this worker."""
    return {}


def _encoded(tokenizer, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of text[lo:hi], in positions of the whole text."""
    e = tokenizer.encode(text[lo:hi], add_special_tokens=False)
    return [(lo + a, lo + b, i) for (a, b), i in zip(e.offsets, e.ids)]


def _splice(tokenizer, text: str, left: tuple, right: tuple) -> tuple[int, tuple]:
    """Spans are (lo, hi, settled, tokens from settled on). The left span's tokens up to a shared position are counted
    and left behind; the span returned goes on from there."""
    (lo, a_hi, settled, a), (b_lo, hi, _, b) = left, right
    widen = a_hi - b_lo
    while True:
        edges = [m.start() for m in _EDGE.finditer(text, max(b_lo, settled) + 1, a_hi)]
        if len(edges) > 1:
            first, last = edges[0], edges[-1]
            if [t for t in a if first <= t[0] and t[1] <= last] == [t for t in b if first <= t[0] and t[1] <= last]:
                return sum(t[1] <= first for t in a), (b_lo, hi, first, [t for t in b if t[0] >= first])
        if b_lo <= lo and a_hi >= hi:  # nothing shared: both spans in one
            return 0, (lo, hi, settled, [t for t in _encoded(tokenizer, text, lo, hi) if t[0] >= settled])
        b_lo, a_hi, widen = max(lo, b_lo - widen), min(hi, a_hi + widen), 2 * widen
        a = [t for t in _encoded(tokenizer, text, lo, a_hi) if t[0] >= settled]
        b = _encoded(tokenizer, text, b_lo, hi)


def count_huge(tokenizer, text: str, chunk: int | None = None, overlap: int | None = None) -> int:
    """Tokens of a text by overlapping chunks."""
    chunk, overlap = chunk or CHUNK, overlap or OVERLAP
    first = min(len(text), chunk)
    total, span = 0, (0, first, 0, _encoded(tokenizer, text, 0, first))
    while span[1] < len(text):
        # After spans that had to be encoded as one, the next chunk is as long as they are: no text is encoded too often.
        lo = max(0, span[1] - overlap)
        hi = min(len(text), lo + max(chunk, span[1] - span[0]))
        done, span = _splice(tokenizer, text, span, (lo, hi, lo, _encoded(tokenizer, text, lo, hi)))
        total += done
    return total + len(span[3])


def count_batch(tokenizer, texts: list[bytes], known: dict[bytes, int]) -> list[int]:
    """Tokens of each UTF-8 text. known: counts of words, kept by the caller between batches."""
    split = [x.split() if len(x) <= CHUNK else None for x in texts]
    words = {w for ws in split if ws for w in ws}
    new = list(words.difference(known))
    if len(known) + len(new) > REMEMBERED:  # those that this batch knows again stay
        again = {w: known[w] for w in words if w in known}
        known.clear()
        known.update(again)
    del words
    for i in range(0, len(new), 4096):
        part = new[i : i + 4096]
        known.update(zip(part, (len(e) for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False))))
    out = [sum(map(known.__getitem__, ws)) if ws is not None else count_huge(tokenizer, x.decode("utf-8", "replace")) for x, ws in zip(texts, split)]
    for w in new:
        if len(w) > LONG_WORD:
            del known[w]
    return out


def count(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LIMIT, out: str = "tokens") -> tuple[DataFrame, str]:
    """docs with one more column (struct: n_bytes, n_tokens, over_limit), named `out` or a longer name if docs has that.

    Counts are the tokenizers library's own for the whole text, without special tokens added. A null text counts as an
    empty one, 0 bytes and 0 tokens. Texts of any length are counted whole. Rows, also repeated ones, neither appear nor
    go; other columns stay whatever their names; an empty table stays empty. tokenizer_path is read on the workers. The splices hold
    for tokenizers that drop white space before merging, like word_bpe_49k.json.
    """

    @F.arrow_udf("bigint")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer, known = _tokenizer(tokenizer_path), _known(tokenizer_path)
        for batch in texts:
            yield pa.array(count_batch(tokenizer, batch.to_pylist(), known), pa.int64())

    name = free_name(docs, out)
    body = text_bytes(column(docs, text_col))
    with_n = docs.withColumn(name, counted(body))
    n = column(with_n, name)
    return with_n.withColumn(name, F.struct(F.octet_length(body).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))), name
