"""Fill-in-middle: texts cut at two token borders and reordered around sentinels.

Tokens come from the tokenizers library's Split pre-tokenizer with isolated matches of a pattern, which needs no
training: it gives code-point offsets, the length of the offset array is the number of tokens, and the two cuts are
looked up in it by rank. Where to cut and in which form follows from a hash of a seed and the document's id alone.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, give_back, text_bytes

#: A token is white space (ASCII) with the word behind it, or the white space at a text's end.
PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Sentinels before prefix, suffix and middle. None of them can begin within another, so outputs are read back uniquely.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents: how many are reordered, and of these how many with the suffix first.
RATE, SPM_RATE = 50, 80
#: Code points that are split at a time, so that a huge text's offsets are never all objects.
PIECE = 262_144
#: A place behind which a token begins, whatever stands before.
_BORDER = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@functools.cache
def _splitter():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), "isolated")


def token_ends(text: str) -> np.ndarray:
    """Where each token of a text ends, in code points."""
    split, lo, parts = _splitter().pre_tokenize_str, 0, []
    while lo < len(text):
        hi = len(text)
        if hi - lo > PIECE:
            border = _BORDER.search(text, lo + PIECE)
            hi = border.start() if border else hi
        parts.append(np.array([end for _, (_, end) in split(text[lo:hi])], np.int64) + lo)
        lo = hi
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def arrange(text: str, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text; lengths are None where it stays plain."""
    ends = token_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    body, _, middle = output[len(first) :].partition(MIDDLE)
    one, _, two = body.partition(second)
    return two + middle + one if form == "spm" else one + middle + two


_OUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, out: str = "fim"
) -> tuple[DataFrame, str]:
    """docs with one more column (struct: n, form, prefix_chars, middle_chars, output), named `out` or a longer name if docs has that.

    A null or empty text, and one that holds a sentinel, stays plain; n counts its tokens all the same. A null id hashes
    as an empty one. Bytes that are no UTF-8 are replaced before. Texts of any length are cut whole. Rows, also repeated
    ones, come out one for one, rows of equal id and text alike; other columns stay whatever their names; an empty table
    stays empty. One pass without a shuffle.
    """

    @F.arrow_udf(_OUT)
    def arranged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = [f.split()[0] for f in _OUT.split(", ")]
        for texts, keys in batches:
            for lo in range(0, len(texts), 1_000):
                rows = [arrange(t.as_py().decode("utf-8", "replace"), k.as_py(), seed, rate, spm_rate) for t, k in zip(texts[lo : lo + 1_000], keys[lo : lo + 1_000])]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        give_back()

    name = free_name(docs, out)
    return docs.withColumn(name, arranged(text_bytes(column(docs, text_col)), F.coalesce(column(docs, id_col).cast("string"), F.lit("")))), name


def restore(docs: DataFrame, made: str, out: str = "restored") -> tuple[DataFrame, str]:
    """docs with the texts that column `made` of transform() was made of, from output and form alone."""

    @F.arrow_udf("string")
    def rebuilt(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            for lo in range(0, len(outputs), 1_000):
                yield pa.array([rebuild(o.as_py(), f.as_py()) for o, f in zip(outputs[lo : lo + 1_000], forms[lo : lo + 1_000])], pa.string())
        give_back()

    name = free_name(docs, out)
    s = column(docs, made)
    return docs.withColumn(name, rebuilt(s["output"], s["form"])), name


#: The contract's rows in DuckDB.
SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents
), hashed AS (
  SELECT doc_id, x, t, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut
), placed AS (
  SELECT doc_id, x, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, x, n, form, array_to_string(list_slice(t, 1, a), '') AS p, array_to_string(list_slice(t, a + 1, b), '') AS m, array_to_string(list_slice(t, b + 1, n), '') AS s
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM parts
"""
