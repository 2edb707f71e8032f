"""License scans: exact base phrases and a fuzzy search for short notices.

Fuzzy search: a notice that occurs with at most k edits holds at least one of its k + 1 pieces unchanged (pigeonhole).
One Aho-Corasick pass finds all pieces of all notices; around each hit a window of the notice's length plus k is
checked by the regex library's bounded-error matching, which gives the span and the number of edits.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, pieces, text_bytes

#: Phrases of the base labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices as lower-case words, and the label each adds (fixed values). Sentences, then names, then identifiers.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under the gnu general public license", "gpl"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause"),
    ("subject to the terms of the mozilla public license", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
    ("apache license version 2 0", "apache-2.0"),
    ("apache license 2 0", "apache-2.0"),
    ("mit license", "mit"),
    ("isc license", "isc"),
    ("zlib license", "zlib"),
    ("unlicense", "unlicense"),
    ("boost software license", "bsl-1.0"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("simplified bsd license", "bsd-2-clause"),
    ("new bsd license", "bsd-3-clause"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("artistic license", "artistic"),
    ("academic free license", "afl"),
    ("open software license", "osl"),
    ("python software foundation license", "psf"),
    ("sil open font license", "ofl-1.1"),
    ("open database license", "odbl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons zero", "cc0-1.0"),
    ("cc0 1 0 universal", "cc0-1.0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
)
#: Identifiers behind "SPDX-License-Identifier:" (fixed values).
IDENTIFIERS = (
    "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0",
    "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib",
)
#: Characters of a notice for each edit allowed; names of fewer than twice as many must stand as they are.
CHARS_PER_EDIT = 11
_TAG = "spdx license identifier "

RESULT = "n_words bigint, base array<struct<label string, word int>>, spans array<struct<label string, first_word int, last_word int, edits int>>, score double"
_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32())]))),
    ("score", pa.float64()),
])
#: Letters are lowered; bytes outside words (ASCII other than digits and lower-case letters) become spaces.
_TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def edits_allowed(notice: str) -> int:
    """Of an identifier none: its letters tell it from others."""
    return 0 if notice.startswith(_TAG) else max(0, len(notice) // CHARS_PER_EDIT - 1)


@functools.cache
def notices() -> tuple[tuple[str, str], ...]:
    """All (notice, label): NOTICES, and each identifier behind its tag."""
    tagged = {_TAG + " ".join(re.findall(r"[a-z0-9]+", i.lower())): i.lower() for i in IDENTIFIERS}
    return *NOTICES, *tagged.items()


@functools.cache
def _machine():
    """The automaton of all pieces and the verifying patterns, once for each worker."""
    import ahocorasick
    import regex

    pieces: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (notice, _) in enumerate(notices()):
        k = edits_allowed(notice)
        cuts = [round(j * len(notice) / (k + 1)) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(notice[a:b], []).append((i, a))
        patterns.append((k, regex.compile(rf"(?b)\b(?:{regex.escape(notice)}){{e<={k}}}\b")))
    found = ahocorasick.Automaton()
    for piece, places in pieces.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found, patterns


def _windows(joined: str) -> dict[int, list[list[int]]]:
    """Stretches of whole words around the seeds of each notice, in order and apart from each other."""
    automaton, patterns = _machine()
    every: dict[int, list[tuple[int, int]]] = {}
    for end, (length, places) in automaton.iter(joined):
        for i, offset in places:
            k, n = patterns[i][0], len(notices()[i][0])
            start = end + 1 - length - offset
            every.setdefault(i, []).append((max(0, start - k - 1), min(len(joined), start + n + k + 1)))
    out = {}
    for i, found in every.items():
        own: list[list[int]] = []
        for lo, hi in sorted(found):
            if own and lo <= own[-1][1]:
                own[-1][1] = max(hi, own[-1][1])
            else:
                own.append([lo, hi])
        for w in own:  # grown to whole words, so that no edge of a window passes for the end of a word
            w[0], w[1] = joined.rfind(" ", 0, w[0]) + 1, joined.find(" ", w[1]) if joined.find(" ", w[1]) >= 0 else len(joined)
        out[i] = own
    return out


def scan_text(text: bytes) -> dict:
    """The scan of one text, given as UTF-8: words, base places, spans of fuzzy notices (words from 0), score.

    In a window the best occurrence is taken first, then what stands before and behind it is searched again."""
    tokens = text.translate(_TABLE).split()
    joined = b" ".join(tokens).decode("utf-8", "replace")
    base = []
    for phrase, label in BASE.items():
        if phrase in joined:
            parts = phrase.encode().split()
            base += [{"label": label, "word": i} for i, w in enumerate(tokens) if w == parts[0] and tokens[i : i + len(parts)] == parts]
    spans, score = [], 1.0 if base else 0.0
    patterns = _machine()[1]
    begins: list[int] | None = None
    for i, own in sorted(_windows(joined).items()):
        notice, label = notices()[i]
        todo = own[::-1]
        while todo:
            lo, hi = todo.pop()
            m = patterns[i][1].search(joined, lo, hi) if lo < hi else None
            if not m:
                continue
            todo += [(m.end(), hi), (lo, m.start())]
            if begins is None:
                begins = [0, *(x.end() for x in re.finditer(" ", joined))]
            edits, at = sum(m.fuzzy_counts), m.start() + len(m[0]) - len(m[0].lstrip())
            first = bisect.bisect_right(begins, at) - 1
            spans.append({"label": label, "first_word": first, "last_word": first + m[0].strip().count(" "), "edits": edits})
            score = max(score, 1.0 - edits / len(notice))
    return {"n_words": len(tokens), "base": base, "spans": spans, "score": score}


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pieces(texts):
        yield pa.array((scan_text(x.as_py()) for x in batch), type=_ARROW)


def scan(docs: DataFrame, text_col: str = "text", out: str = "license") -> tuple[DataFrame, str]:
    """docs with one more column, named `out` or, should docs have that, a longer name; the name is returned too.

    The column holds n_words, base (label and word of each exact phrase), spans of fuzzy notices and score, 1 less the
    share of edited characters of the best notice (1 for a base phrase, 0 for none). A null text scans as an empty one:
    no words, no spans, score 0. Texts of any length are scanned whole, in time that grows with length and occurrences.
    Repeated rows scan alike, other columns stay whatever their names, rows neither appear nor go; an empty table stays
    empty.
    """
    name = free_name(docs, out)
    return docs.withColumn(name, F.arrow_udf(_scan, RESULT)(text_bytes(column(docs, text_col)))), name


def digest(s: Column) -> list[Column]:
    """The contract's columns of a scan."""
    base = F.sort_array(F.array_distinct(s["base"]["label"]))
    every = F.sort_array(F.array_distinct(F.concat(s["base"]["label"], s["spans"]["label"])))
    return [
        s["n_words"].alias("n_words"),
        F.size(s["base"]).cast("long").alias("n_base"),
        F.array_min(s["base"]["word"]).cast("long").alias("first_word"),
        F.array_max(s["base"]["word"]).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        s["score"].alias("score"),
    ]
