"""Fill-in-middle, substring dedup and conversation repair: brute force, their SQL on odd rows, hot keys."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave.llm import dialogue, fim, substrings

#: Extra columns that clash with names the operators use, with dots and backticks.
CLASH = "n long, form string, d long, h long, starts string, fim string, substrings string, d_ string, `a.b` int, `c``d` int, N_words int"


def clashing(spark, rows, schema):
    extra = (1, "f", 2, 3, "s", "x", "y", "z", 4, 5, 6)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {CLASH}")


def in_duckdb(sql, table, df):
    con = duckdb.connect()
    con.register("arrow", df.toArrow())
    con.execute(f"CREATE TABLE {table} AS SELECT * FROM arrow")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted((dict(zip(names, r)) for r in found.fetchall()), key=str)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


# --- fill in middle

TEXTS = [None, "", " ", "one", " one", "one ", "a b", "\t\n\x0b\x0c\r x\x1c\x85\xa0y  ", "é中 𝒳𝒳 \x00 z", "has <M> in it now", "a<S b> <P", "w " * 3000]


def test_forms_come_from_the_hash_of_the_id():
    for i in range(300):
        text = TEXTS[i % len(TEXTS)] or ""
        tokens = re.findall(fim.PATTERN, text)
        n, form, prefix, middle, output = fim.arrange(text, str(i))
        h = [int(x, 16) for x in re.findall("........", hashlib.sha256(f"42:{i}".encode()).hexdigest())]
        assert n == len(tokens) and fim.rebuild(output, form) == text
        if not text or "<M>" in text or h[2] % 100 >= 50:
            assert (form, prefix, middle, output) == ("plain", None, None, text)
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
        assert (prefix, middle) == (len(p), len(m))
        assert (form, output) == (("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}"))


def test_texts_that_end_like_sentinels_are_rebuilt():
    rng = random.Random(31)
    for i in range(4000):
        text = "".join(rng.choice("<PSM> >") for _ in range(rng.randrange(14)))
        _, form, _, _, output = fim.arrange(text, str(i), rate=100, spm_rate=50)
        assert fim.rebuild(output, form) == text


@pytest.mark.parametrize("piece", [1, 2, 7, 40])
def test_long_texts_are_split_at_borders(piece, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(300):
        text = "".join(rng.choice("ab \t\né\x85") for _ in range(rng.randrange(90)))
        assert fim.token_ends(text).tolist() == [m.end() for m in re.finditer(fim.PATTERN, text)]


def test_fim_odd_rows_against_sql(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS * 12)] + [(5, "same row twice"), (5, "same row twice")]
    docs = clashing(spark, rows, "doc_id long, text string")
    made, c = fim.transform(docs)
    assert c == "fim_" and made.columns == [*docs.columns, c]
    made, back = fim.restore(made, c)
    s = made[c]
    got = made.select("doc_id", *[s[k].alias(k) for k in ("n", "form", "prefix_chars", "middle_chars")], F.sha2(s["output"], 256).alias("output_sha256"), F.sha2(made[back], 256).alias("restored_sha256"))
    assert rows_of(got) == in_duckdb(fim.SQL, "documents", docs.select("doc_id", "text"))
    assert {r.form for r in got.collect()} == {"plain", "spm", "psm"}
    assert fim.transform(docs.limit(0))[0].count() == 0


# --- substring dedup


def plain_dedup(rows, window):
    """{(id, text): kept words}; a null id is larger than any."""
    least, big = {}, 1 << 63
    split = [(big if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, big))
    out = []
    for (i, w), (_, t) in zip(split, rows):
        gone = {k + j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, t, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def passages(seed, docs=60):
    """Texts that share passages, repeat words and lines, are copies or nearly, in odd white space."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "A", "é", "\x85x", "longer", "the"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    common = [text(k) for k in (12, 13, 14, 40)] + [["w"] * 60]
    rows = []
    for i in range(docs):
        body = text(rng.randrange(25))
        for _ in range(rng.randrange(3)):
            body += rng.choice(common) + text(rng.randrange(6))
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(body)))
    rows += [(None, rows[3][1]), (None, rows[4][1]), (None, None), (docs, None), (docs + 1, ""), (docs + 2, " \n"), (7, rows[9][1]), (8, rows[8][1]), (8, rows[8][1])]
    return rows


@pytest.mark.parametrize("window, block, common", [(13, 1 << 18, 8), (13, 64, 1), (3, 200, 8), (1, 64, 8), (2, 64, 2), (16, 64, 1)])
def test_substrings_equal_brute_force(spark, window, block, common, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON", common)  # 1: every anchor counts as frequent
    rows = passages(window)
    docs = clashing(spark, rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substrings, "BLOCK", block)
    made, c = substrings.dedup(docs, window=window)
    assert c == "substrings_" and made.columns == [*docs.columns, c]
    got = sorted(((1 << 63 if r.doc_id is None else r.doc_id, r.text, r[c].n_words, r[c].n_removed, r[c].kept) for r in made.collect()), key=str)
    assert got == plain_dedup(rows, window)
    assert substrings.dedup(docs.limit(0))[0].count() == 0


def test_substrings_equal_sql(spark):
    docs = spark.createDataFrame([(i, t) for i, t in passages(4) if i is not None], "doc_id long, text string").dropDuplicates(["doc_id"])
    made, c = substrings.dedup(docs)
    s = made[c]
    got = made.select("doc_id", s["n_words"].alias("n_words"), s["n_removed"].alias("n_removed"), F.sha2(s["kept"], 256).alias("kept_sha256"))
    assert rows_of(got) == in_duckdb(substrings.SQL, "documents", docs)


def test_index_against_plain_search():
    rng = np.random.default_rng(8)
    for window in (1, 2, 5, 13):
        parts = [rng.integers(0, 3, rng.integers(window, window + 30)).astype(np.uint64) for _ in range(60)]
        document = rng.integers(0, 40, 60)
        stretch, least = substrings.Index(parts, document, window).search()
        first = {}
        for p, d in zip(parts, document):
            for k in range(len(p) - window + 1):
                key = p[k : k + window].tobytes()
                first[key] = min(d, first.get(key, d))
        got = {}
        for i, m in zip(stretch.tolist(), least.tolist()):
            got.setdefault(i, []).append(m)
        assert {i: x[::-1] for i, x in got.items()} == {i: [first[p[k : k + window].tobytes()] for k in range(len(p) - window + 1)] for i, p in enumerate(parts)}


def test_wavelets_count():
    rng = np.random.default_rng(9)
    for top, n in ((1, 1), (2, 64), (3, 127), (1000, 5000)):
        x = rng.integers(0, top, n)
        waves = substrings.Wavelets(x)
        symbol, at = rng.integers(0, int(x.max()) + 1, 300), rng.integers(0, n + 1, 300)
        assert waves.rank(symbol, at).tolist() == [int((x[:i] == s).sum()) for s, i in zip(symbol, at)]


def test_equal_windows_have_equal_anchors_and_all_are_covered():
    rng = np.random.default_rng(10)
    sizes = np.array([0, 5, 13, 14, 900, 3, 400])
    codes = rng.integers(0, 4, sizes.sum()).astype(np.uint64)
    codes[200:700] = 7
    doc, at, n, anchor, f = substrings.stretches(codes, sizes)
    begin = np.cumsum(sizes) - sizes
    windows = [(d, p + i) for d, p, k in zip(doc, at, n) for i in range(k)]
    assert windows == [(d, p) for d, s in enumerate(sizes) for p in range(s - 12)] and n.max() <= substrings.STRETCH
    of = {}
    for d, p, k, a in zip(doc, at, n, anchor):
        for i in range(k):
            w = codes[begin[d] + p + i :][:13].tobytes()
            assert of.setdefault(w, a) == a
    whole = {}
    for d, p, k, x in zip(doc, at, n, f):
        assert whole.setdefault(codes[begin[d] + p :][: k + 12].tobytes(), x) == x
    assert len(set(whole.values())) == len(whole)


def test_a_passage_that_half_of_all_documents_hold_is_many_keys(spark, monkeypatch):
    """One hot passage: its anchors are found frequent, their windows travel one by one, and no shard gets a row for each document."""
    monkeypatch.setattr(substrings, "COMMON", 8)
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, " ".join(f"{i}x{rng.random()}" for _ in range(30)) + (f" {common} " if i % 2 else " ") + " ".join(f"{i}y{k}" for k in range(20))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    frequent, varied = substrings._frequent(text, 13)
    spans = text.mapInArrow(substrings._anchored(13), substrings._SPANS)
    of = spans.groupBy("d", "h").agg(F.collect_set(F.struct("at", "n", "a", "f", "one")).alias("spans"))
    worded = text.join(of, ["d", "h"]).select("d", "h", "text", "spans").mapInArrow(substrings._worded(13, varied), substrings._WORDS)
    keyed = worded.where("words IS NOT NULL").groupBy("a").count()
    assert len(frequent) > 5 and 0 < len(varied) < len(frequent) and keyed.agg(F.max("count")).first()[0] <= 60  # 200 documents hold the passage
    made, c = substrings.dedup(docs)
    assert {r[c].n_removed for r in made.collect() if r.doc_id % 2 and r.doc_id > 1} == {60} and made.agg(F.sum(f"{c}.n_removed")).first()[0] == 60 * 199


# --- conversations


def plain_cheapest(codes):
    """Least (cost, audit) by trying every edit, with at most two insertions at a place."""
    best = []

    def go(i, said, cost, audit):
        if i == len(codes):
            for more in itertools.chain([""], ["u", "a"], ["ua", "au"]):
                if re.fullmatch("(s?(ua)+)?", said + more):
                    best.append((cost + 5 * len(more), audit + "I" * len(more)))
            return
        initial, cut, gone = "suax"[codes[i] & 3], 5 * bool(codes[i] & 4), codes[i] & 8
        for more in ("", "u", "a", "ua", "au"):
            at, paid, edits = said + more, cost + 5 * len(more), audit + "I" * len(more)
            if not any(whole.startswith(at) for whole in ("s" + "ua" * 9, "ua" * 9)):
                continue
            go(i + 1, at, paid + 2, edits + "D")
            if not gone:
                go(i + 1, at + initial, paid + cut, edits + "K")
                for r in "ua":
                    go(i + 1, at + r, paid + cut + 1, edits + "R")

    go(0, "", 0, "")
    return min(best)


def test_audits_are_the_least_of_all_cheapest():
    rng = random.Random(14)
    for n in range(5):
        for _ in range(60 if n else 1):
            codes = bytes(rng.choice([0, 1, 2, 3]) | rng.choice([0, 0, 4, 8]) for _ in range(n))
            assert dialogue.cheapest(codes) == plain_cheapest(codes), codes


def test_longer_audits_against_the_forward_way():
    """Forward over (cost, audit) by state: a way that is less at a state stays less whatever follows."""
    rng = random.Random(15)
    for _ in range(100):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randrange(40)))
        ways = {0: (0, "")}

        def inserted(ways):
            for _ in range(3):
                for q, (c, a) in list(ways.items()):
                    to = dialogue.NEXT[q]
                    ways[to] = min(ways.get(to, (1 << 60, "")), (c + 5, a + "I"))
            return ways

        for code in codes:
            new = {}
            for q, (c, a) in inserted(ways).items():
                moves = [("D", q, 2)]
                if not code & 8:
                    extra = 5 if code & 4 else 0
                    keep = dialogue.kept_to(q, code & 3)
                    moves += [("R", dialogue.NEXT[q], 1 + extra)] + ([("K", keep, extra)] if keep is not None else [])
                for e, to, paid in moves:
                    new[to] = min(new.get(to, (1 << 60, "")), (c + paid, a + e))
            ways = new
        ways = inserted(ways)
        assert dialogue.cheapest(codes) == min(w for q, w in ways.items() if q in (0, 3))


ROLES = ["user", "assistant", "system", "tool", None, "", "User", "sage"]
SAYS = ["Hello.", "What?", "no end", "", " \t\n", None, "é!", "Hello. \n", "end.\x85", "...", "\x00"]


def talk(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for _ in range(rng.randrange(9)):
            rows.append((c if c else None, rng.choice([0, 1, 2, 3, 4, 5, 9, None, -3]), rng.choice(ROLES[: rng.choice([3, 8])]), rng.choice(SAYS)))
    return rows + rows[:30]


def test_conversations_odd_rows_against_sql(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = talk(16)
    got = dialogue.digest(*dialogue.rows_of(clashing(spark, rows, schema).repartition(3))).withColumnRenamed("conv", "conv_id")
    want = in_duckdb(dialogue.SQL, "conversations", spark.createDataFrame(rows, schema))
    assert rows_of(got) == want and len(want) == len({r[0] for r in rows})
    none = dialogue.digest(*dialogue.rows_of(spark.createDataFrame([], schema)))
    assert none.count() == 0


def test_fates_are_those_of_crc32(spark):
    rows = [(c, t, "assistant", f"Said {c}. Or {t}?") for c in range(40) for t in range(5)]
    got = sorted(map(tuple, dialogue.damage(spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")).collect()))
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fate:
            row = (c, t, "user" if fate == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text))
            want += [row] * (2 if fate == 3 else 1)
    assert got == sorted(want)


def test_repaired_turns_follow_the_grammar_and_give_the_hash(spark):
    rows = [r for r in talk(17) if r[0] is not None]
    turns, found = dialogue.rows_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    said = {}
    for r in sorted(dialogue.repaired(turns, found).collect(), key=lambda r: (r.conv, r.place)):
        said.setdefault(r.conv, []).append(r)
    for r in dialogue.digest(turns, found).collect():
        own = said.get(r.conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own)) and [x.edit for x in own] == [e for e in r.audit if e != "D"]
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256


def test_a_conversation_of_half_of_all_rows(spark):
    """Its turns stream by: a hundred thousand in one conversation, half of them one and the same row."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(20_000)]
    big = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(50_000).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Again.").alias("text"))
    turns, found = dialogue.rows_of(big.unionByName(same).unionByName(spark.createDataFrame(talk(18), big.schema)))
    assert turns.where("conv = 1 AND turn = 50000").count() <= 1
    r = dialogue.digest(turns, found).where("conv = 1").first()
    codes = [t.code for t in sorted(turns.where("conv = 1").collect(), key=lambda t: (t.turn is not None, t.turn, t.role, t.text)) for _ in range(t.n)]
    assert len(codes) > 30_000 and r.audit.count("D") >= 19_000 and re.fullmatch("[DIKR]+", r.audit)
