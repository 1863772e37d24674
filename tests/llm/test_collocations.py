"""Phrases against plain counting, on odd rows too."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanworks.llm import collocations as c

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, top=2000, least=10, most=3, cover=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if not any(x == lang and len(v) > len(w) and 100 * b >= cover * a and inside(v) for (x, v), b in found.items()):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    got, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(got)


def rows(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["New", "york", "city", "of", "the", "ünï", "a", "日本", "İ", "\x00", "x\x1cy", "\xa0"]
    texts = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(60)))
        texts.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return [*texts, ("en", None), (None, ""), ("fr", " \t.,"), texts[0], texts[0]]


@pytest.mark.parametrize("shard,slice_bytes", [(1 << 21, 1 << 20), (7, 5), (40, 30)])
def test_collocations(spark, corpus, monkeypatch, shard, slice_bytes):
    # Tasks get changed limits by value: the function that runs there is made below.
    df = spark.createDataFrame([(x, t, "c") for x, t in corpus], "lang string, text string, phrase string").repartition(2)
    monkeypatch.setattr(c, "SHARD_WORDS", shard)
    monkeypatch.setattr(c, "SLICE_BYTES", slice_bytes)
    for most, least, cover, top in ((3, 10, 50, 2000), (5, 3, 90, 7), (2, 2, 50, 3)):
        want = brute(corpus, top, least, most, cover)
        assert want and rows(c.collocations(df, top, least, most, cover)) == want


@pytest.mark.parametrize("shard,slice_bytes,most", [(9, 4, 3), (3, 1, 4), (1 << 20, 1 << 20, 1)])
def test_shards_overlap(corpus, monkeypatch, shard, slice_bytes, most):
    """Counts don't depend on where shards and slices are cut (here in this process)."""
    monkeypatch.setattr(c, "SHARD_WORDS", shard)
    monkeypatch.setattr(c, "SLICE_BYTES", slice_bytes)
    got, want = Counter(), Counter()
    s, over = c._Shard(), most - 1

    def flush():
        for b in c._phrases(s, 1, most, None):
            for r in b.to_pylist():
                got[r["lang"], r["phrase"]] += r["f"]

    for lang, text in corpus:
        lang, tail = lang or "und", []
        for some in c._slices((text or "").encode()):
            s.add(lang, some)
            tail = [*tail, *some.rsplit(None, over)[-over:]][-over:] if over else []
            if s.size >= shard + s.carried:
                flush()
                s = c._Shard(lang, tail)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    want[lang, " ".join(w[i : i + k])] += 1
    flush()
    assert +got == +want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 5))
def test_suffix_array(ids, depth):
    x = np.array(ids, np.int32)
    order, common = c.suffix_array(x, depth)
    padded = [*ids, *[0] * depth]
    head = lambda p: padded[p : p + depth]
    assert sorted(order.tolist()) == list(range(len(ids)))
    for i in range(1, len(ids)):
        a, b = head(order[i - 1]), head(order[i])
        assert a <= b
        n = next((j for j in range(depth) if a[j] != b[j] or a[j] == 0), depth)
        assert common[i] == n


def test_empty_and_large_counts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert c.collocations(empty).collect() == []
    one = spark.createDataFrame([("en", "a b " * 5)], "lang string, text string")
    assert rows(c.collocations(one)) == []
    got = spark.range(1).selectExpr("3000000000000 AS a", "4000000000000L AS l", "5000000000000L AS r").selectExpr("CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)) * 1000000 div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0))) AS s").first()
    assert got.s == 10**6 * 9 // 20


def test_sql(spark, corpus):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in corpus])
    want = sorted(con.execute(f"SELECT {', '.join(FIELDS)} FROM ({c.OP11_SQL})").fetchall())
    assert want == brute(corpus)
