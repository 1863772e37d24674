"""Each operator against a brute-force version, on odd rows too."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanworks.llm import decontaminate, fingerprint, html, langid, license_scan, line_dedup, near_dedup, packing, queries, sharding, suffix_dedup
from gleanworks.llm.components import components

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ---- op1


def test_packing_round_trip(docs):
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in rows_of(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), 64):
            want[i, p // 64, p, len(ids[p : p + 64]), zlib.crc32(ids[p : p + 64].tobytes())] += 1
    got = packing.pack(docs, PATH, capacity=64, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_empty(empty):
    assert packing.pack(empty, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_bin_completion(sizes):
    counts = Counter(sizes)
    found = packing.bin_completion(counts, 40, 500)
    used = Counter()
    for items, times in found:
        assert sum(k * n for k, n in items) <= 40
        for k, n in items:
            used[k] += n * times
    assert used == counts
    n = sum(t for _, t in found)
    assert -(-sum(sizes) // 40) <= n <= sum(t for _, t in packing.best_fit(counts, 40))


def test_bin_completion_beats_best_fit():
    counts = Counter([6, 5, 5, 4, 4, 3, 3])  # best-fit decreasing needs four sequences of ten or more
    assert sum(t for _, t in packing.bin_completion(counts, 10)) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=12), st.integers(5, 25))
def test_fillings(sizes, room):
    """They fit, leave no room for what is still there, and none dominates a later one."""
    counts = Counter(sizes)
    found = packing.fillings(sorted(counts, reverse=True), counts, room)
    for i, items in enumerate(found):
        waste = room - sum(k * n for k, n in items)
        assert waste >= 0 and all(n <= counts[k] for k, n in items)
        assert not any(k <= waste and counts[k] > dict(items).get(k, 0) for k in counts)
        assert not any(packing.dominates(found[j], items) for j in range(i))
    assert packing.dominates(((5, 1), (3, 1)), ((5, 1), (2, 1), (1, 1))) and not packing.dominates(((4, 2),), ((5, 1), (3, 1)))


def test_tokenizer_is_exact(texts):
    t, own = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    some = [x or "" for x in texts] + ["it's we'll a.. b,, c.,d e-f. (g). x_y. $5.00, 3,000.5 ÀÉÎ. «quoté», a·b. 3²."]
    flat, bounds = own.ids(some, 0)
    for i, x in enumerate(some):
        assert flat[bounds[i] : bounds[i + 1] - 1].tolist() == t.encode(x, add_special_tokens=False).ids, x


# ---- op2


def test_fingerprints(docs):
    rows = sorted(((i, t or "") for i, t in rows_of(docs)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()] += 1
    got = fingerprint.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprint_is_a_multiset_hash():
    one = lambda t: fingerprint.encode(*fingerprint.vectors([t]))[0]
    assert one("a\nb b\nc") == one("c\na\nb b") != one("c\na\nb")
    assert fingerprint.insert(one("a\nlonger paragraph here"), "new one") == one("new one\na\nlonger paragraph here")
    assert fingerprint.insert(one("a\nb"), "b", -1) == one("a")


def test_fingerprint_of_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    r = fingerprint.fingerprints(one).first()
    assert r.near_next == 1.0 and r.n_chars == 14
    assert fingerprint.fingerprints(empty).collect() == []


# ---- op3


def test_shards(docs, texts):
    got = sharding.shuffle_into_shards(docs, shards=5).collect()
    assert Counter((r.record.doc_id, r.record.text, r.record.shard) for r in got) == Counter((i, t, "x") for i, t in rows_of(docs))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(5)) <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        raw = (r.record.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    again = sharding.shuffle_into_shards(docs.repartition(2), shards=5).collect()
    key = lambda rows: sorted((str(r.record.doc_id), r.text_crc32, r.shard, r.slot) for r in rows if r.record.doc_id != 6)
    assert key(got) == key(again)  # the seed decides, not the partitions


def test_no_shards(empty):
    assert sharding.shuffle_into_shards(empty).collect() == []


# ---- op4


def test_language_id(spark):
    rng = np.random.default_rng(1)
    words = {"en": ["the", "with", "which", "thing", "ought"], "de": ["und", "nicht", "schön", "straße", "über"], "ru": ["это", "что", "слово", "жизнь", "если"]}
    rows = [(i, " ".join(rng.choice(words[k], 20)), k) for i, k in enumerate(["en", "de", "ru"] * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, " 12 !", "de"), (None, "the with which", "en"), (902, "this thing", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert got[902].lang_pred == "en"


def test_language_id_of_odd_rows(docs, empty):
    assert langid.identify(docs).count() == docs.count()
    assert langid.identify(empty).collect() == []


# ---- op5


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = defaultdict(set)
    for name, t in items:
        w = word.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            found[tuple(w[i : i + width])].add(name)
    for i, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for x, who in found.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    names |= who
        ids = ",".join(sorted(map(str, names)))
        yield i, len(w), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, texts, pass_bytes):
    items = [(1, texts[10][20:160]), (2, texts[3]), (3, "of the"), (4, "na"), (5, ""), (6, None), (10, texts[4]), (1, "日本語"), (7, "released under THE mit")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, pass_bytes=pass_bytes).collect()
    assert Counter((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"])) for r in found) == Counter(x[:4] for x in brute_contamination(rows_of(docs), items))
    got = decontaminate.report(docs, bench).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(brute_contamination(rows_of(docs), items))


def test_decontamination_empty(empty, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(empty, none).collect() == []
    assert not any(r.contaminated for r in decontaminate.report(docs, none).collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index(text, pattern):
    index = decontaminate.FMIndex(np.array(text, np.int64))
    lo, hi = index.search(np.array([pattern]))
    want = [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(lo[0], max(hi[0], lo[0])))) == want


# ---- op6


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    for a, (i, _) in enumerate(docs):
        ids = [docs[b][0] for b in range(len(docs)) if comp[b] == comp[a] and docs[b][0] is not None]
        low = min(ids) if sets[a] and ids else i
        yield i, len(sets[a]), low, True if i is None and low is None else low == i


def chained(n):
    """Copies linked in a chain, each to its neighbours only, and a star whose leaves aren't linked."""
    word = lambda k: f"w{k}"
    chain = [" ".join(map(word, range(k * 8, k * 8 + 100))) for k in range(n)]
    hub = [f"h{k}" for k in range(200)]
    leaves = []
    for k in range(n):
        leaf = list(hub)
        for j in range(4):
            leaf[10 + 12 * k % 180 + j] = f"x{k}.{j}"
        leaf[(100 + 12 * k) % 190] = f"y{k}"
        leaves.append(" ".join(leaf))
    return chain + leaves + [" ".join(hub)]


def test_near_duplicates(docs):
    got = near_dedup.near_duplicates(docs).drop("text_hash").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows_of(docs)))


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 4000])
def test_near_duplicates_of_chains_and_stars(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", bucket_bytes)
    rows = list(enumerate(chained(24)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_near_duplicates_empty(empty, spark):
    assert near_dedup.near_duplicates(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(blank).drop("text_hash").collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.75, 0.9):
        n = 2000
        common = rng.integers(0, 1 << 63, int(n * 2 * j / (1 + j)), np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), np.uint64)]) for _ in range(2))
        regs = near_dedup.sketch(np.concatenate([a, b]), np.array([n, n]))
        got = near_dedup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - j) < 0.17
        whole = near_dedup.sketch(np.concatenate([a, b]), np.array([2 * n]))
        assert (whole[0] == np.maximum(regs[0], regs[1])).all()  # sketches merge


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


# ---- op7


def brute_repeats(docs, window=200):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + window] for _, b in raws for k in range(len(b) - window + 1))
    for i, b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        gone = gone[:-1] if len(b) else gone[:0]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 300])
def test_repeats(docs, monkeypatch, anchor_bytes):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", anchor_bytes)
    got = suffix_dedup.remove_repeats(docs).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(rows_of(docs)))


def test_repeats_chunked(docs, monkeypatch, texts):
    raws = [(t or "").encode() for t in texts]
    whole = list(suffix_dedup.contexts(raws))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    parts = list(suffix_dedup.contexts(raws))
    windows = lambda found: {(d, s + k, a, s + c) for x in found for d, s, m, a, c in zip(*map(list, x), strict=True) for k in range(m)}
    assert windows(whole) == windows(parts)


def test_repeats_empty(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=60))
def test_self_matches(text):
    raw = text.encode()
    got = suffix_dedup.self_matches(np.frombuffer(raw, np.uint8))
    for i in range(len(raw)):
        best = 0
        for j in range(len(raw)):
            k = 0
            while j != i and max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == min(best, 200)


# ---- op8

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><article><h1>Head</h1><p>One <b>two<br>three.<p>Four &amp; five&nbsp;six.</article><footer>F</footer></body>", "Head\n\nOne two three.\n\nFour & five six."),
    ("<body><header>Site</header><main><h1>H</h1><p>Text, with marks.</p><aside>Side</aside><div class='comments'><p>First!</p></div><form><p>Mail?</p></form><ul><li>a</li><li>b</li></ul></main></body>", "H\n\nText, with marks.\n\na\n\nb"),
    ("<article><p>x < y</p><script>var a='</p>';</script><p>end</article>", "x < y\n\nend"),
    ("<body><div class='cookie-notice'>We use cookies.</div><div><p>A long paragraph, with sentences. It goes on.</p><p>Another one, which is as long.</p></div><div class='ad'>Buy</div></body>", "A long paragraph, with sentences. It goes on.\n\nAnother one, which is as long."),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><!-- no --><p>t<textarea>no</textarea></p></article>", "a\n\nb\n\nc\n\nt"),
    ("<body class='no-sidebar'><div id='header'>Site</div><div class='has-sidebar'><article><p>Kept.</p><section id='reader-comments'><article><p>Nice!</p></article></section></article></div></body>", "Kept."),
    ("<main><div class='notice'>Note!</div><p>Body <a href='x'>link</a> text.</p><div class='share-buttons'>Share</div><div class=advert>Ad</div></main>", "Body link text."),
    ("", ""),
    (None, ""),
    ("no markup at all", "no markup at all"),
    ("<article><p>", ""),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html.extract(pages.limit(0)).collect() == []


# ---- what has SQL


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = queries.queries()[name](spark, path)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, df.select(names).collect())) == Counter(want)




def in_duckdb(docs, sql):
    con = duckdb.connect()
    pdf = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).toPandas()
    con.register("documents", pdf)
    return Counter(con.execute(sql).fetchall())


def test_licenses(docs, empty):
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = license_scan.scan(unique).collect()
    assert Counter(map(tuple, got)) == in_duckdb(docs, license_scan.oracle())
    assert license_scan.scan(empty).collect() == []
    assert license_scan.scan(docs).count() == docs.count()


def test_license_spans(spark):
    """Edited texts of licenses are found by their words; what a license shares with prose isn't."""
    edit = lambda t, k: " ".join(w for i, w in enumerate(t.split()) if i % k)  # noqa: E731  every k-th word is lost
    rows = [
        (1, "x " + edit(license_scan._MIT, 12) + " y"),
        (2, "mit license mit license; the apache license. GENERAL Public   license"),
        (3, "licensed under nothing at all"),
        (4, license_scan._BSD.replace("1. ", "* ").replace("2. ", "* ") + "\n" + license_scan._AS_IS_BSD),
        (5, "/*\n * " + license_scan._APACHE.replace(". ", ".\n * ") + " */"),
        (6, license_scan._GPL.replace("version 3", "version 2")),
        (7, "Licensed under CC BY-NC 4.0. Some prose."),
        (8, license_scan._CC.format("Attribution-ShareAlike")),
        (9, edit(license_scan._MIT, 3)),
        (10, "to any person who is subject to the following conditions, the above copyright notice is provided as is, without warranty of any kind"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.75 <= got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (4, 0, 7, "apache,gpl,mit")
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)
    assert [got[i].labels for i in range(4, 11)] == ["bsd", "apache", "gpl", "cc-by-nc", "cc-by-sa", "", ""]


def test_line_dedup(docs, empty, texts):
    from gleanworks.llm.queries import OP10_SQL

    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == docs.count() and all(r.record.lines == "x" for r in got)
    found = {r.record.doc_id: r for r in got}
    shared = texts[13]
    r = found[39]
    assert r.text == "own line" and r.n_deleted == 5 and r.n_runs == 2 and len(shared.split("\n")) == 6
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mine = Counter((r.record.doc_id, r.n_lines, r.n_deleted, r.n_runs, r.n_maximal, r.longest, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in line_dedup.dedup_lines(unique).collect())
    assert mine == in_duckdb(docs, OP10_SQL)
    assert line_dedup.dedup_lines(empty).collect() == []


def brute_runs(texts, least):
    """Maximal repeated runs of each text, and the longest, every pair of places compared."""

    def match(t, p, u, q):
        k = 0
        while p + k < len(t) and q + k < len(u) and t[p + k] == u[q + k]:
            k += 1
        return k

    out = {}
    for i, t in enumerate(texts):
        best = {p: max((match(t, p, u, q) for j, u in enumerate(texts) for q in range(len(u)) if (i, p) != (j, q)), default=0) for p in range(len(t))}
        runs = {p: n for p, n in best.items() if n >= least and any(x.strip() for x in t[p : p + least])}
        out[i] = (sum(runs.get(p - 1) != n + 1 for p, n in runs.items()), max(runs.values(), default=0))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_maximal_runs(spark, least):
    """Long copies, runs that nest and overlap, ends of documents, blank lines, one line again and again."""
    import random

    rng = random.Random(least)
    base = [f"line {k}" for k in range(40)]
    texts = [base, base[3:30], base[10:], ["x", *base[5:9], "", "", "", *base[9:20], "y"], ["z", *base[5:9], "", "", "", *base[9:18]], ["same"] * 9, ["same"] * 5 + base[:3], [" "] * 6, [""], ["only here", "and here"], base]
    texts += [[rng.choice("ab") for _ in range(15)] for _ in range(6)]
    found = line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), least).collect()
    assert {r.record.doc_id: (r.n_maximal, r.longest) for r in found} == brute_runs(texts, least)


@pytest.mark.parametrize("least", [1, 3, 4])
def test_line_runs_of_other_lengths(spark, least):
    rng = np.random.default_rng(least)
    texts = [list(rng.choice(list("abc "), 12)) for _ in range(12)]
    found = line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), least).collect()
    got = {r.record.doc_id: r.text for r in found}
    assert {r.record.doc_id: (r.n_maximal, r.longest) for r in found} == brute_runs(texts, least)
    seen = set()
    for i, t in enumerate(texts):
        gone = set()
        for k in range(len(t) - least + 1):
            run = tuple(t[k : k + least])
            if any(x.strip() for x in run):
                if run in seen:
                    gone.update(range(k, k + least))
                seen.add(run)
        assert got[i] == "\n".join(x for k, x in enumerate(t) if k not in gone)
