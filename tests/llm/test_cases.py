"""Very long texts, columns with an operator's names, and plain re-computations."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pytest

from gleanworks.llm import common, decontaminate, fingerprint, html, langid, license_scan, line_dedup, near_dedup, sharding, suffix_dedup

from .conftest import sentence
from .test_operators import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OWN = ["score", "lang_pred", "has_letter", "spans", "items", "n_words", "other_id", "other_hash", "record", "gone", "doc", "label", "open", "part", "node", "own_2", "comp"]


# ---- long texts: beyond a block, which is then one text


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(11)
    lines = [sentence(rng, 10) + f" n{k}" for k in range(75_000)]
    passage = sentence(rng, 60)
    whole = "\n".join([*lines, passage, "Released under the MIT License."])
    assert len(whole) > common.BLOCK_BYTES
    texts = [whole, "start " + passage + " end", "\n".join([*lines[70_000:70_040], "own"]), sentence(rng, 30), whole.replace(" n5\n", " m5\n", 1) + " x", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return SimpleNamespace(texts=texts, passage=passage, df=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache())


def test_long_text_line_dedup(long):
    got = {r.record.doc_id: r for r in line_dedup.dedup_lines(long.df).collect()}
    lines = [(t or "").split("\n") for t in long.texts]
    assert got[2].text == "own" and (got[2].n_deleted, got[2].longest) == (40, 40) and got[0].n_deleted == 0
    other = [k for k, (a, b) in enumerate(zip(lines[0], lines[4], strict=True)) if a != b]
    assert len(other) == 2  # a line within, and the last one
    assert got[0].longest == max(other[0], other[1] - other[0] - 1) and got[0].n_maximal == 2
    assert got[4].n_deleted == len(lines[4]) - 2 and got[4].text.split("\n") == [lines[4][k] for k in other]


def test_long_text_other_operators(long, spark):
    n = len(long.texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(long.df).collect()}
    assert (got[4].component_id, got[0].kept, got[1].component_id) == (0, True, 1)
    words = long.texts[0].split()
    assert got[0].n_shingles == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(long.df).collect()}
    raw = long.passage.encode()
    assert cut[1].n_removed >= len(raw) and cut[0].n_bytes == len(long.texts[0].encode()) and cut[3].n_removed == 0
    bench = spark.createDataFrame([(1, long.passage), (2, "none of this stands anywhere at all in any text here")], "item_id long, text string")
    hit = {r.doc_id: r for r in decontaminate.report(long.df, bench).collect()}
    assert [hit[i].contaminated for i in range(n)] == [True, True, False, False, True, False]
    assert hit[1].n_hit == 60 and hit[0].n_words == len(words)
    pred = {r.doc_id: r for r in langid.identify(long.df).collect()}
    assert [pred[i].lang_pred for i in range(n)] == ["en"] * (n - 1) + ["und"]
    marks = {r.doc_id: r for r in license_scan.scan(long.df).collect()}
    assert marks[0].labels == "mit" and marks[0].n_words == len(words) and marks[3].labels == ""
    prints = {r.doc_id: r for r in fingerprint.fingerprints(long.df).collect()}
    assert all(prints[i].n_chars == len(t or "") for i, t in enumerate(long.texts))
    assert sorted(r.slot for r in sharding.shuffle_into_shards(long.df, shards=1).collect()) == list(range(n))


def test_blocks():
    """Batches are cut by bytes; a longer text is a block by itself; nothing is lost."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = [None, "", *("x" * rng.randrange(60) for _ in range(50)), "y" * 500, "z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(common.blocks([batch], most=100))
    assert [t for b in parts for t in b["text"].to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b["text"].to_pylist()) <= 100 for b in parts)


@pytest.mark.parametrize("most", [300, 2000])
def test_small_indexes(spark, monkeypatch, most):
    """Several indexes in a task, and anchors split until they fit, find what one finds."""
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", most)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", most)
    rng = random.Random(most)
    shared = "".join(rng.choice("abcde ") for _ in range(400))
    texts = [f"{k}" * 30 + shared[rng.randrange(100) : 260 + rng.randrange(140)] + f"{k}" * 40 for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Matching statistics of all documents in one index say the same, equal ones included.
    text = np.frombuffer(b"\xff".join(t.encode() for t in texts) + b"\xff", np.uint8)
    match = suffix_dedup.self_matches(text)
    at, want = 0, {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - suffix_dedup.WINDOW + 1):
            if match[at + k] >= suffix_dedup.WINDOW:
                gone[k : k + suffix_dedup.WINDOW] = True
        want[i] = int(gone.sum())
        at += len(t) + 1
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == want


# ---- columns with an operator's names


@pytest.fixture
def clashing(docs):
    extra = [c for c in docs.columns if c not in COLUMNS]
    return docs.drop(*extra).selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in OWN))


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, clashing, tmp_path, stage):
    spark.createDataFrame([(1, clashing.filter("doc_id = 30").first().text[4:120])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.STAGES[stage][1](spark, clashing, str(tmp_path))
    assert got.columns == [*COLUMNS, *OWN]
    rows = got.collect()
    assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in OWN)


def test_line_stage_by_brute_force(spark, docs):
    """What the pipeline's line stage leaves: no later copy of two lines, or of a passage in one."""
    some = docs.select(COLUMNS).dropDuplicates(["doc_id", "text"]).filter("doc_id IS NOT NULL")
    rows = sorted((r.doc_id, r.text) for r in some.filter("text IS NOT NULL").collect())
    first: dict = {}
    want = {}
    for i, t in rows:
        lines = t.split("\n")
        gone = set()
        for k, line in enumerate(lines):
            runs = [((line,), 1)] if len(line.split()) >= line_dedup.PASSAGE or len(line.strip()) >= line_dedup.LETTERS * line_dedup.PASSAGE else []
            runs += [(tuple(lines[k : k + 2]), 2)] if k + 1 < len(lines) and any(x.strip() for x in lines[k : k + 2]) else []
            for run, n in runs:
                if first.setdefault(run, (i, k)) != (i, k):
                    gone.update(range(k, k + n))
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left.strip():
            want[i] = left
    got = corpus_pipeline.dedup_lines(spark, some, "").collect()
    assert {r.doc_id: r.text for r in got if r.text is not None} == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None and r.doc_id in want and want[r.doc_id] != dict(rows)[r.doc_id])


# ---- plain re-computations


def test_language_vectors_by_definition(monkeypatch):
    """Rolled letters bound to trigrams, bundled: letter by letter, and with a small memory."""
    own = langid.Encoder(64)
    symbols = langid._symbols()
    letters = np.random.default_rng(7).integers(0, 2, (langid.SYMBOLS, 64), np.int8).astype(int) * 2 - 1
    rng = random.Random(1)
    texts = ["", " 12", "Ab", "straße über", "слово и дело", "日本語 text"] + ["".join(rng.choice("abcdefghijklmnop qrstuvwxyzäöü") for _ in range(300)) for _ in range(6)]
    want = []
    for t in texts:
        words = "".join(c if symbols[ord(c)] else " " for c in t).split()
        s = [0, *(x for w in words for x in (*(int(symbols[ord(c)]) for c in w), 0))]
        v = np.zeros(64, int)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            v += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        want.append(v)
    has, got = own.bundle(texts)
    assert has.tolist() == [any(symbols[ord(c)] for c in t) for t in texts] and (got == np.array(want) * has[:, None]).all()
    monkeypatch.setattr(langid, "KNOWN", 50)
    monkeypatch.setattr(langid, "SLICE", 30)
    few = langid.Encoder(64)
    for _ in range(2):
        assert (few.bundle(texts)[1] == got).all() and few.known <= 50


def test_language_ties_and_repeats(spark):
    rows = [(1, "same words", "b"), (2, "same words", "a"), (3, "same words", None), (3, "same words", None), (4, "same words", "a"), (6, "same words", "b")]
    rows = [r for r in rows if r[2] is None] + [(i, t, lang) for k, (_, t, lang) in enumerate(rows) if lang for i in [100 + k]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    learned = {r.lang for r in docs.filter(~langid.held_out(docs.doc_id)).collect() if r.lang}
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {min(learned)}


def test_likeness_by_definition():
    """Signed counts of character runs by lane: 2 ab / (aa + bb)."""
    rng = random.Random(5)
    texts = [sentence(rng, 80) for _ in range(4)] + ["short", ""]
    texts += [texts[0][:300] + texts[1][:100], texts[0]]
    _, sketch = fingerprint.vectors(texts)
    signed = sketch.view(np.int32).astype(int)
    runs = [sum(max(0, len(p) - fingerprint.RUN + 1) or bool(p) for p in t.split("\n")) for t in texts]
    assert all(abs(v).sum() <= n and (abs(v).sum() - n) % 2 == 0 for v, n in zip(signed, runs, strict=True))
    for a in range(len(texts)):
        for b in range(len(texts)):
            ab, w = int(signed[a] @ signed[b]), int(signed[a] @ signed[a] + signed[b] @ signed[b])
            want = min(1.0, max(0.0, 2 * ab / w)) if w else 1.0
            assert abs(fingerprint.likeness(sketch[a : a + 1], sketch[b : b + 1])[0] - want) < 1e-12
    like = lambda a, b: fingerprint.likeness(sketch[a : a + 1], sketch[b : b + 1])[0]
    assert like(0, 7) == 1 and like(0, 6) > 0.6 and like(0, 2) < 0.4


def test_shuffle_is_uniform(spark):
    """Law `rows`; places don't follow the order of ids, and another seed deals anew."""
    docs = spark.range(600).selectExpr("id AS doc_id", "'t' AS text")
    a = {r.record.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, shards=6).collect()}
    at = np.array([a[i][0] * 100 + a[i][1] for i in range(600)])
    assert sorted(at.tolist()) == list(range(600)) and abs(np.corrcoef(at, np.arange(600))[0, 1]) < 0.15
    odd = Counter(shard for i, (shard, _) in a.items() if i % 2)
    assert all(25 < n < 75 for n in odd.values())


# ---- op8

PAGE = "<body><div><div>Home</div><div>Contact and imprint</div></div><div><div><h1>A title</h1><p>{}</p><p>{}</p></div></div><div><div>Some city</div><div>Tel 12345</div></div></body>"
TEXTS = ["This paragraph tells, at some length, what the page is about. It has marks; it goes on.", "So does this one, which is as long as the other one is. And it ends here, at last."]


def test_scores_select():
    """Without names or containers, scores find the content; without scores, the rest comes too."""
    page = PAGE.format(*TEXTS)
    assert html.main_text(page) == "\n\n".join(["A title", *TEXTS])
    assert len(html.main_blocks(page, scored=False)) > 3


def brute_scores(found):
    """Of each path: ratios of its blocks, smoothed 1-2-1 over the paths in page order, multiplied."""
    paths = list(dict.fromkeys(b.node.path for b in found))
    rows = {p: [b for b in found if b.node.path == p] for p in paths}
    text = [sum(len(b.text) - b.linked for b in rows[p]) / len(rows[p]) for p in paths]
    marks = [sum(sum(c in ".,;:!?…。，、；：！？" for c in b.text) for b in rows[p]) / len(rows[p]) for p in paths]
    near = lambda x, i: (x[max(i - 1, 0)] + x[i] * 2 + x[min(i + 1, len(x) - 1)]) / 4
    own = [sum(len(b.text) - b.linked for b in rows[p]) / sum(len(b.text) for b in rows[p]) for p in paths]
    return {p: near(text, i) * (1 + near(marks, i)) * own[i] for i, p in enumerate(paths)}


def test_scores_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            tag = rng.choice(["p", "div", "h2", "li", "td", "section", "article", "div class=ad", "b", "a href=x"])
            parts.append(f"<{tag}>{sentence(rng, rng.randrange(8))}{rng.choice(['.', ',', '', '!'])}" + rng.choice(["", f"</{tag.split()[0]}>", "</div>"]))
        found = html.page_blocks("".join(parts))
        html._weigh(found)
        got, want = html.path_scores(found), brute_scores(found)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 * max(1, want[p]) for p in want)


def test_names_weigh():
    """A part with a weak name stays if it reads like the article; links below it go."""
    whole = "<body><article><h1>H</h1><p>{}</p><section class='related-work'><p>{}</p></section><div id=login><p>To log in, type your name. Then press enter, and wait.</p></div><math><mi>x</mi></math><div class=related><ul><li><a href=a>More</a></li><li><a href=b>Less</a></li></ul></div></article></body>".format(*TEXTS)
    assert html.main_text(whole) == "\n\n".join(["H", *TEXTS, "To log in, type your name. Then press enter, and wait.", "x"])
    comments = "<body><article><h1>H</h1><p>{}</p><div class=comments><p>{} {}</p></div></article></body>".format(TEXTS[0], *TEXTS)
    assert html.main_text(comments) == "H\n\n" + TEXTS[0]


def test_malformed_pages_in_linear_time():
    import time

    def cost(n):
        at = time.perf_counter()
        for piece in ("<p \">' <p '>\"", "<i>x</b>", "<a ", "<p a=\">\" ", "<div>x", "<svg><g></x>", "<b><i></b>", "<td>a<li>b", "</p>", "<!--", "&amp"):
            html.main_text(piece * n)
        return time.perf_counter() - at

    cost(500)
    assert cost(8000) < 60 * max(cost(800), 0.02)
    deep = "<div>" * 3000 + "<p>" + TEXTS[0] + "</p>" + "</div>" * 3000 + "<p>" + TEXTS[1] + "</p>"
    assert html.main_text(deep) == "\n\n".join(TEXTS)


def test_pages_of_all_kinds(spark):
    long = "<article>" + "".join(f"<p>{TEXTS[k % 2]} {k}</p>" for k in range(60_000)) + "</article>"
    assert len(long) > common.BLOCK_BYTES
    rows = [(1, None, PAGE.format(*TEXTS)), (1, None, PAGE.format(*TEXTS)), (None, "u", long), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted((r.page_id or 0, r.url or "", r.n_chars, hashlib.md5(r.text.encode()).hexdigest()) for r in html.extract(pages).collect())
    texts = ["\n\n".join(f"{TEXTS[k % 2]} {k}" for k in range(60_000)), "\n\n".join(["A title", *TEXTS]), "\n\n".join(["A title", *TEXTS]), ""]
    assert got == sorted((i, u, len(t), hashlib.md5(t.encode()).hexdigest()) for i, u, t in zip([0, 1, 1, 2], ["u", "", "", "v"], texts, strict=True))


# ---- op6


def test_groups_in_blocks(spark, monkeypatch):
    """Buckets of unlike texts and of strays, cut into many blocks, lose no link."""
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", 6000)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(40):
        own = list(base)
        for j in rng.sample(range(120), rng.choice([2, 4, 6, 8])):
            own[j] = f"x{k}.{j}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_links_of_a_group():
    """Rare shingles lead to every link that a comparison of all pairs finds."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        pool = rng.integers(0, 1 << 62, 30, np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 20))) for _ in range(14)]
        names = [bytes([i]) for i in range(len(sets))]
        comp = [bytes([int(c)]) for c in rng.integers(0, 9, len(sets))]
        found = near_dedup.linked(names, comp, [3] * len(sets), [s.tobytes() for s in sets])
        parent = {c: c for c in comp}

        def top(c, parent=parent):
            while parent[c] != c:
                c = parent[c]
            return c

        mine = dict(parent)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                n = len(np.intersect1d(a, b))
                if 100 * n >= 75 * (len(a) + len(b) - n):
                    parent[top(comp[i])] = top(comp[j])
        want = {i: top(comp[i]) for i in range(len(sets))}
        parent.update(mine)
        for u, v in found:
            parent[top(comp[u[0]], parent)] = top(comp[v[0]], parent)
        got = {i: top(comp[i], parent) for i in range(len(sets))}
        same = lambda d: {(i, j) for i in d for j in d if d[i] == d[j]}
        assert same(got) == same(want)


