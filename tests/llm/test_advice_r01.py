"""Cases of the review of round 1."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import html, langid, license_scan, line_dedup

from .conftest import sentence


def test_passage_in_one_line(spark):
    """A paragraph in one line goes wherever it stands again; short lines alone stay."""
    import random

    rng = random.Random(8)
    passage, short, cjk, blank = sentence(rng, 55), sentence(rng, 12), "\u6587" * 300, " " * 400
    own = [sentence(rng, 9) for _ in range(12)]
    texts = [
        [own[0], passage, own[1], short, own[2], blank],
        [own[3], short, own[4], passage, own[5], cjk],
        [passage],
        [own[6], cjk, own[7], passage, blank, own[8]],
        [own[9], own[10]],
        [short, own[11], own[9], own[10]],
    ]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: [own[3], short, own[4], own[5], cjk], 3: [own[6], own[7], blank, own[8]], 4: texts[4], 5: [short, own[11]]}
    assert line_dedup.dedup_lines(docs).filter("n_deleted > 0").count() == 1  # the rule of OP10_SQL


def test_language_stage_without_labels(spark, docs):
    """Nothing can be learned: every text with a letter stays."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    some = docs.select(columns)
    key = lambda rows: sorted(map(str, rows))
    want = key(r for r in some.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or ""))
    none = some.withColumn("lang", F.lit(None).cast("string"))
    all_held_out = some.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("en")))
    named_so = some.withColumn("lang", F.lit(langid.UNKNOWN))
    for df in (none, all_held_out, named_so):
        got = corpus_pipeline.identify_language(spark, df, "")
        assert got.columns == columns and key(got.select("doc_id", "text").collect()) == want


@pytest.mark.parametrize("tag", sorted(html.SKIPPED | {"object", "math"}))
def test_missing_end_tags_cut_nothing(tag):
    """What is no content ends with its parent, or where the next block begins."""
    before = f"<body><{tag} class=x><article><h1>Head</h1><p>One.</p><p>Two.</p></article></body>"
    within = f"<article><p>One <{tag}></p><p>Two.</p><div>Three <{tag}></div><p>Four <{tag}><p>Five.</article>"
    assert html.main_text(before) == "Head\n\nOne.\n\nTwo."
    assert html.main_text(within) == "One\n\nTwo.\n\nThree\n\nFour\n\nFive."


def test_skipped_elements():
    page = "<article><p>A <button><div>Share</div></button>b <svg><title>I</title><path d='x'><g><svg></svg></g></svg>c.</p><select><option>x<option>y</select><p>D <math><mi>x</mi>=<mn>1</mn></math>, <object data=x>a fallback</object>.<template><p>no</p></template><noscript>no</noscript><script>'<button>'</script></article>"
    assert html.main_text(page) == "A b c.\n\nD x=1, a fallback."
    assert html.main_text("<article><select><option>x<option>y<p>Text.</article>") == "Text."
    assert html.main_text("<article><p>Text.</p><script>var a;</article>") == "Text."


def test_containers_compete_with_paths_outside():
    long = [f"Paragraph {i} tells a story, which goes on for a while, and has an end. So it is." for i in range(5)]
    text = "<h2>Part</h2>".join(f"<p>{x}</p>" for x in long)
    whole = "\n\nPart\n\n".join(long)
    card = "<article class=card><a href=x>Read this too</a></article>"
    assert html.main_text(f"<body><div id=content>{text}</div>{card}</body>") == whole
    assert html.main_text(f"<body>{card}<div id=content>{text}</div></body>") == whole
    assert html.main_text(f"<body><div>A word of the day.</div><article>{text}</article><div>All rights reserved, 2024.</div></body>") == whole
    got = html.main_text(f"<body><article>{text}</article><section>{text}</section></body>")
    assert got == whole + "\n\n" + whole


def test_license_copies_back_to_back(spark):
    """Each copy is a match, however many touch; what is spread too far isn't."""
    notice, mit = "Released under the MIT License.", "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files"
    whole = license_scan._MIT.replace("any person", "any good person").replace("sublicense", "")
    template = license_scan._plain(license_scan._BSD).split()
    thin = " ".join(" ".join([*template[k : k + 3], "x", "y"]) for k in range(0, len(template) - 2, 3))
    rows = [(1, f"{notice} {notice}"), (2, "\n".join([notice] * 20_000)), (3, " ".join([whole] * 3)), (4, thin), (5, mit), (6, "All rights reserved. " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["mit", "mit", "mit", "", "", ""]
    assert got[1].score == got[2].score == 1 and 0.9 <= got[3].score < 1 and got[4].score == 0
    places = {(r.first_word, r.last_word) for r in license_scan.spans(docs).filter("doc_id = 1").collect()}
    assert {(0, 4), (5, 9)} <= places
