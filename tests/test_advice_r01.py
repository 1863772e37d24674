"""Cases of the review of round 1: whole tables, by brute force."""

import os
import re
from html import unescape

import pytest

from gleanworks.plans import catalog

D = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@needs_data
def test_titles_of_all_pages(spark):
    pages = {r.page_id: r.html for r in catalog.read(spark, D, "pages").collect()}
    raw = {i: re.search("<title>(.*?)</title>", h, re.S)[1] for i, h in pages.items()}
    assert any("&" in t for t in raw.values())
    got = {r.page_id: r.title for r in catalog.QUERIES["html_title"](spark, D).collect()}
    assert got == {i: " ".join(unescape(t).split()) for i, t in raw.items()}


@pytest.mark.parametrize("path", [pytest.param(D, marks=needs_data), None])
def test_headings_of_all_lines(spark, tmp_path, path):
    if path is None:
        path = str(tmp_path)
        odd = "# a\n#\n  b #\nc ## \n\n \t\nx # y\n####### seven\nI'm C#\n\u65e5\u672c\u8a9e # d"
        spark.createDataFrame([(4, odd), (5, None), (6, "")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    want = []
    for r in catalog.read(spark, path, "documents").collect():
        for k, line in enumerate((r.text or "").split("\n")):
            if re.search(r"\S", line, re.A):
                want.append((r.doc_id, k, 1 + r.doc_id % 3, re.sub(r"[ \t\r\f\v]+", " ", line).strip()))
    got = sorted(map(tuple, catalog.QUERIES["markdown_headings"](spark, path).collect()))
    assert got == sorted(want) and any("#" in x[3] for x in want)
