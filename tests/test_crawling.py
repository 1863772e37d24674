"""Crawls in executors against the one that goes page by page, on the same made-up sites."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from gleanworks.operators import crawling
from gleanworks.operators.web import CrawlConfig
from gleanworks.sources import remote

ROBOTS = {"a.example": "User-agent: *\nDisallow: /p3\nCrawl-delay: 4", "b.example": None, "c.example": "User-agent: *\nDisallow: /"}


def site(url, log=None):
    """Page n links to 2n + 1, 2n + 2, itself, another host and a page that fails; n ends at 40."""
    if log:
        with open(log, "a") as f:
            f.write(url + "\n")
    scheme, _, rest = url.partition("://")
    name, _, path = rest.partition("/")
    if path == "robots.txt":
        if ROBOTS.get(name) is None:
            raise ConnectionError("no robots")
        return SimpleNamespace(text=ROBOTS[name], final_url=url)
    if path.startswith("bad") or name not in ROBOTS:
        raise ConnectionError(f"no {path}")
    n = int(path[1:] or 0)
    links = [f"/bad{n}", f"/p{2 * n + 1}", f"/p{2 * n + 2}#x", f"/p{n}", "https://b.example/p2"] if n < 40 else []
    return SimpleNamespace(text="<html><body>" + "".join(f"<a href='{x}'>x</a>" for x in links) + "</body></html>", final_url=url)


@pytest.mark.parametrize("config", [CrawlConfig(5, 2, 1.5), CrawlConfig(9, 3, 0, respect_robots=False), CrawlConfig(4, 1, 9, same_domain=False)])
def test_as_page_by_page(spark, tmp_path, config):
    starts = ["https://a.example/p0", "https://B.example/p0", "https://c.example/p0"]
    log = str(tmp_path / "log")
    fetch = lambda u: site(u, log)
    found = crawling.crawl_sites(spark, starts, crawling.live(fetch, lambda s: None), str(tmp_path / "w"), config, crawling.live_robots(fetch)).collect()
    for s in starts:
        rows, queued = remote.crawl_live(s, config, site, lambda x: None)
        mine = sorted((r for r in found if r.site == s), key=lambda r: r.pos)
        assert [(r.url, r.depth, r.status, r.html, r.error) for r in mine] == [(r["url"], r["depth"], r["status"], r["html"], r["error"]) for r in rows]
        assert [r.pos for r in mine] == list(range(1, len(rows) + 1))
        assert {r.links_found for r in mine} == {queued - len(rows)}
    said = Path(log).read_text().splitlines()
    pages = [u for u in said if not u.endswith("robots.txt")]
    assert sorted(pages) == sorted(r.url for r in found if r.status != "robots-disallowed")
    assert len(said) - len(pages) == (len({r.host for r in found}) if config.respect_robots else 0)
    for h in {r.host for r in found}:
        at = sorted((r for r in found if r.host == h and r.status != "robots-disallowed"), key=lambda r: (r.depth, r.start))
        delay = max(config.delay_seconds, 4 if h == "a.example" and config.respect_robots else 0)
        assert [r.start for r in at] == [i * delay for i in range(len(at))]


def test_stored_pages_and_odd_starts(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.example/", "<a href='/x'>x</a><a href='/gone'>g</a>"), ("https://a.example/x", "t")], "url string, html string")
    found = crawling.crawl_sites(spark, ["https://A.example/", "no url", "https://none.example/"], crawling.stored(pages), str(tmp_path), CrawlConfig(5, 2, 1))
    got = sorted((r.site, r.pos, r.url, r.status, r.start) for r in found.collect())
    assert got == [
        ("https://A.example/", 1, "https://a.example/", "fetched", 0.0), ("https://A.example/", 2, "https://a.example/x", "fetched", 1.0), ("https://A.example/", 3, "https://a.example/gone", "failed", 2.0),
        ("https://none.example/", 1, "https://none.example/", "failed", 0.0), ("no url", 1, "no url", "failed", 0.0),
    ]
    assert crawling.crawl_sites(spark, [], crawling.stored(pages), str(tmp_path)).count() == 0


def test_command(spark, tmp_path, monkeypatch, capsys):
    """ingest-url --crawl stores what it read, reports what failed, and takes a page again without storing it twice."""
    import json

    from gleanworks import cli
    from gleanworks.sources.store import Store

    def page(url):
        if url.endswith("robots.txt") or "gone" in url:
            raise ConnectionError("no")
        return SimpleNamespace(text="<html><title>T</title><body><article><p>Words of " + url + "</p><a href='/x'>x</a><a href='/gone'>g</a></article></body></html>", final_url=url)

    monkeypatch.setattr(remote, "fetch_url", page)
    ws = str(tmp_path / "ws")
    for k, added in enumerate((2, 0)):
        code = cli.main(["ingest-url", "https://site.example/", "--crawl", "--delay", "0", "--workspace", ws])
        out = json.loads(capsys.readouterr().out)
        assert code == 2 and (out["documents"], out["failed"], out.get("added", 2), out["links_found"]) == (2, 1, added, 0)
    store = Store(spark, ws)
    assert store.version() == 2 and {r.source_path for r in store.read("chunks").collect()} == {"https://site.example/", "https://site.example/x"}
    assert {r.message for r in store.read("failures").collect()} == {"ConnectionError: no"}
