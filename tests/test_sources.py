import pytest

from gleanworks.operators import web
from gleanworks.sources import files, html, remote


@pytest.mark.parametrize(
    ("raw", "text", "encoding"),
    [
        ("网络协议".encode("gb18030"), "网络协议", ("gb18030", "gb2312")),
        ("甲\n乙".encode("utf-16"), "甲\n乙", ("utf-16",)),
        ("ab\ncd".encode("utf-16-le"), "ab\ncd", ("utf-16-heuristic",)),
        ("ab\ncd".encode("utf-16-be"), "ab\ncd", ("utf-16-heuristic",)),
        ("﻿a\n\nb".encode(), "a\n\nb", ("utf-8-sig",)),
        ("甲\r\n乙".encode(), "甲\n乙", ("utf-8-sig",)),
    ],
)
def test_decode(raw, text, encoding):
    got = files.decode(raw)
    assert got[0] == text and got[1] in encoding


def test_binary():
    with pytest.raises(files.UnreadableFile):
        files.decode(b"\0\0\0\0")


def test_markdown():
    src = "# T\n\npara\n\n## A\n```\na\n\nb\n```\n"
    got = files.markdown_blocks(src)
    assert [b["text"] for b in got] == ["# T", "para", "## A\n```\na\n\nb\n```"]
    assert got[2]["heading_path"] == ["T", "A"] and all(src[b["start"] : b["end"]] == b["text"] for b in got)


def test_pdf():
    assert files.pdf_fingerprint() == "8ac12aaace15a927a04393310f0e7879643dcb348edc8bf5d9e4a83b74fcb6de"
    long = "A page with enough text to be taken as it is, without recognition."
    got = files.pdf_blocks([long, "short"], ocr=lambda i: "read " + long)
    assert [b["extraction_method"] for b in got] == ["pdf_text", "pdf_ocr"]
    assert files.pdf_blocks(["x"])[0]["warnings"] == ["ocr_required_but_disabled"]
    assert files.pdf_blocks(["x"], ocr=lambda i: 1 / 0)[0]["warnings"][0].startswith("ocr_unavailable")
    assert files.needs_ocr("�" * 50) and not files.needs_ocr(long)
    assert files.page_text([(0, 0, 0, 0, " a "), (0,), (0, 0, 0, 0, "")]) == "a"
    with pytest.raises(files.UnreadableFile):
        files.pdf_blocks([""] * 3, max_pages=2)


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# H\ntext\n\nmore")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.docx").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/x.txt").write_text("secret")
    assert [p[-5:] for p in files.discover(tmp_path)] == ["/a.md", "b.txt", "d.pdf"]
    found = files.read_files(spark, str(tmp_path)).cache()
    assert found.count() == 3
    assert [r.error_type for r in files.failures(found).collect()] == ["UnreadableFile"]
    assert sorted(r.text for r in files.file_blocks(found).collect()) == ["# H\ntext", "more", "plain"]
    with pytest.raises(FileNotFoundError):
        files.discover(tmp_path / "none")


def test_jsonl(spark, tmp_path):
    files.write_jsonl_atomic([{"b": "é", "a": 1}, {"a": 2}], tmp_path / "x.jsonl")
    assert (tmp_path / "x.jsonl").read_text().startswith('{"a": 1, "b": "é"}\n')
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(ValueError, match="no JSON object"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")


PAGE = """<html><head><title>Guide</title><style>x</style></head><body><nav><a href='/n'>n</a></nav><main><h1>Top</h1><p>One <b>two</b>.</p>
<h2>Sub<span class='headerlink'>¶</span></h2><p>Three</p><ul><li>a<ul><li>a1</li></ul></li><li>b</li></ul><table><tr><th>h</th><td>v</td></tr><tr><td></td></tr></table>
<div><span>x</span> <span>y</span></div>bare<a href='/p#f'>p</a><a href='mailto:x'>m</a><a href='https://O.org/q'>q</a><a href='/p'>again</a></main><footer>f</footer><script>s</script></body></html>"""


def test_html_blocks():
    blocks, warnings, title = html.extract_blocks(PAGE)
    assert title == "Guide" and warnings == []
    assert [t for t, _ in blocks][:7] == ["One two .", "Three", "a", "a1", "b", "h | v", "x y"]
    assert blocks[1][1] == ["Guide", "Top", "Sub"]
    assert html.extract_links(PAGE, "http://h.org/d/") == ["http://h.org/p", "https://o.org/q"]
    assert html.extract_blocks("<p><b>a<p>b</p>")[0] == [("a b", [])]
    blocks, warnings, title = html.extract_blocks("<article><h1>H</h1></article>")
    assert (blocks, warnings, title) == ([], ["title-missing"], "H")


def test_hosts():
    blocked = ["localhost", "a.localhost", "127.0.0.1", "10.0.0.1", "169.254.1.1", "::1", "0.0.0.0", "224.0.0.1", ""]
    assert all(map(html.is_blocked_host, blocked)) and not html.is_blocked_host("example.org")


def test_crawl(spark):
    site = {
        "http://h.org/": "<main><a href='/a'>a</a><a href='/b'>b</a><a href='http://other.org/'>o</a><a href='/private'>p</a></main>",
        "http://h.org/a": "<main><a href='/c'>c</a></main>",
        "http://h.org/c": "<main>c</main>",
    }
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    allowed = lambda u: ~u.endswith("/private")
    got = [(r.url, r.depth, r.status) for r in web.crawl(pages, "HTTP://H.org/#x", allowed=allowed).orderBy("pos").collect()]
    assert got == [("http://h.org/", 0, "fetched"), ("http://h.org/a", 1, "fetched"), ("http://h.org/b", 1, "missing"), ("http://h.org/private", 1, "robots-disallowed")]
    deep = web.crawl(pages, "http://h.org/", web.CrawlConfig(max_depth=2, max_pages=2)).filter("status = 'fetched'").count()
    assert deep == 2


def test_remote():
    class Headers(dict):
        def get_content_charset(self):
            return "utf-8"

    class Reply:
        def __init__(self, body, kind):
            self.body, self.headers = body, Headers({"Content-Type": kind})

        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None
        geturl = lambda self: "http://h.org/End#x"
        read = lambda self, n: self.body[:n]

    opener = lambda body, kind="text/html; charset=utf-8": lambda request, timeout: Reply(body, kind)
    page = remote.fetch_url("HTTP://H.org/x#y", opener=opener(b"hi"))
    assert (page.url, page.final_url, page.text) == ("http://h.org/x", "http://h.org/End", "hi")
    for bad in (opener(b"x" * 20), opener(b"x", "image/png")):
        with pytest.raises(remote.FetchError):
            remote.fetch_url("http://h.org", max_bytes=10, opener=bad)
    robots = remote.Robots(lambda u: "User-agent: *\nDisallow: /private\nCrawl-delay: 2")
    assert robots.allows("http://h.org/private/x") == (False, 2.0) and robots.allows("http://h.org/x")[0]
    assert remote.Robots(lambda u: 1 / 0).allows("http://h.org/x") == (True, 0.0)
    drawn = remote.RenderingFetcher(lambda u: "<p>drawn</p>", lambda u: page)("http://h.org/x")
    assert drawn.text == "<p>drawn</p>"
    reply = {"choices": [{"message": {"content": [{"text": " ok "}], "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}}]}
    client = remote.ChatClient(lambda path, body: reply, "m")
    assert client.complete([]) == "ok" and client([], []).calls == (("1", "f", "{}"),)
    with pytest.raises(remote.ChatError):
        remote.ChatClient(lambda path, body: 1 / 0, "m").complete([])


def test_live_crawl():
    """Breadth first, politely: budgets, robots, failures, other hosts, no page twice."""
    from gleanworks.operators.web import CrawlConfig
    from gleanworks.sources import remote

    link = lambda *names: "<body><article>" + "".join(f"<p><a href='{n}'>x</a></p>" for n in names) + "</article></body>"
    site = {"/": link("/a", "/b", "/a#x", "https://else.example/"), "/a": link("/", "/c", "/no"), "/b": link("/bad", "/d"), "/c": link("/e"), "/d": link(), "/e": link(), "/robots.txt": "User-agent: *\nDisallow: /no\nCrawl-delay: 3"}
    waits, asked = [], []

    def fetch(url):
        asked.append(url)
        path = url.removeprefix("https://site.example")
        if path not in site:
            raise OSError("gone")
        return remote.Page(url, url, "text/html", b"", site[path], "utf-8")

    rows, queued = remote.crawl_live("https://Site.example/", CrawlConfig(max_depth=2), fetch, waits.append)
    got = [(r["url"].removeprefix("https://site.example"), r["depth"], r["status"]) for r in rows]
    assert got == [("/", 0, "fetched"), ("/a", 1, "fetched"), ("/b", 1, "fetched"), ("/c", 2, "fetched"), ("/no", 2, "robots-disallowed"), ("/bad", 2, "failed"), ("/d", 2, "fetched")]
    assert queued == 7 and waits == [3] * 5 and len(asked) == len(set(asked))
    few, _ = remote.crawl_live("https://site.example/", CrawlConfig(max_pages=2, max_depth=2, delay_seconds=9, respect_robots=False), fetch, waits.append)
    assert [r["url"][-1] for r in few] == ["/", "a"] and waits[-1] == 9
    far, _ = remote.crawl_live("https://site.example/", CrawlConfig(same_domain=False, respect_robots=False), fetch, waits.append)
    assert [r["status"] for r in far] == ["fetched"] * 3 + ["failed"] and far[-1]["error"] == "OSError: gone"


def test_workspace(tmp_path, monkeypatch):
    import os

    from gleanworks import workspace

    monkeypatch.delenv(workspace.ROOT, raising=False)
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    assert workspace.find(inner) == inner.resolve() / workspace.MARKER
    home = tmp_path / "a" / workspace.MARKER
    workspace.create(home, "1")
    first = (home / "workspace.json").read_text()
    workspace.create(home, "2")
    assert workspace.find(inner) == home.resolve() and (home / "workspace.json").read_text() == first
    (tmp_path / "a" / ".env").write_text("# c\nexport GW_ONE='x y'\nGW_TWO=2\nGW_THREE\n=4\n")
    monkeypatch.setenv("GW_TWO", "kept")
    monkeypatch.setenv("GW_ONE", "")
    monkeypatch.delenv("GW_ONE")
    assert workspace.load_settings(home) == ["GW_ONE"] and os.environ["GW_ONE"] == "x y" and os.environ["GW_TWO"] == "kept"
    monkeypatch.setenv(workspace.ROOT, str(tmp_path))
    assert workspace.find(inner) == tmp_path.resolve() / workspace.MARKER
