"""What lies beyond the cluster: web pages, robots rules, chat models. All of it
is injected or called on the driver; tests and batch queries use stored tables."""

from __future__ import annotations

import json
import os
import time
import urllib.request
import urllib.robotparser
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from ..operators.agent import Turn
from .html import extract_links, normalize_url

# Content types that are read.
CONTENT_TYPES = frozenset(("text/html", "application/xhtml+xml", "text/plain"))
USER_AGENT = "gleanworks/0.1"


class FetchError(ValueError):
    pass


@dataclass(frozen=True)
class Page:
    url: str
    final_url: str
    content_type: str
    body: bytes
    text: str
    charset: str


def fetch_url(url: str, timeout: float = 15.0, max_bytes: int = 5 << 20, user_agent: str = USER_AGENT, opener: Callable = urllib.request.urlopen) -> Page:
    """One page; too large ones fail rather than being cut."""
    url = normalize_url(url)
    request = urllib.request.Request(url, headers={"User-Agent": user_agent, "Accept": "text/html,application/xhtml+xml,text/plain;q=0.9,*/*;q=0.5"})
    try:
        with opener(request, timeout=timeout) as r:
            kind = (r.headers.get("Content-Type") or "").split(";")[0].strip().lower()
            charset = r.headers.get_content_charset() or "utf-8"
            final, body = r.geturl() or url, r.read(max_bytes + 1)
    except Exception as e:
        raise FetchError(f"{url}: {type(e).__name__}: {e}") from e
    if len(body) > max_bytes:
        raise FetchError(f"{url}: more than {max_bytes} bytes")
    if kind and kind not in CONTENT_TYPES:
        raise FetchError(f"{url}: {kind} isn't read")
    return Page(url, normalize_url(final), kind or "text/html", body, body.decode(charset, "replace"), charset)


@dataclass
class RenderingFetcher:
    """Fetches statically, then lets an injected engine render HTML pages."""

    render: Callable[[str], str]
    fetch: Callable[[str], Page] = fetch_url
    max_bytes: int = 5 << 20

    def __call__(self, url: str) -> Page:
        page = self.fetch(url)
        if page.content_type == "text/plain":
            return page
        text = self.render(page.final_url)
        body = text.encode()
        if len(body) > self.max_bytes:
            raise FetchError(f"{url}: rendered to more than {self.max_bytes} bytes")
        return Page(page.url, page.final_url, page.content_type, body, text, "utf-8")


@dataclass
class Robots:
    """robots.txt rules by host; a host whose file can't be had allows all."""

    fetch: Callable[[str], str]
    user_agent: str = USER_AGENT
    rules: dict = field(default_factory=dict)

    def allows(self, url: str) -> tuple[bool, float]:
        parts = urlsplit(url)
        home = f"{parts.scheme}://{parts.netloc}/robots.txt"
        if home not in self.rules:
            try:
                parser = urllib.robotparser.RobotFileParser()
                parser.parse(self.fetch(home).splitlines())
            except Exception:  # noqa: BLE001
                parser = None
            self.rules[home] = parser
        parser = self.rules[home]
        if parser is None:
            return True, 0.0
        delay = parser.crawl_delay(self.user_agent) or parser.crawl_delay("*") or 0
        return parser.can_fetch(self.user_agent, url), float(delay)


def crawl_live(start_url: str, config, fetch: Callable[[str], Page], sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], int]:
    """Reads pages breadth first from a live site: rows of url, depth, status, html,
    final_url, error, in the order of visit, and how many links were put on the queue.

    ``config``: a ``CrawlConfig``. Between requests the larger of its delay and the site's
    own is waited for, so this is a loop over at most ``max_pages`` pages and the
    failures among their links. Failures use no page budget."""
    home = normalize_url(start_url)
    robots = Robots(lambda u: fetch(u).text) if config.respect_robots else None
    level, seen, rows, queued = [home], {home}, [], 1
    read = 0
    for depth in range(config.max_depth + 1):
        below: list[str] = []
        for url in level:
            if read == config.max_pages:
                return rows, queued
            allowed, own_delay = robots.allows(url) if robots else (True, 0.0)
            row = {"url": url, "depth": depth, "status": "robots-disallowed", "html": None, "final_url": None, "error": None}
            rows.append(row)
            if not allowed:
                continue
            if len(rows) > 1:
                sleep(max(config.delay_seconds, own_delay))
            try:
                page = fetch(url)
            except Exception as e:  # noqa: BLE001  an injected fetcher may raise anything
                row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
                continue
            read += 1
            row |= {"status": "fetched", "html": page.text, "final_url": page.final_url}
            if depth == config.max_depth:
                continue
            links = [x for x in extract_links(page.text, page.final_url) if not config.same_domain or urlsplit(x).netloc == urlsplit(home).netloc]
            queued += sum(x not in seen for x in links)
            below += [x for x in links if x not in seen]
            seen.update(links)
        level = below
    return rows, queued


class ChatError(RuntimeError):
    pass


@dataclass(frozen=True)
class ChatClient:
    """An OpenAI-compatible model behind an injected ``post`` (path, body) to a reply."""

    post: Callable[[str, dict], dict]
    model: str
    temperature: float = 0.2
    max_tokens: int = 1200

    @classmethod
    def from_environment(cls, post: Callable[[str, dict], dict] | None = None, **options) -> ChatClient:
        env = lambda *names: next((os.environ[n] for n in names if os.environ.get(n)), None)
        model, key, base = env("LLM_MODEL", "OPENAI_MODEL"), env("LLM_API_KEY", "OPENAI_API_KEY"), env("LLM_BASE_URL", "OPENAI_BASE_URL")
        if not model or not (post or key):
            raise ChatError("LLM_MODEL and LLM_API_KEY must be set")

        def http(path: str, body: dict) -> dict:
            request = urllib.request.Request(f"{(base or 'https://api.openai.com/v1').rstrip('/')}{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.load(r)

        return cls(post or http, model, **options)

    def _reply(self, messages: list[dict], **more) -> dict:
        try:
            return self.post("/chat/completions", {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, **more})["choices"][0]["message"]
        except Exception as e:
            raise ChatError(f"{type(e).__name__}: {e}") from e

    @staticmethod
    def _text(content) -> str:
        if isinstance(content, list):
            content = "".join(x.get("text", "") if isinstance(x, dict) else str(x) for x in content)
        return (content or "").strip()

    def complete(self, messages: list[dict]) -> str:
        text = self._text(self._reply(messages).get("content"))
        if not text:
            raise ChatError("the model returned nothing")
        return text

    def __call__(self, messages: list[dict], tools: list[dict]) -> Turn:
        """For ``Agent``: an answer, or calls of tools."""
        schema = [{"type": "function", "function": t} for t in tools]
        call = lambda c: {"id": c[0], "type": "function", "function": {"name": c[1], "arguments": c[2]}}
        sent = [m | {"tool_calls": [call(c) for c in m["tool_calls"]]} if m.get("tool_calls") else {k: v for k, v in m.items() if k != "tool_calls"} for m in messages]
        reply = self._reply(sent, tools=schema)
        calls = []
        for c in reply.get("tool_calls") or ():
            f = c.get("function") or {}
            if not c.get("id") or not f.get("name"):
                raise ChatError("an incomplete tool call")
            calls.append((c["id"], f["name"], f.get("arguments", "{}")))
        return Turn(self._text(reply.get("content")) or None, tuple(calls))
