"""Commands over a workspace: a folder of versioned snapshots."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas, workspace
from .functions import identity
from .functions.embedders import create_embedder
from .operators import agent, agent_runs, answering, chunking, crawling, evaluation, harness, incremental, index, web
from .sources import files, html, remote
from .sources.store import Store, bucket

__version__ = "0.1.0"


class Workspace:
    """Tables documents, chunks, index, meta and failures, of one version."""

    def __init__(self, root: str):
        self.root = root

    def store(self, spark: SparkSession) -> Store:
        return Store(spark, self.root)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.store(spark).read(name)


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("gleanworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _store(store: Store, spark: SparkSession, sources: DataFrame, blocks: DataFrame, failures: DataFrame, args, classes: DataFrame, began: int, afresh: bool = False) -> dict:
    """Chunk, embed and write the version after ``began``. ``sources``: files or pages that were
    read, with or without blocks. ``classes`` (source_path, status): whose rows are replaced or
    deleted; only their buckets are read and written, unless vectors are of another provider.
    ``afresh``: nothing of the old version stays."""
    config = chunking.ChunkConfig(args.max_chars, args.overlap)
    embedder = create_embedder(args.embedding, args.dimension)
    fresh = chunking.chunk_blocks(blocks, config)
    named = sources.select("doc_id", "source_id", "source_path", "file_type", "content_hash", "ingestion_fingerprint").withColumn("warnings", F.array().cast("array<string>"))
    documents = chunking.manifest(named, blocks, fresh).withColumn("chunking_fingerprint", F.lit(config.fingerprint))
    chunks, only, again, memory = fresh, None, 0, f"{store.root}/memory"
    if afresh or not began:
        made = index.build(chunks, embedder, memory).withColumn("reused", F.lit(False))
    else:
        meta = store.read("meta").first()
        moved = classes.filter(F.col("status").isin("added", "updated", "deleted"))
        touched = [r.b for r in moved.select(bucket(F.col("source_path"), store.buckets).alias("b")).distinct().collect()]  # at most all buckets
        only = {"chunks": touched, "documents": touched}
        documents = incremental.merge(store.read("documents", touched), documents, classes)
        chunks = incremental.merge(store.read("chunks", touched), fresh, classes)
        if meta.provider_fingerprint == embedder.fingerprint:
            only["index"] = touched
            made = index.update(chunks, store.read("index", touched), embedder, memory=memory)
            again = store.read("index").count() - store.read("index", touched).count()
        else:
            made = index.build(incremental.merge(store.read("chunks"), fresh, classes), embedder, memory).withColumn("reused", F.lit(False))
    tables = {"chunks": chunks, "documents": documents, "failures": failures, "index": made, "meta": lambda read: index.meta(read("index"), embedder)}
    counted = incremental.counters(classes, fresh).first().asDict()
    version = store.write(tables, began, only)
    s = index.update_stats(store.read("index", (only or {}).get("index"))).first()
    return {"version": f"v{version}", "documents": store.read("documents").count(), "failed": failures.count(), "embedded": s.embedded, "reused": s.reused + again, **counted}


def ingest(args, spark: SparkSession) -> int:
    """Files below a path. With --incremental, files are hashed first; only those that are
    new or have changed are decoded, chunked and embedded."""
    files.discover(args.path)
    store = Workspace(args.workspace).store(spark)
    began = store.version()
    again = args.incremental and began > 0
    root = Path(args.path).expanduser().resolve()
    fingerprint = chunking.ChunkConfig(args.max_chars, args.overlap).fingerprint
    none = "source_path string, content_hash string, ingestion_fingerprint string, chunking_fingerprint string, chunk_count long"
    past = store.read("documents").select("source_path", "content_hash", "ingestion_fingerprint", "chunking_fingerprint", "chunk_count") if again else spark.createDataFrame([], none)
    stored = store.read("chunks").groupBy("source_path").agg(F.count("*").alias("chunks")) if again else spark.createDataFrame([], "source_path string, chunks long")
    whole = past.filter(F.col("chunking_fingerprint") == fingerprint).join(stored, "source_path", "left").filter(F.coalesce("chunks", F.lit(0)) == F.col("chunk_count"))
    found = files.read_files(spark, args.path, known=whole if again else None, max_bytes=int(args.max_file_mb * (1 << 20))).cache()
    classes = incremental.classify(found.select("source_path", "content_hash", "ingestion_fingerprint", F.col("loaded.error_type").alias("error")), past, stored, str(root), fingerprint, root.is_dir()).cache()
    fresh = found.filter("loaded IS NOT NULL").join(classes.filter(F.col("status").isin("added", "updated")), "source_path", "left_semi")
    out = _store(store, spark, fresh, files.file_blocks(fresh), files.failures(found), args, classes, began, not again)
    for df in (found, classes):
        df.unpersist()  # the same path may hold other bytes next time
    print(json.dumps(out, ensure_ascii=False))
    return 2 if out["failed"] else 0


def ingest_url(args, spark: SparkSession) -> int:
    store = Workspace(args.workspace).store(spark)
    began = store.version()
    counts = {}
    if args.crawl:
        config = web.CrawlConfig(args.max_pages, args.max_depth, args.delay, not args.cross_domain, not args.no_robots)
        robots = crawling.live_robots(remote.fetch_url) if config.respect_robots else None
        found = crawling.crawl_sites(spark, args.urls, crawling.live(remote.fetch_url), f"{store.root}/crawls", config, robots, remote.USER_AGENT)
        pages = found.select("url", "html", F.coalesce("error", F.when(F.col("html").isNull(), F.col("status"))).alias("error")).dropDuplicates(["url"])
        counts = {"links_found": found.select("site", "links_found").distinct().agg(F.coalesce(F.sum("links_found"), F.lit(0)).alias("n")).first().n}
    else:
        pages = web.offline_pages(spark, lambda u: remote.fetch_url(u).text, args.urls)
    rows = pages.filter("html IS NOT NULL").select(web.normalize_url(F.col("url")).alias("source_path"), "html")
    rows = rows.withColumns({"source_id": identity.source_id(F.col("source_path")), "content_hash": F.sha2("html", 256)})
    rows = rows.withColumns({"doc_id": identity.document_id(F.col("source_id"), F.col("content_hash")), "file_type": F.lit("html"), "ingestion_fingerprint": F.lit(identity.ingestion_fingerprint("html"))}).dropDuplicates(["doc_id"])
    docs = html.page_documents(rows)
    blocks = docs.select("doc_id", "source_id", "source_path", "content_hash", F.posexplode("blocks").alias("block_pos", "b")).select("*", "b.text", "b.heading_path").drop("b")
    blocks = web.block_offsets(blocks).withColumns({"file_type": F.lit("html"), "ingestion_fingerprint": F.lit(identity.ingestion_fingerprint("html")), "extraction_method": F.lit("html"), "page_number": F.lit(None).cast("int"), "encoding": F.lit("utf-8"), "warnings": F.array().cast("array<string>")})
    failed = pages.filter("html IS NULL").select(F.col("url").alias("source_path"), F.lit("FetchError").alias("error_type"), F.col("error").alias("message"))
    classes = rows.select("source_path", F.lit("updated").alias("status"), F.lit(0).alias("old_chunks"))
    if began:
        past = store.read("documents").select("source_path", "content_hash", "ingestion_fingerprint", F.lit(0).alias("ordinal"))
        counts |= web.merge_counts(blocks.select("source_path", "content_hash", "ingestion_fingerprint").distinct(), past).first().asDict()
    out = _store(store, spark, rows, blocks, failed, args, classes, began) | counts
    print(json.dumps(out, ensure_ascii=False))
    return 2 if out["failed"] else 0


def _search(ws: Workspace, spark: SparkSession, questions: list[str], k: int, least: float, where: Column | None = None) -> DataFrame:
    meta = ws.read(spark, "meta").first()
    embedder = create_embedder(meta.provider_name, meta.dimension or None)
    index.check_provider(meta.provider_fingerprint, meta.dimension, embedder)
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string").withColumn("query_vector", embedder.column(F.col("question")))
    found = index.search(ws.read(spark, "index"), asked.filter(F.trim("question") != ""), k, least, where)
    return index.search_results(found, ws.read(spark, "chunks"))


def _where(args) -> Column | None:
    """The filter of --source and --file-type, or None."""
    wanted = [F.col(c) == v for c, v in (("source_path", args.source), ("file_type", args.file_type)) if v]
    return reduce(lambda a, b: a & b, wanted) if wanted else None


def search(args, spark: SparkSession) -> int:
    for r in _search(Workspace(args.workspace), spark, [args.query], args.top_k, args.min_score, _where(args)).orderBy("rank").toJSON().collect():
        print(r)
    return 0


def ask(args, spark: SparkSession) -> int:
    """An answer with its evidence as context; the context alone with --dry-run or --retrieval-only."""
    results = _search(Workspace(args.workspace), spark, [args.query], args.top_k, args.min_score, _where(args))
    chat = None
    if not (args.dry_run or args.retrieval_only):
        client = remote.ChatClient.from_environment()
        chat = lambda q, c: client.complete([{"role": "system", "content": agent.LOCAL_PROMPT}, {"role": "user", "content": f"{c}\n\n{q}"}])
    asked = spark.createDataFrame([(0, args.query)], "query_id long, question string")
    got = answering.answer(asked, results, chat, args.max_context_chars).first()
    print(json.dumps({k: got[k] for k in ("question", "answer", "context")}, ensure_ascii=False) if args.json else got.answer)
    return 0


def evaluate(args, spark: SparkSession) -> int:
    rows = files.read_jsonl(spark, args.samples, schemas.SAMPLE)
    listed = [dict(ordinal=i, **r.asDict()) for i, r in enumerate(rows.collect(), 1)]  # a labelled file, read by a person
    samples = evaluation.samples(spark.createDataFrame(listed, f"ordinal long, {schemas.SAMPLE}"))
    if bad := samples.filter("problem IS NOT NULL").first():
        raise ValueError(f"sample {bad.ordinal}: {bad.problem}")
    found = _search(Workspace(args.workspace), spark, [r["query"] for r in listed], args.top_k, args.min_score).withColumn("query_id", F.col("query_id") + 1)
    print(evaluation.report(evaluation.sample_results(samples, found)).toJSON().first())
    return 0


def run_harness(args, spark: SparkSession) -> int:
    """A task file, answered and scored, --repeat times: by the mechanical answerer, or by
    the agent with --real; judged by a model with --judge. --limit takes the first tasks."""
    rows, problems = harness.scan_tasks(spark, args.tasks)
    if bad := problems.orderBy("file", "line").first():
        raise ValueError(f"{args.tasks}, line {bad.line}: {bad.problem}: {bad.value[:80]}")
    rows = rows.orderBy("file", "line").drop("file", "line")
    listed = rows.take(args.limit) if args.limit else rows.collect()
    rows = spark.createDataFrame(listed, rows.schema)
    ws = Workspace(args.workspace)
    none = F.array().cast("array<string>")
    tasks = rows.select(F.col("id").alias("task_id"), "query", F.coalesce("expected_points", none).alias("expected_points"), F.coalesce("task_type", F.lit("answerable")).alias("task_type"), F.coalesce("auto", F.lit(False)).alias("auto"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("relevant_chunk_ids", none).alias("relevant_chunk_ids"), F.coalesce("relevant_source_paths", none).alias("relevant_source_paths"))
    if args.real:
        audits = _agent_audits(ws, spark, tasks.select("task_id", "query"), args.repeat, args.max_steps)
    else:
        results = _search(ws, spark, [r.query for r in listed], 5, 0.08).cache()
        ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(listed)], "query_id long, task_id string")
        found = results.join(ids, "query_id").withColumn("query_id", F.col("task_id"))
        answers = harness.ideal_answers(tasks.select("task_id"), found)
        hits = found.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_path", "text"))).alias("results"))
        call = F.array(F.struct(F.lit(agent.SEARCH).alias("name"), F.coalesce("results", F.array().cast(hits.schema["results"].dataType)).alias("results")))
        runs = F.explode(F.sequence(F.lit(0), F.lit(args.repeat - 1))).alias("run_id")
        evidence = F.transform(F.coalesce("results", F.array().cast(hits.schema["results"].dataType)), lambda r: F.struct(F.lit("local").alias("source_type"), r["source_path"].alias("source_path"), r["text"].alias("text")))
        audits = answers.join(hits, "task_id", "left").select("task_id", runs, "answer", evidence.alias("evidence"), call.alias("tool_calls"))
    metrics = harness.task_metrics(tasks.drop("query", "expected_points"), audits).join(tasks.select("task_id", "auto", "category"), "task_id")
    verdicts = None
    if args.judge:
        client = remote.ChatClient.from_environment()
        last = audits.filter(F.col("run_id") == args.repeat - 1)
        verdicts = harness.judge(harness.judge_prompts(tasks, last), client.complete, f"{ws.store(spark).root}/memory", client.model)  # each answer is judged once
    done = harness.report(metrics, "real" if args.real else "fake", "agent" if args.real else "ideal-script", identity.sha256_text(Path(args.tasks).read_text(encoding="utf-8")), verdicts)
    if args.calibrate:
        done["calibration"] = harness.calibrate(harness.calibration_samples(spark), remote.ChatClient.from_environment().complete).first().asDict()
    for r in sorted(done["aggregate"], key=lambda r: (r["section"], r["label"])):
        print(json.dumps(r, ensure_ascii=False))
    if args.compare:
        print(json.dumps(harness.compare_reports(json.loads(Path(args.compare).read_text()), done), ensure_ascii=False))
    if args.report:  # a folder gets a new file by the second
        target = Path(args.report)
        if target.is_dir():
            target /= harness.report_name(datetime.now(timezone.utc), {p.name for p in target.iterdir()})
        target.write_text(json.dumps(done, ensure_ascii=False, sort_keys=True))
    return 0


def _agent_audits(ws: Workspace, spark: SparkSession, tasks: DataFrame, repeat: int, steps: int | None = None) -> DataFrame:
    """What the agent says and does, all tasks and runs at once: a batch of searches for each step."""
    meta = ws.read(spark, "meta").first()
    embedder = create_embedder(meta.provider_name, meta.dimension or None)
    index.check_provider(meta.provider_fingerprint, meta.dimension, embedder)

    def batch(wanted: DataFrame) -> DataFrame:
        found = index.search(ws.read(spark, "index"), wanted.select("query_id", "min_score", embedder.column(F.col("query")).alias("query_vector")), agent.MOST_RESULTS)
        near = index.search_results(found.join(wanted.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= F.col("top_k")).drop("top_k"), ws.read(spark, "chunks"))
        return near.select("query_id", "rank", F.to_json(F.struct(*(c for c in near.columns if c != "query_id")), {"ignoreNullFields": "false"}).alias("result"))

    runs = agent_runs.run_agents(tasks, remote.ChatClient.from_environment(), batch, f"{ws.store(spark).root}/runs", repeat, steps)
    each = "array<struct<source_type:string,source_path:string,chunk_id:string,text:string>>"
    local = lambda r: F.struct(F.coalesce(r["source_type"], F.lit("local")).alias("source_type"), r["source_path"].alias("source_path"), r["chunk_id"].alias("chunk_id"), r["text"].alias("text"))
    seen = lambda c: F.transform(F.coalesce(c["result"]["results"], F.array().cast(each)), local)
    calls = F.from_json("tool_calls", f"array<struct<name:string,result:struct<results:{each}>>>")
    return runs.select("task_id", "run_id", "answer", F.from_json("evidence", each).alias("evidence"), F.transform(calls, lambda c: F.struct(c["name"].alias("name"), seen(c).alias("results"))).alias("tool_calls"))


def _agent(args, spark: SparkSession) -> agent.Agent:
    ws = Workspace(args.workspace)
    tool = agent.SearchTool(lambda q, k, least: [r.asDict(True) for r in _search(ws, spark, [q], k, least).orderBy("rank").collect()])
    pages = agent.WebTool(lambda u: (lambda p: (p.final_url, p.content_type, p.text))(remote.fetch_url(u))) if args.web else None
    return agent.Agent(tool, remote.ChatClient.from_environment(), pages, max_steps=args.max_steps)


def _history(args) -> tuple[agent.History, Path | None]:
    kept = Path(args.history) if args.history else None
    past = agent.History.load(kept, args.history_max_turns) if kept and kept.exists() else agent.History(max_turns=args.history_max_turns)
    return past, kept


def run_agent(args, spark: SparkSession) -> int:
    past, kept = _history(args)
    got = _agent(args, spark).run(args.query, past)
    print(got.answer)
    if kept:
        got.history.save(kept)
    return 0 if got.stopped_reason == "completed" else 2


def chat(args, spark: SparkSession) -> int:
    """Reads questions from standard input until it ends; with --retrieval-only it shows what was found for each."""
    past, kept = _history(args)
    speaker = None if args.retrieval_only else _agent(args, spark)
    for line in filter(str.strip, sys.stdin):
        if speaker is None:
            found = _search(Workspace(args.workspace), spark, [line.strip()], args.top_k, args.min_score)
            asked = spark.createDataFrame([(0, line.strip())], "query_id long, question string")
            print(answering.answer(asked, found, None, args.max_context_chars).first().answer, flush=True)
            continue
        got = speaker.run(line, past)
        past = got.history
        print(got.answer, flush=True)
        if kept:
            past.save(kept)
    return 0


def list_documents(args, spark: SparkSession) -> int:
    for r in Workspace(args.workspace).read(spark, "documents").select("source_path", "file_type", "block_count", "chunk_count").orderBy(F.lower("source_path"), "source_path").toJSON().toLocalIterator():
        print(r)
    return 0


def rebuild_index(args, spark: SparkSession) -> int:
    store = Workspace(args.workspace).store(spark)
    began = store.version()
    embedder = create_embedder(args.embedding, args.dimension)
    made = index.build(store.read("chunks").filter(F.trim("text") != ""), embedder, f"{store.root}/memory").withColumn("reused", F.lit(False))
    print(f"v{store.write({'index': made, 'meta': lambda read: index.meta(read('index'), embedder)}, began)}")
    return 0


def doctor(args, spark: SparkSession) -> int:
    """0 if the index is one that its description's provider makes."""
    store = Workspace(args.workspace).store(spark)
    if not store.version():
        print("no workspace")
        return 1
    meta = store.read("meta").first()
    try:
        rows = store.read("index").select("chunk_id", "vector")
        index.validate(rows, meta.dimension or None)
        if rows.count() != meta.chunk_count:
            raise index.IndexProblem(f"the index has {rows.count()} rows, its description says {meta.chunk_count}")
        index.check_provider(meta.provider_fingerprint, meta.dimension, create_embedder(meta.provider_name, meta.dimension or None))
    except index.IndexProblem as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(meta.asDict(), ensure_ascii=False))
    return 0


def init(args, spark: SparkSession | None) -> int:
    workspace.create(Path(args.workspace), __version__)
    return 0


def version(args, spark: SparkSession | None) -> int:
    print(__version__)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gleanworks")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(required=True)

    def option(*flags, **more):
        return lambda c: c.add_argument(*flags, **more)

    def group(*options):
        return lambda c: [o(c) for o in options]

    number = lambda flag, n: option(flag, type=int, default=n)
    flag = lambda *names: group(*(option(n, action="store_true") for n in names))
    named = lambda *names: group(*(option(n, default=None) for n in names))
    retrieval = lambda least: group(number("--top-k", 5), option("--min-score", type=float, default=least))
    filters = named("--source", "--file-type")
    embedding = group(option("--embedding", "--embedding-provider", default=None), option("--dimension", "--embedding-dimensions", type=int, default=None))
    chunks = group(number("--max-chars", 1200), number("--overlap", 120), embedding)
    context = number("--max-context-chars", answering.MAX_CHARS)
    steps = number("--max-steps", agent.Agent.max_steps)
    history = group(named("--history"), number("--history-max-turns", agent.History.max_turns))

    def command(name, run, *parts):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--workspace", default=None)
        for x in parts:
            x(c)

    command("init", init)
    command("version", version)
    command("doctor", doctor)
    command("ingest", ingest, option("path"), chunks, option("--max-file-mb", type=float, default=files.MAX_BYTES / (1 << 20)), flag("--incremental"))
    crawl = group(number("--max-pages", 10), number("--max-depth", 1), option("--delay", type=float, default=1.0), flag("--crawl", "--cross-domain", "--no-robots"))
    command("ingest-url", ingest_url, option("urls", nargs="+"), chunks, crawl)
    command("search", search, option("query"), retrieval(0.0), filters)
    command("ask", ask, option("query"), retrieval(0.08), filters, context, flag("--dry-run", "--retrieval-only", "--json"))
    command("chat", chat, retrieval(0.08), context, steps, history, flag("--web", "--retrieval-only"))
    command("agent", run_agent, option("query"), steps, history, flag("--web"))
    command("evaluate", evaluate, option("samples"), retrieval(0.0))
    command("harness", run_harness, option("tasks"), number("--limit", 0), number("--repeat", 1), steps, named("--report", "--compare"), flag("--real", "--judge", "--calibrate"))
    command("list-documents", list_documents)
    command("rebuild-index", rebuild_index, embedding)
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: an unsound workspace; 2: failures; 130: interrupted."""
    args = parser().parse_args(argv)
    args.workspace = args.workspace or str(workspace.find())
    workspace.load_settings(Path(args.workspace))
    try:
        return args.run(args, None if args.run in (init, version) else spark_session())
    except KeyboardInterrupt:
        return 130
    except (ValueError, FileNotFoundError, remote.ChatError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
