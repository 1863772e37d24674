"""The pipeline against a brute-force version, stage by stage."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .test_operators import brute_components, brute_contamination


def test_stages(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(1, docs.filter("doc_id = 30").first().text[4:120])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in at.collect()]
        path = str(tmp_path / name)
        stage(spark, at, str(tmp_path)).write.parquet(path)
        at = spark.read.parquet(path)
        if name != "packing":
            assert at.columns == columns
        rows = [(r.doc_id, r.text) for r in at.collect()] if name != "packing" else at.collect()
        if name == "language_id":
            assert sorted(map(str, rows)) == sorted(str(x) for x in before if any(c.isalpha() for c in x[1] or ""))
        if name == "near_dedup":
            want = {x[0] for x in brute_components(before) if x[3]}
            assert {i for i, _ in rows} == want
        if name == "decontamination":
            assert {i for i, _ in rows} == {x[0] for x in brute_contamination(before, bench) if not x[5]}
            assert len(rows) < len(before)
        kept[name] = rows
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert sum(r.length for r in kept["packing"]) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in kept["decontamination"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(packed) == key(kept["packing"])


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
