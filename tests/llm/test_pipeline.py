"""The pipeline's stages against what their operators say about the stage's own input."""

from __future__ import annotations

import corpus_pipeline
import pyarrow.ipc as ipc
from test_nearcopies import brute

from rowloom import session
from rowloom.llm import catalog, decontaminate, langid, sequences


def test_stages(spark, folder):
    docs = catalog.table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before, name
        if name == "language_id":
            model = catalog.language_model(docs)
            said = langid.predict_languages(docs, model, "text", ["doc_id"]).collect()
            assert after == {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= model.threshold}
        if name == "simhash_near_dedup":
            given = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
            assert after == {given[i][0] for i in brute([t for _, t in given])} and out.count() == len(after)
        if name == "benchmark_decontamination":
            items = catalog.table(spark, folder, "benchmark")
            said = decontaminate.overlaps(docs, "text", items, "item_id", "text", ["doc_id"])
            assert after == {r[0] for r in said.where(~decontaminate.is_contaminated()).select("doc_id").collect()}
        if name == "token_id_output":
            assert out.count() == docs.count()
        else:
            assert out.columns == columns
        docs = out


def test_run_gives_the_last_stage(spark, folder, tmp_path, monkeypatch):
    """What a run leaves written: the token files in their own folder, no texts in the shared one."""
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    output = str(tmp_path / "tokens")
    found = corpus_pipeline.run(spark, folder, output)
    rows = found.orderBy("start").collect()
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows
    left = [p for p in (tmp_path / "rowloom").rglob("*.parquet") if "text" in spark.read.parquet(f"file://{p}").columns]
    assert left == []
    manifest = spark.newSession().read.parquet(f"{output}/manifest")
    assert sequences.read_documents(manifest, "doc_id", "bigint").orderBy("start").collect() == rows
    for r in manifest.collect():
        with ipc.open_file(f"{r['path']}.index.arrow") as index:
            assert index.read_all().num_rows == r["n_docs"]


def test_pipeline_takes_awkward_rows(spark, folder):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "some words here", None, "s", 3), (3, "some words here", "en", "s", 3), (3, "some words here", "en", "s", 3)]
    docs = spark.createDataFrame(rows, catalog.table(spark, folder, "documents").schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, folder).count()
