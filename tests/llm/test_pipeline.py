"""The pipeline: every stage against what its operator says, on its own input."""

import corpus_pipeline
from tessella.llm import linededup, mixing, neardup, quality
from tessella.llm import queries as llm

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
        if name != "tokens":
            assert after.columns == columns
        if name == "quality":
            kept = quality.quality_verdicts(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept")
            assert ids(after) == ids(kept)
        elif name == "line_dedup":
            out, n = linededup.dedup_lines(before)
            want = {r.doc_id: r[n["kept"]] if r[n["n_dropped"]] else r.text for r in out.collect() if not 0 < r[n["n_dropped"]] == r[n["n_lines"]]}
            assert {r.doc_id: r.text for r in after.collect()} == want
        elif name == "near_dedup":
            assert ids(after) == ids(neardup.near_duplicates(before).where("kept"))
        elif name == "mixing":
            want = {r.doc_id: sum(2 * c.taken >= r.size for c in r.copies) for r in mixing.mix(before).collect()}
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {k: v for k, v in want.items() if v}
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(llm.tokenizer_path())
            text = {r.doc_id: r.text for r in before.collect()}
            assert after.count() == before.count()
            assert all(r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in after.collect())
        before = after


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_tokens_keep_the_training_order(spark, tmp_path):
    """Over several files, of which the later ones are the larger: readers take those first."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (5 + i % 7)), "en", "ab"[i % 2], 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    due = {r.doc_id: sorted(c.position for c in r.copies if 2 * c.taken >= r.size) for r in mixing.mix(docs).collect()}
    rows = [tuple(r) for r in corpus_pipeline.mixing_stage(spark, docs, DATA).collect()]
    parts = [rows[:20], rows[20:60], rows[60:150], [(i, f"{t} {'more ' * 400}", *r) for i, t, *r in rows[150:]]]
    path = str(tmp_path / "mixing")
    table = spark.createDataFrame(spark.sparkContext.parallelize(parts, 4).flatMap(lambda p: p), docs.schema)
    table.write.option("maxRecordsPerFile", 70).parquet(path)
    out = corpus_pipeline.token_stage(spark, spark.read.parquet(path), DATA).select("doc_id", "position").collect()
    got = [r.doc_id for r in sorted(out, key=lambda r: r.position)]
    assert len({r.position for r in out}) == len(out) == sum(map(len, due.values())) and [r.doc_id for r in out] != got
    at = [due[i].pop(0) for i in got]
    assert at == sorted(at)
