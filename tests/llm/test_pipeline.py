"""The pipeline's stages on a small corpus with planted cases."""

import contextlib
import io
import random

import pytest
import public_tokenizers

from tests.llm.fixtures import WORDS, docs as odd_docs
from vergence.llm import bpe, registry
from vergence.llm.common import BATCH_ROWS

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [a + b for a in WORDS for b in WORDS]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    texts = {i: "\n".join(text(12) for _ in range(4)) for i in range(60)}
    texts[60], texts[61] = "123 456 ...", text(50) + " " + item
    repeated = text(60)
    texts[62], texts[63] = repeated + "\n" + text(40), repeated + "\n" + text(40)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
    assert set(kept["language_id"]) == set(texts) - {60}
    assert kept["line_dedup"][63]["text"] == texts[63].split("\n")[1] and kept["line_dedup"][63]["n_chars"] == len(kept["line_dedup"][63]["text"])
    assert set(kept["near_dedup"]) == set(texts) - {60}
    assert set(kept["decontamination"]) == set(texts) - {60, 61} == set(kept["byte_bpe"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["byte_bpe"])


def test_byte_bpe_keeps_one_worker_for_a_task(spark, tmp_path):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            corpus_pipeline.byte_bpe(spark, odd_docs(spark), str(tmp_path)).explain()
        above = said.getvalue().split("FlatMapCoGroupsInPandas")[0]
        assert "MapInArrow" not in above  # a second worker beside the one that puts documents together
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def test_decoded_where_put_together(spark):
    ranks, texts = registry._vocabulary("byte_bpe_multi_50k.tiktoken"), odd_docs(spark)
    key = lambda r: (str(r["doc_id"]), bytes(r["ids"]), bytes(r["bytes"]))
    apart = bpe.decode(bpe.encode(texts, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted(map(key, bpe.encode(texts, ranks, public_tokenizers.PATTERN, decoded=True).collect())) == sorted(map(key, apart))
