"""The pipeline: what each stage keeps, against its operator, and what comes out."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_kneser_ney import ModelSettings
from test_line_dedup import brute as dedup_brute
from test_ngram_join import brute as join_brute
from test_quality_rules import brute as rules_brute
from tickloom.llm.kneser_ney import score_documents
from tickloom.llm.quality_rules import RuleLimits

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name.replace(" ", "-"))
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_each_stage_takes_effect(spark, stages):
    docs, ruled, fluent, lined, single, packed = stages
    assert ruled.columns == fluent.columns == lined.columns == single.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    verdicts = rules_brute([(r.doc_id, r.source, r.text) for r in rows.values()], RuleLimits())
    assert sorted(r.doc_id for r in ruled.collect()) == sorted(v[0] for v in verdicts if v[-2])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in score_documents(ruled, labels, ModelSettings()).collect() if r.kept}
    assert {r.doc_id for r in fluent.collect()} == kept
    want = dedup_brute([(r.doc_id, r.text) for r in fluent.collect()])
    assert sorted((r.doc_id, r.text) for r in lined.collect()) == sorted((w[0], w[3]) for w in want)
    want = join_brute([(r.doc_id, r.text) for r in lined.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, c in want if i == c)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for r in single.collect():
        ids = [i for _, part in sorted(pieces.pop(r.doc_id)) for i in part]
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
    assert not pieces


def test_clean_documents_stay(spark, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    for before, after, least in ((0, 1, 0.7), (1, 2, 0.97)):
        entered = {r.doc_id for r in stages[before].collect()} & good
        assert len(entered & {r.doc_id for r in stages[after].collect()}) >= least * len(entered)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
