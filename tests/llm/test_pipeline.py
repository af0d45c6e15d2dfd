"""The stages of the pipeline against plain versions of each, and the import guard."""

import os
import subprocess
import sys
import textwrap

import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, classes, empty, shingles
from tests.llm.test_records import whole
from tidemark.llm import mixing, quality
from tidemark.llm.common import shared_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = shared_table(stage(spark, docs, SF), "test-stage")
        rows = out.collect()
        if name != "token records":
            assert out.columns == docs.columns and all(r == before[r.doc_id] for r in rows)
        if name == "quality rules":
            want = {r.doc_id for r in quality.measure(docs).collect() if r.kept}
            assert {r.doc_id for r in rows} == want
        elif name == "near duplicates":
            own = classes({d: shingles(r.text, 5) for d, r in before.items()}, 80)
            assert {r.doc_id for r in rows} == {d for d, c in own.items() if d == c}
        elif name == "benchmark containment":
            items = [s for s in (shingles(t, 5) for t in bench) if s]
            assert {r.doc_id for r in rows} == {d for d, r in before.items() if not any(100 * len(s & shingles(r.text, 5)) >= 80 * len(s) for s in items)}
        elif name == "source mix":
            copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
            count = {}
            for r in rows:
                count[r.doc_id] = count.get(r.doc_id, 0) + 1
            assert count == {d: c for d, c in copies.items() if c}
        else:
            texts = sorted((r.doc_id, r.text) for r in docs.collect())
            assert [(r.doc_id, r.n_tokens) for r in sorted(rows, key=lambda r: r.start)] == [(d, len(i)) for (d, _), i in zip(texts, whole(t for _, t in texts))]
        docs = out


def test_stages_take_awkward_and_empty_tables(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            docs = shared_table(stage(spark, docs, SF), "test-stage")
        assert docs.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_entry_without_the_text_part(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "tidemark"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for name in os.listdir(os.path.join(root, "tidemark")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "tidemark", name), tmp_path / "tidemark" / name)
    code = textwrap.dedent("""
        import sys; sys.path.insert(0, sys.argv[1]); sys.dont_write_bytecode = True
        source = open(sys.argv[1] + "/__spark_entry__.py").read()
        scope = {"__file__": sys.argv[1] + "/__spark_entry__.py", "__name__": "entry"}
        exec(compile(source, "entry", "exec"), scope)
        assert not [k for k in scope["queries"]() if k.startswith("op") or k == "pipeline"] and scope["oracle_sql"]()
    """)
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=tmp_path)
