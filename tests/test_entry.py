"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 20 and df.columns == ["source", "site", "windows", "mass7"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=60)


def test_nothing_else_imports_llm():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tidemark").parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_sources_and_sinks(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from tidemark.sources import readers, sinks

    (tmp_path / "e.json").write_text('{"source":"s","event_id":"1","secs":5}\n{"source":"s","event_id":"2","extra":1}\nnot json\n')
    assert [r.event_id for r in readers.events(spark, str(tmp_path / "e.json")).collect()] == ["1"]
    (tmp_path / "set").mkdir()
    (tmp_path / "set/corpus.jsonl").write_text('{"doc_id":"d","title":"t","site_key":"s"}\n')
    (tmp_path / "set/queries.jsonl").write_text('{"query_id":"q","text":"t"}\n')
    (tmp_path / "set/qrels.jsonl").write_text('{"query_id":"q","doc_id":"d","relevance":2}\n')
    assert readers.judged_set(spark, str(tmp_path / "set"))["qrels"].count() == 1
    (tmp_path / "set/qrels.jsonl").write_text("")
    with pytest.raises(ValueError, match="matrix"):
        readers.judged_set(spark, str(tmp_path / "set"))
    rows = spark.createDataFrame([("r1", '["a"]', 3), ("r2", None, 5)], "request_id string, ids string, n int").withColumn("time", F.timestamp_seconds("n"))
    sinks.append(rows, str(tmp_path / "receipts"))
    assert [(r.request_id, r.ids) for r in sinks.newest_receipts(spark.read.parquet(str(tmp_path / "receipts"))).collect()] == [("r2", []), ("r1", ["a"])]
    with pytest.raises(PermissionError):
        sinks.export({"x": rows}, False, str(tmp_path / "out"))
    sinks.export({"x": rows}, True, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/x")).count() == 2
