import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 125  # five for each of 25 ids divisible by 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["vector_scoped", "noise_classify", "lexical_overlap_topk", "context_char_budget", "version_conflicts", "json_blocks", "groundedness", "html_blocks", "markdown_blocks", "recursive_chunks", "structural_chunks", "heuristic_rewrite", "adaptive_select", "hashing_embed", "fulltext_matches", "claims_split"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "events", "orders", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    places = [[c[0] for c in want.description].index(c) for c in columns]
    key = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert key([r[c] for c in columns] for r in got.collect()) == key([r[i] for i in places] for r in want.fetchall())


def test_works_without_the_language_model_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q) and 'vector_cosine_topk' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_them():
    for path in (REPO / "tessella").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessella.llm" not in path.read_text(), path
