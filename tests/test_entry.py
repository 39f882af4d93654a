import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from glyphmill.plans.oracles import ORACLE_SQL
from glyphmill.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
#: The whole image pipeline has no SQL form but on pages whose boxes are known (constant_pages); test_kernels covers it.
NO_SQL = {"page_pipeline"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE_SQL) == NO_SQL and set(ORACLE_SQL) <= set(QUERIES)


def test_nothing_outside_imports_llm():
    for f in (ROOT / "glyphmill").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "glyphmill.llm" not in f.read_text() and ".llm" not in f.read_text(), f


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_llm(tmp_path, with_pipeline):
    """The rest imports where the subpackage is deleted, with the pipeline's file or without."""
    import shutil

    if with_pipeline:
        if not (ROOT / "corpus_pipeline.py").exists():
            pytest.skip("deleted")
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.copytree(ROOT / "glyphmill", tmp_path / "glyphmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], out.stderr


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_flagship(spark):
    assert {r.reason: r.n for r in entry.entry(spark).collect()} == {"": 3790, "t1:degenerate": 240, "t1:frame": 187, "t1:hollow": 186, "t1:horizontal_rule": 297, "t1:oversized": 185, "t1:oversized_rule": 120, "t1:vertical_rule": 169, "t2:dense_region": 103, "t2:diacritic": 129, "t2:oversized_vs_median": 179, "t2:small_orphan": 415}


CHEAP = ["fill_holes", "label_map", "adaptive_gaussian", "illumination_normalise", "synth_plan", "capture_profiles", "constant_pages", "generation_tallies", "char_metrics", "word_metrics", "percent_format", "tier1_routing", "filter_stats", "bbox_scaled", "stage_medians", "char_outcomes", "word_coverage", "report_slices", "entity_to_line", "connected_components", "amount_in_words", "homography_boxes"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name", CHEAP)
def test_against_duckdb(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df, res = QUERIES[name](spark, d), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr) == sorted((tuple(map(tidy, r)) for r in res.fetchall()), key=repr)
