"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate shape)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.harness import compare, duck

QUERIES = {k: q for k, q in E.queries().items() if k not in E.LLM_QUERIES}
ORACLE = {k: q for k, q in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    problems, n, _, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 1


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["srmse_avg", "jsd_pairwise_avg", "jsd_full_joint"]
    assert df.count() == 1


def test_comparison_table_is_the_methods_rows(spark):
    rows = {r.method: r for r in QUERIES["comparison_table"](spark, SF_SMALL).collect()}
    text = QUERIES["method_text"](spark, SF_SMALL).first()
    assert list(rows) == ["IPF", "Conditional", "Text"]
    assert rows["Text"].srmse_avg == text.srmse_avg and rows["Text"].jsd_full_joint_ipf == text.jsd_full_joint_ipf


def test_queries_without_the_llm_folders():
    """The entry imports and lists all other queries when those folders are gone."""
    import os
    import subprocess
    import sys

    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'popweave.llm') or name.startswith('popweave.llm.'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as E\n"
            "names = E.queries()\n"
            "assert 'cell_counts' in names and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names)\n"
            "assert set(E.oracle_sql()) <= set(names)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
