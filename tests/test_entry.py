import subprocess
import sys


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200
    assert e.entry(spark).count() > 0


def without(missing):
    code = ("import sys\n"
            f"sys.modules.update(dict.fromkeys({missing!r}))\n"  # importing a name that is None raises ImportError
            "import __spark_entry__ as e\n"
            "assert not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())\n"
            "assert len(e.queries()) > 200 and e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry_without_corpus_operators():
    without(["tidewright.llm", "corpus_pipeline"])


def test_entry_without_what_they_import():
    without(["regex"])
