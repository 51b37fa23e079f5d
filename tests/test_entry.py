import subprocess
import sys

from .conftest import ROOT

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('quire.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)


def test_sql_is_for_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
