import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_llm_subpackage():
    code = (
        "import sys; sys.modules['quillwork.llm'] = None\n"
        "import __spark_entry__ as e; assert 'graph_related' in e.queries() and not [q for q in (*e.queries(), *e.oracle_sql()) if q[:1] == 'p' and q[1:2].isdigit()]\n"
        "assert not [m for m in sys.modules if m.startswith('quillwork.llm.')]"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
