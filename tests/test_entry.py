import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDE = """
import sys, warnings
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
warnings.simplefilter("always")
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q) > 90, set(o) <= set(q), any(k.startswith("op") or k == "pipeline" for k in q))
"""


def run(*names: str) -> tuple[str, str]:
    done = subprocess.run([sys.executable, "-c", HIDE.format(names=set(names))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return done.stdout.strip(), done.stderr


def test_page_queries_stay_without_the_corpus_operators():
    for missing in ("pagelayout.llm", "pagelayout.llm.queries", "zstandard"):
        out, err = run(missing, "corpus_pipeline")
        assert out == "True True False", err
        if (ROOT / "pagelayout" / "llm").exists():
            assert "no corpus operators" in err
