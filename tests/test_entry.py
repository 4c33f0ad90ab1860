"""The driver contract without the parts that may be removed."""

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

KEPT = ["__spark_entry__.py", "segmentry", "tests"]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_and_tests_load_without_the_removable_folders(tmp_path, pipeline):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    for name in [*KEPT, *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=ignore) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q; print('loaded')"
    run = [sys.executable, "-c", code]
    assert "loaded" in subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    collect = [sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"]
    found = subprocess.run(collect, cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout


def test_errors_inside_optional_modules_are_raised(tmp_path, monkeypatch):
    import __spark_entry__

    (tmp_path / "broken_module.py").write_text("import a_module_that_is_not_there")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("broken_module")
    assert __spark_entry__._optional("no_such_module") is None
