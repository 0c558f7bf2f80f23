"""The entry module with and without the text operators, and the suffix list inside a shipped zip file."""

import os
import shutil
import subprocess
import sys
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q)
print(len(q), len([k for k in q if k[:2] == "op" and k[2].isdigit()]), "pipeline" in q)
"""


def loaded(path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def copied(path, *left_out):
    for name in ("scanmart", "__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(source := os.path.join(ROOT, name)):
            if os.path.isdir(source):
                shutil.copytree(source, path / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
            else:
                shutil.copy(source, path / name)
    return path


def test_queries_load_without_the_text_operators(tmp_path):
    for i, left_out in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        (path := tmp_path / str(i)).mkdir()
        count, text, pipeline = loaded(copied(path, *left_out))
        assert int(count) >= 95 and text == "0" and pipeline == "False"


def test_an_error_inside_a_text_operator_is_not_hidden(tmp_path):
    copied(tmp_path)
    llm = tmp_path / "scanmart" / "llm"
    llm.mkdir(exist_ok=True)
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import no_such_module")
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr


def test_the_suffix_list_is_read_inside_a_zip_file(tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "scanmart")):
            for name in names:
                z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    code = "from scanmart.sources import suffixes as s; assert s.__file__.find('p.zip') > 0; print(len(s.rule_sets()['e']))"
    env = {k: v for k, v in os.environ.items() if k != "SCANMART_SUFFIX_LIST"} | {"PYTHONPATH": str(tmp_path / "p.zip")}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) > 6000
