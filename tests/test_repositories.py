"""Repositories by url: fetched by tasks, equal to the tree on disk."""

import json
import os
import subprocess

import pytest

from archspark.operators import multirepo
from archspark.sources import repositories as R
from archspark.sources.tree import read_tree

FILES = {
    "package.json": '{"name": "shop", "dependencies": {"react": "1"}}', "src/a.ts": "export class A {\n}\n", "src/b.ts": "import x from './a'\n", "node_modules/x.js": "x", ".hidden/y.py": "y", "img/p.png": "\x00\x01", "third/Makefile": "all:", "third/LICENSE": "free",
    **{f"third/{d}/x.c": "int a;" for d in "abcde"}, "big.py": "x = 1\n" * 200, "with space/ü.md": "# T", "empty.py": "",
}


def git(*args, cwd=None):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, cwd=cwd)


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """(work tree, url): a repository with a branch and a link."""
    base = tmp_path_factory.mktemp("git")
    work = base / "shop"
    for name, text in FILES.items():
        (work / name).parent.mkdir(parents=True, exist_ok=True)
        (work / name).write_bytes(text.encode())
    git("init", "-q", "--initial-branch=main", str(work))
    git("add", "-A", "-f", cwd=work)
    git("commit", "-q", "-m", "one", cwd=work)
    git("checkout", "-q", "-b", "side", cwd=work)
    (work / "only_side.py").write_text("z = 1\n")
    os.symlink("big.py", work / "link.py")
    git("add", "-A", cwd=work)
    git("commit", "-q", "-m", "two", cwd=work)
    git("checkout", "-q", "main", cwd=work)
    return work, f"file://{work}"


def rows(df):
    return sorted((r.repo, r.path, r.dir, r.name, r.is_dir, r.size, r.content, r.error) for r in df.collect() if r.dir != ".git")


def test_entries_are_those_of_a_checkout(spark, store):
    work, url = store
    assert rows(R.read_repositories(spark, [("shop", url, None)], 500)) == rows(read_tree(spark, {"shop": str(work)}, 500))
    config = R.read_repositories(spark, [("shop", url, None)]).where("path = '.git/config'").first()
    assert url in config.content.decode()


def test_branches_links_and_what_is_not_there(spark, store):
    _, url = store
    got = R.read_repositories(spark, [("a", url, "side"), ("b", url, "nothing"), ("c", "file:///nowhere/at/all", None), ("d", url, "HEAD")]).collect()
    by = {}
    for r in got:
        by.setdefault(r.repo, {})[r.path] = r
    assert by["a"]["only_side.py"].content == b"z = 1\n" and by["a"]["link.py"].error == "a symbolic link" and by["a"]["link.py"].content is None
    assert "only_side.py" not in by["d"] and by["d"]["src/a.ts"].content
    for name in "bc":
        assert list(by[name]) == [""] and "could not be cloned" in by[name][""].error
    with pytest.raises(ValueError):
        R.read_repositories(spark, [])


def test_a_task_leaves_nothing(spark, store, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "fresh_path", lambda *_: str(tmp_path / "fetched"))
    assert R.read_repositories(spark, [("a", store[1], None), ("b", "file:///nowhere", None)]).count() > 5
    assert os.listdir(tmp_path / "fetched") == []


def test_token_goes_by_the_environment(monkeypatch):
    monkeypatch.setenv("GITHUB_TOKEN", "secret")
    known, other = R.environment("https://github.com/a/b"), R.environment("https://elsewhere/a/b")
    assert "Basic" in known["GIT_CONFIG_VALUE_0"] and "secret" not in known["GIT_CONFIG_VALUE_0"] and "GIT_CONFIG_COUNT" not in other


def test_analysis_of_paths_and_urls(spark, store, tmp_path):
    work, url = store
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"solution": "S", "repositories": [{"name": "far", "url": url}, {"name": "near", "path": str(work)}]}))
    arch = multirepo.analyze_all(spark, str(config))
    files = {}
    for r in arch.files.select("path").collect():
        repo, _, path = r.path.partition("/")
        files.setdefault(repo, set()).add(path)
    assert files["far"] == files["near"] and "src/a.ts" in files["far"]
    comps = {r.id: (r.name, r.type) for r in arch.components.select("id", "name", "type").collect()}
    assert comps["far/root"] == comps["near/root"] == ("shop", comps["far/root"][1])
    config.write_text(json.dumps({"repositories": [{"name": "gone", "url": "file:///nowhere"}]}))
    with pytest.raises(ValueError, match="gone could not be cloned"):
        multirepo.analyze_all(spark, str(config))
