"""The directory walk: what it enters, what it reads, and what it reports."""

import os

import pytest

from ciphersift import ScanOptions, scan
from ciphersift.sources import tree
from ciphersift.sources.tree import tree_corpus

GO = 'package a\nimport "crypto/md5"\nvar _ = md5.New()\n'


def make(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def found(spark, root, width=None, exclude=None, **kw):
    r = scan(spark, tree_corpus(spark, root, exclude, width=width), ScanOptions(**kw))
    return sorted(f.file[len(root) + 1:] for f in r.findings.collect()), r


FILES = {"a.go": GO, "x/b.go": GO, "x/y/c.go": GO, "x/vendor/d.go": GO, ".hidden/e.go": GO, "x/_f.go": GO, ".g.go": GO,
         "build/h.go": GO, "x/y/z/i.txt": "md5", "x/y/empty.go": "", "out.go/j.go": GO}
KEPT = [".g.go", ".hidden/e.go", "a.go", "out.go/j.go", "x/_f.go", "x/b.go", "x/y/c.go"]


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_walk(spark, tmp_path, width, monkeypatch):
    monkeypatch.setattr(tree, "FILES_A_TASK", 1)
    root = str(tmp_path / "target" / "proj")  # what lies above the root prunes nothing
    make(root, FILES)
    os.symlink(f"{root}/a.go", f"{root}/link.go")
    os.symlink(f"{root}/x", f"{root}/linked")
    os.mkfifo(f"{root}/x/pipe.go")
    got, r = found(spark, root, width)
    assert got == KEPT
    assert r.counts() == {"scanned": 8, "skipped": 1, "error": 0}


def test_walk_by_file_path(spark, tmp_path):
    make(str(tmp_path / "p"), FILES)
    rows = tree_corpus(spark, f"file://{tmp_path}/p/").where("rel = 'x/b.go'").collect()
    assert [(r.path, r.content) for r in rows] == [(f"{tmp_path}/p/x/b.go", GO)]


@pytest.mark.parametrize("name", ["build", "vendor"])
def test_root_with_a_skipped_name(spark, tmp_path, name):
    make(str(tmp_path / name), FILES)
    got, r = found(spark, str(tmp_path / name))
    assert got == [] and r.counts() == {"scanned": 0, "skipped": 0, "error": 0}


def test_excluded_directories_are_not_listed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    make(root, FILES)
    os.chmod(f"{root}/x/y", 0)
    listed = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(p) or real(p))
    walk = tree.Walk(root, ["x/y/", "*.txt"], None)
    rows = list(walk.rows(tree.Deal("", whole=True)))
    os.chmod(f"{root}/x/y", 0o755)
    assert not any(p.endswith(("/y", "vendor", "build")) for p in listed)
    assert sorted(r[1] for r in rows) == [".g.go", ".hidden/e.go", "a.go", "out.go/j.go", "x/_f.go", "x/b.go"]


def test_errors_are_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    make(root, {"a.go": GO, "bad/b.go": GO, "c.go": GO})
    real = os.scandir

    def refuse(p):
        if str(p).endswith("/bad"):
            raise PermissionError(13, "Permission denied", p)
        return real(p)

    monkeypatch.setattr(os, "scandir", refuse)  # the test may run as a user whom no mode stops
    for reader in (tree.TreeReader({"path": root, "width": "1"}), tree.TreeReader({"path": root, "width": "50"})):
        rows = [r for d in reader.partitions() for r in reader.read(d)]
        assert sorted((r[1], r[4]) for r in rows) == [("a.go", None), ("bad", f"Permission denied: {root}/bad"), ("c.go", None)]
    os.remove(f"{root}/c.go")
    assert reader.walk.row("c.go")[2:] == (None, None, f"No such file or directory: {root}/c.go")
    got, r = found(spark, str(tmp_path / "none"))
    status = r.file_status.collect()
    assert got == [] and [(s.status, s.reason) for s in status] == [("error", f"No such file or directory: {tmp_path}/none")]


def test_large_files_are_not_read(spark, tmp_path):
    make(str(tmp_path / "p"), {"a.go": GO, "b.go": GO + "//" + "x" * 500})
    corpus = tree_corpus(spark, str(tmp_path / "p"), max_file_bytes=200)
    assert sorted((r.rel, r.content is None, r.length) for r in corpus.collect()) == [("a.go", False, len(GO)),
                                                                                     ("b.go", True, len(GO) + 502)]
    r = scan(spark, corpus, ScanOptions(max_file_bytes=200))
    assert sorted((s.status, s.reason) for s in r.file_status.collect()) == [("scanned", None), ("skipped", "too large")]
