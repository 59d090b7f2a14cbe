"""Report sinks and the streaming scan."""

import json
import os
import tempfile

import pytest

from ciphersift import ScanOptions, scan
from ciphersift.plans import report as R

FILES = {
    "a.go": 'package a\nimport "crypto/md5"\nvar _ = md5.New() // <x> & y\n',
    "b.txt": "rc4 here\n",
    "bin.dat": "a\u0000b",
}


def _result(spark, corpus):
    return scan(spark, corpus(FILES), ScanOptions(include_unknown=True, skip_binary=True))


def _document(fragments):
    rows = R.in_order(fragments).select("text").collect()
    return "".join(r.text for r in rows)


def test_json_report(spark, corpus):
    res = _result(spark, corpus)
    c = res.counts()
    doc = json.loads(_document(R.json_report_fragments(res.findings, c["scanned"], c["skipped"])))
    assert doc["tool"] == "ciphersift" and doc["files_scanned"] == 2 and doc["files_skipped"] == 1
    assert [f["rule_id"] for f in doc["findings"]] == ["weak-hash-md5", "scheme:rc4"]
    assert doc["findings"][0]["snippet"].endswith("<x> & y") and "errors" not in doc


def test_sarif_report(spark, corpus):
    res = _result(spark, corpus)
    doc = json.loads(_document(R.sarif_fragments(res.findings)))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["weak-hash-md5", "scheme:rc4"]
    assert run["tool"]["driver"]["rules"][1]["help"] == {"text": ""}
    levels = [r["level"] for r in run["results"]]
    assert levels == ["error", "error"]
    loc = run["results"][0]["locations"][0]["physicalLocation"]
    assert loc["artifactLocation"]["uri"] == "a.go" and loc["region"] == {"startLine": 3, "startColumn": 9}


def test_json_empty(spark, corpus):
    res = scan(spark, corpus({"n.go": "package n\n"}))
    doc = json.loads(_document(R.json_report_fragments(res.findings, 1, 0)))
    assert doc["findings"] == []


def test_text_report_and_summary(spark, corpus):
    res = _result(spark, corpus)
    lines = [r.text for r in R.text_report_lines(res.findings).orderBy(*R.ORDER, "k").collect()]
    assert lines[0] == "a.go:3:9 high [weak-hash-md5] Use of MD5 (high)"
    assert lines[1] == "    var _ = md5.New() // <x> & y"
    assert lines[2].startswith("    fix: ")
    assert R.summary_line(res.findings, res.file_status) == \
        "Scanned 2 files (1 skipped); 2 finding(s): high=2"
    assert R.has_findings(res.findings)


def test_catalog_listing(spark):
    rows = R.catalog_lines(spark).orderBy("ord").collect()
    assert len(rows) == 49
    assert rows[0].listing == "md2            broken   MD2"
    assert [r.listing for r in rows if r.rule_id == "scheme:cbc"] == ["cbc            contextual CBC mode"]


def test_stream_equals_batch(spark):
    from ciphersift.plans.queries import scan_documents_weak
    from ciphersift.streaming.stream import stream_scan_available_now
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    a = sorted(tuple(r) for r in stream_scan_available_now(spark, sf).collect())
    b = sorted(tuple(r) for r in scan_documents_weak(spark, sf).collect())
    assert a == b and len(a) > 0


@pytest.mark.parametrize("files", [None, 3])
def test_stream_reads_one_file_or_a_folder_of_files(spark, files):
    """A table is one Parquet file or a folder of part files; a neighbour with a like name is not read."""
    from ciphersift.plans.queries import scan_documents_weak
    from ciphersift.streaming.stream import stream_scan_available_now
    sf = tempfile.mkdtemp(prefix="cs-stream-")
    rows = [(i, f"line one\nuses md5 and rc4 {i}" if i % 2 else "nothing") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{sf}/old-documents.parquet")
    if files:
        docs.repartition(files).write.parquet(f"{sf}/documents.parquet")
    else:
        docs.coalesce(1).write.parquet(f"{sf}/made")
        part, = (f for f in os.listdir(f"{sf}/made") if f.startswith("part-"))
        os.link(f"{sf}/made/{part}", f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in stream_scan_available_now(spark, sf).collect())
    assert got == sorted(tuple(r) for r in scan_documents_weak(spark, sf).collect()) and len(got) == 12


def test_file_tree_source(spark):
    from ciphersift.sources.corpus import file_tree_corpus
    root = tempfile.mkdtemp(prefix="cs-tree-")
    for rel, text in {"src/a.go": FILES["a.go"], "vendor/v.go": FILES["a.go"], "big.c": "x" * 100}.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(text)
    c = file_tree_corpus(spark, root, max_file_bytes=80)
    res = scan(spark, c, ScanOptions(root="file:" + root, max_file_bytes=80))
    st = {r.path.rsplit("/", 1)[-1]: (r.status, r.reason) for r in res.file_status.collect()}
    assert st == {"a.go": ("scanned", None), "big.c": ("skipped", "too large")}
    assert [r.rule_id for r in res.findings.collect()] == ["weak-hash-md5"]


def test_file_tree_stream_is_incremental(spark):
    """A second availableNow run on the same checkpoint scans only the
    files that arrived since; each batch is written under its batch id."""
    from ciphersift.streaming.stream import file_tree_stream, start_scan_stream
    base = tempfile.mkdtemp(prefix="cs-stream-")
    root, out, ckpt = (os.path.join(base, d) for d in ("in", "out", "ckpt"))
    os.makedirs(root)

    def put(name, text):
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)

    def run():
        q = start_scan_stream(file_tree_stream(spark, root), out, ckpt, ScanOptions(include_unknown=True))
        q.awaitTermination()

    put("a.txt", "md5 one\n")
    run()
    put("b.txt", "rc4 two\n")
    run()
    rows = spark.read.parquet(out).select("batch_id", "rule_id").collect()
    assert sorted((r.batch_id, r.rule_id) for r in rows) == [(0, "scheme:md5"), (1, "scheme:rc4")]


def test_manifest_source_reads_hidden_files(spark):
    """S1 parity: hidden names are scanned, skip dirs still prune."""
    from ciphersift.sources.corpus import manifest_corpus
    root = tempfile.mkdtemp(prefix="cs-manifest-")
    files = {".hidden.go": FILES["a.go"], "_under.txt": "rc4\n", ".git/x.go": FILES["a.go"]}
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(text)
    paths = spark.createDataFrame([(os.path.join(root, r),) for r in files], "path string")
    res = scan(spark, manifest_corpus(paths), ScanOptions(root=root, include_unknown=True))
    got = sorted((r.file.rsplit("/", 1)[-1], r.rule_id) for r in res.findings.collect())
    assert got == [(".hidden.go", "weak-hash-md5"), ("_under.txt", "scheme:rc4")]


def test_render_formats(spark, corpus):
    import glob

    import pytest

    from ciphersift import render
    from ciphersift.plans.report import UnknownFormat
    res = _result(spark, corpus)
    base = tempfile.mkdtemp(prefix="cs-render-")

    def read(d):
        return "\n".join(open(f).read().rstrip("\n") for f in sorted(glob.glob(os.path.join(d, "part-*"))))
    render(res, "json", os.path.join(base, "j"))
    assert json.loads(read(os.path.join(base, "j")).replace("\n", ""))["files_scanned"] == 2
    render(res, "text", os.path.join(base, "t"))
    assert read(os.path.join(base, "t")).splitlines()[-1] == "Scanned 2 files (1 skipped); 2 finding(s): high=2"
    with pytest.raises(UnknownFormat):
        render(res, "xml", os.path.join(base, "x"))


def test_repeated_keys_make_valid_documents(spark, corpus):
    """A custom scheme named like a built-in one gives two findings with one report key."""
    cfg = {"custom_schemes": [{"id": "md5", "pattern": "md5", "title": "own"}]}
    res = scan(spark, corpus({"b.txt": "md5 here\nmd5\n"}), ScanOptions(include_unknown=True, config=cfg))
    assert res.findings.count() == 4
    doc = json.loads(_document(R.json_report_fragments(res.findings, 1, 0)))
    assert len(doc["findings"]) == 4
    sarif = json.loads(_document(R.sarif_fragments(res.findings)))
    assert len(sarif["runs"][0]["results"]) == 4
    lines = [r.text for r in R.text_report_lines(res.findings).orderBy(*R.ORDER, "k").collect()]
    assert [x.startswith("b.txt") for x in lines].count(True) == 4 and lines[0].startswith("b.txt")
    for a, b in zip(lines, lines[1:]):
        assert not (a.startswith("    fix:") and b.startswith("    fix:"))
