"""Session files that arrive over time give the postings of one ingest run."""

import json
import os
import shutil
import tempfile

from hirelake.sources.ingest import ingest, read_sessions, session_files, session_folders
from hirelake.streaming.sessions import fold_batch, run_session_stream, session_file_stream

COLS = ["seq", "master_id", "id", "title", "session", "source_file", "shape"]


def _tree(base):
    """(path, text) in sorted order: job folders, an api array that replaces one, broken files, an array with text behind it."""
    files = []
    for s in ("a_session_1", "b_session_2"):
        for i in range(5):
            files.append((f"{s}/jobs/{i:03d}.json", "{broken" if i == 3 else json.dumps({"job": {"id": f"{s}{i}", "title": f"t{i}"}})))
    files.append(("c_session_3/api_response_all.json", json.dumps([{"id": f"c{i}", "slug": f"x{i}"} for i in range(4)])))
    files += [(f"c_session_3/jobs/{i:03d}.json", json.dumps({"id": f"never{i}"})) for i in range(2)]
    files.append(("d_session_4/api_response_all.json", '[{"id":"1"}] xyz'))
    files.append(("e_session_5/jobs/000.json", json.dumps({"job_id": "e", "data": {"title": {"value": "last", "confidence": 90}}})))
    return [(os.path.join(base, p), t) for p, t in files]


def _write(files):
    for path, text in files:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def _rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def test_split_arrival_equals_one_run(spark):
    whole, root, out = (tempfile.mkdtemp(prefix="hirelake-sessions-") for _ in range(3))
    _write(_tree(whole))
    rows, rejects = read_sessions(spark, whole)
    want = _rows(ingest(rows))
    assert len(want) == 8 + 4 + 1 and [w[0] for w in want] == list(range(1, 14))
    assert {(r["session"], r["source_file"]) for r in rejects.collect()} == {
        ("a_session_1", "003.json"), ("b_session_2", "003.json"), ("d_session_4", "api_response_all.json")}
    files, seen = _tree(root), []
    cuts = [0, 4, 11, 12, len(files)]
    for low, high in zip(cuts, cuts[1:]):   # the api array comes a batch before the job files that it replaces
        _write(files[low:high])
        got = run_session_stream(session_file_stream(spark, root), out, lambda df, i: seen.append((i, df.count())))
        assert _rows(got) == want[:got.count()]
    assert _rows(got) == want and [i for i, _ in seen] == [0, 1, 2, 3] and sum(n for _, n in seen) == 13
    # the last batch once more
    batch = spark.createDataFrame([("file:" + p, t) for p, t in files[12:]], "path string, value string")
    fold_batch(out)(batch, 3)
    assert _rows(spark.read.parquet(os.path.join(out, "postings"))) == want
    assert spark.read.parquet(os.path.join(out, "rejects")).count() == 3


def test_folders_without_files_are_listed(spark):
    root = tempfile.mkdtemp(prefix="hirelake-sessions-")
    _write(_tree(root))
    os.makedirs(os.path.join(root, "z_session_empty"))
    os.makedirs(os.path.join(root, "other"))
    assert {r["session"] for r in session_folders(spark, root).collect()} == {
        "a_session_1", "b_session_2", "c_session_3", "d_session_4", "e_session_5", "z_session_empty"}
    kinds = {r["session"]: r["structure_type"] for r in session_files(spark, root).collect()}
    assert kinds["z_session_empty"] == "unknown" and kinds["c_session_3"] == "api_response" and kinds["a_session_1"] == "jobs_directory"
    bare = tempfile.mkdtemp(prefix="hirelake-sessions-")
    os.makedirs(os.path.join(bare, "only_session"))
    assert [tuple(r) for r in session_files(spark, bare).collect()] == [("only_session", "unknown")]
    shutil.copytree(os.path.join(root, "e_session_5"), os.path.join(bare, "more_session"))
    assert len(session_files(spark, bare).collect()) == 2
