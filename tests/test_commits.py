"""Tables that several writers append to."""

import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from tablewright.sources import commits
from tablewright.sources.catalogue import Catalogue
from tablewright.sources.commits import CommitLog

WRITER = """
import sys
from tablewright.session import local_session
from tablewright.sources.catalogue import Catalogue
spark = local_session(2, "writer")
catalogue = Catalogue(spark, sys.argv[1])
print("ready", flush=True)
sys.stdin.readline()
for i in range(6):
    print("id", catalogue.log_experiment(1, sys.argv[2], {"i": i}), flush=True)
spark.stop()
"""


def test_two_processes_at_once(spark, tmp_path):
    folder = str(tmp_path / "registry")
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    catalogue = Catalogue(spark, folder)
    assert catalogue.register_dataset(str(tmp_path / "d.csv"), "d.csv", spark.createDataFrame([(1, 2)], "a int, b int")) == 1
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root, "SPARK_DRIVER_MEMORY": "1g"}
    writers = [
        subprocess.Popen([sys.executable, "-c", WRITER, folder, name], env=env, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        for name in ("one", "two")
    ]
    try:
        for w in writers:
            assert w.stdout.readline().strip() == "ready"
        for w in writers:  # both begin now
            w.stdin.write("go\n")
            w.stdin.flush()
        ids = [int(line.split()[1]) for w in writers for line in w.communicate(timeout=240)[0].splitlines() if line.startswith("id")]
    finally:
        for w in writers:
            w.kill()
    assert sorted(ids) == list(range(1, 13))
    rows = catalogue.table("experiments").select("id", "algorithm").collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 13))
    assert sorted(r["algorithm"] for r in rows) == ["one"] * 6 + ["two"] * 6


def test_threads_and_gathering(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "WHOLE", 4)
    folder, failed = str(tmp_path / "log"), []

    def write():
        try:
            log = CommitLog(spark, folder, "id bigint, who string")
            for _ in range(4):
                log.append(lambda t: t.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"), F.lit("x").alias("who")))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = CommitLog(spark, folder, "id bigint, who string")
    assert not failed and sorted(r["id"] for r in log.table().collect()) == list(range(1, 13))
    number, files = log.state()
    assert number > 12 and len(files) <= 4  # commits that list the whole table came between
    assert log.append(lambda t: t.limit(0))[1].isEmpty() and log.state()[0] == number


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), "id bigint")
    assert log._published(1, ["a"], False) and not log._published(1, ["b"], False)
    assert log.state() == (1, ["a"])
    monkey = CommitLog(spark, str(tmp_path / "other"), "id bigint")
    assert monkey.table().isEmpty() and monkey.state() == (0, [])


def test_an_error_commits_nothing(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), "id bigint")
    with pytest.raises(ValueError):
        log.append(lambda t: (_ for _ in ()).throw(ValueError("no")))
    assert log.state() == (0, [])
