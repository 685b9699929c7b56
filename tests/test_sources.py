import hashlib

import pytest

from tablewright.operators.metrics import evaluate_predictions
from tablewright.sources.fingerprint import dataset_hash, file_hashes
from tablewright.sources.tables import column_types, read_csv, require_rows, write_table
from tablewright.functions.columns import trim_names


def _csv(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = _csv(
        tmp_path,
        " n ,x,flag,word,day,odd,none,big\n"
        "1,1.5,true,NA,2024-01-01,1d,,99999999999999999999\n"
        "NULL,1e3,False,b,2024-01-02,2,N/A,1\n"
        "3,-inf,,\"c,\"\"d\"\"\",,3,nan,2\n",
    )
    df = read_csv(spark, path)
    assert dict(column_types(df)) == {
        "n": "long", "x": "double", "flag": "boolean", "word": "string", "day": "string", "odd": "string",
        "none": "double", "big": "double",
    }
    rows = df.collect()
    assert [r["n"] for r in rows] == [1, None, 3]
    assert [r["flag"] for r in rows] == [True, False, None]
    assert [r["word"] for r in rows] == [None, "b", 'c,"d"']
    assert rows[2]["x"] == float("-inf") and rows[1]["x"] == 1000.0


def test_latin1_fallback(spark, tmp_path):
    path = _csv(tmp_path, "name,v\ncafé,1\n", "latin-1")
    assert read_csv(spark, path).first()["name"] == "café"


def test_quoted_line_breaks(spark, tmp_path):
    path = _csv(tmp_path, 'a,b\n"x\ny",1\n')
    assert read_csv(spark, path, multi_line=True).collect() == [("x\ny", 1)]


def test_short_and_long_rows(spark, tmp_path):
    assert read_csv(spark, _csv(tmp_path, "\ufeffa,b\n1\n2,3\n")).collect() == [(1, None), (2, 3)]
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, _csv(tmp_path, "a,b\n1,2\n3,4,5\n"))


def test_names_repeating_after_trimming(spark):
    with pytest.raises(ValueError, match="repeat"):
        trim_names(spark.createDataFrame([(1, 2)], ["a", " a "]))


def test_empty_table(spark):
    with pytest.raises(ValueError):
        require_rows(spark.createDataFrame([], "a int"))


def test_fingerprint(spark, tmp_path):
    one = tmp_path / "one.bin"
    one.write_bytes(b"hello")
    assert dataset_hash(file_hashes(spark, str(one))) == hashlib.sha256(b"hello").hexdigest()
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.bin").write_bytes(bytes([i]))
    first = dataset_hash(file_hashes(spark, str(folder)))
    (folder / "4.bin").write_bytes(b"changed")
    assert dataset_hash(file_hashes(spark, str(folder))) != first


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, None, 1.5)], "i long, s string, x double")
    write_table(df, str(tmp_path / "out"), "csv")
    assert sorted(read_csv(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_regression_without_pairs_has_no_row(spark):
    df = spark.createDataFrame([("a", 1.0)], "y string, p double")
    assert evaluate_predictions(df, "y", "p", "regression").count() == 0


def test_line_breaks_in_quotes_are_found(spark, tmp_path):
    path = _csv(tmp_path, 'k,t,n\n1,"two\nlines",5\n2,plain,6\n')
    assert sorted(read_csv(spark, path).collect()) == [(1, "two\nlines", 5), (2, "plain", 6)]


def test_replacement_character_in_utf8(spark, tmp_path):
    path = _csv(tmp_path, "né,b\ncafé \ufffd,1\n")
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("café \ufffd", 1)]
    assert read_csv(spark, path).columns == ["né", "b"]


def test_large_files_are_hashed_in_chunks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 100)
    (tmp_path / "b.bin").write_bytes(b"x")
    ways = [{(r["length"], r["content_hash"]) for r in file_hashes(spark, str(tmp_path), n).collect()} for n in (10, 1 << 20)]
    assert ways[0] == ways[1] and len(ways[0]) == 2
