import pytest

from casemesh.sources import tables as T


def test_commits_take_a_batch_once_and_never_show_half_a_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a INT, b STRING"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(tuple(r) for r in T.read_committed(spark, path, schema).collect())
    assert read() == []
    assert T.commit_append(make((1, "x")), path, "one")
    assert not T.commit_append(make((1, "x")), path, "one")  # the job is repeated
    assert T.commit_append(make((2, "y"), (3, None)), path, "two") and read() == [(1, "x"), (2, "y"), (3, None)]
    bad = make((4, "z")).selectExpr("a", "raise_error('lost') AS b")
    with pytest.raises(Exception, match="lost"):
        T.commit_replacement(bad, path, "three")
    assert read() == [(1, "x"), (2, "y"), (3, None)]
    assert T.commit_replacement(make((9, "r")), path, "three") and read() == [(9, "r")]
    assert T.commit_append(make((10, "s")), path, "four") and read() == [(9, "r"), (10, "s")]
    assert T.commit_replacement(make(), path, "five") and read() == []
