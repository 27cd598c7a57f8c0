import pytest

from meshwork.operators.matrix import SparseMatrix
from meshwork.sources import mtx

BANNER = "%%MatrixMarket matrix coordinate "


def read(spark, tmp_path, text, **how):
    path = str(tmp_path / "m.mtx")
    with open(path, "w", newline="") as f:
        f.write(text)
    m = mtx.read(spark, path, **how)
    return m, sorted(tuple(r) for r in m.df.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (BANNER + "real general\n% a comment\n3 3 4\n1 1 2.5\n1 3 -1\n3 2 4e1\n3 2 1\n", [(0, 0, 2.5), (0, 2, -1), (2, 1, 1), (2, 1, 40)]),
        (BANNER + "real symmetric\n2 2 2\n1 1 5\n2 1 7\n", [(0, 0, 5), (0, 1, 7), (1, 0, 7)]),
        (BANNER + "real skew-symmetric\n2 2 1\n2 1 7\n", [(0, 1, -7), (1, 0, 7)]),
        (BANNER + "pattern general\n2 2 2\n1 2\n2 2\n", [(0, 1, 1), (1, 1, 1)]),
        (BANNER + "pattern symmetric\n2 2 1\n2 1\n", [(0, 1, 1), (1, 0, 1)]),
        (BANNER + "integer general\n2 2 1\n1 2 3\n", [(0, 1, 3)]),
        ("%%MatrixMarket MATRIX Coordinate REAL General\n2 2 1\n1 2 3\n", [(0, 1, 3)]),
        (BANNER + "real general\n\n2 2 2\n1 2 3\n% inside\n\n 2  1\t4", [(0, 1, 3), (1, 0, 4)]),
        (BANNER + "real general\r\n2 2 1\r\n1 2 3\r\n", [(0, 1, 3)]),
        (BANNER + "real general\n2 2 1\n1 2\n", [(0, 1, 1)]),
        (BANNER + "real general\n2 2 2\n2 2 2\n2 2 2\n", [(1, 1, 2), (1, 1, 2)]),
    ],
)
def test_read(spark, tmp_path, text, want):
    assert read(spark, tmp_path, text)[1] == want


def test_unexpanded(spark, tmp_path):
    assert read(spark, tmp_path, BANNER + "real symmetric\n2 2 1\n2 1 7\n", expand=False)[1] == [(1, 0, 7)]


@pytest.mark.parametrize(
    ("text", "error", "code"),
    [
        (BANNER + "complex general\n1 1 1\n1 1 1 2\n", mtx.Unsupported, 15),
        ("%%MatrixMarket matrix array real general\n1 1\n1\n", mtx.Unsupported, 15),
        (BANNER + "complex hermitian\n1 1 0\n", mtx.Unsupported, 15),
        (BANNER + "real hermitian\n1 1 0\n", mtx.Unsupported, 15),
        ("%%MatrixMarkt matrix coordinate real general\n1 1 0\n", mtx.NoHeader, 14),
        ("%%MatrixMarket vector coordinate real general\n1 1 0\n", mtx.NotMatrix, 13),
        ("", mtx.PrematureEnd, 12),
        ("%%MatrixMarket matrix\n", mtx.PrematureEnd, 12),
        (BANNER + "real general\n% only a comment\n", mtx.PrematureEnd, 12),
        (BANNER + "real general\n3 3\n", mtx.PrematureEnd, 12),
    ],
)
def test_errors(spark, tmp_path, text, error, code):
    with pytest.raises(error) as e:
        read(spark, tmp_path, text)
    assert e.value.code == code


def test_complex(spark, tmp_path):
    path = tmp_path / "c.mtx"
    path.write_text(BANNER + "complex general\n2 2 1\n1 2 3 -4\n")
    r = mtx.read_complex(spark, str(path)).first()
    assert (r["i"], r["j"], r["v"]["re"], r["v"]["im"]) == (0, 1, 3, -4)


def test_write_and_read_in_splits(spark, tmp_path):
    df = spark.range(2000).selectExpr("id % 50 AS i", "(id * 7) % 40 AS j", "id / 8 - 3 AS v")
    m = SparseMatrix(df.repartition(3), 50, 40)
    out = str(tmp_path / "out")
    mtx.write(m, out)
    lines = [x for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines[:2] == [BANNER + "real general", "50 40 2000"]
    path = tmp_path / "one.mtx"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = mtx.read(spark, str(path))
        assert got.df.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, got.df.collect())) == sorted(map(tuple, df.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (got.nrows, got.ncols) == (50, 40)
    # the folder as it is written
    got = mtx.read(spark, out)
    assert sorted(map(tuple, got.df.collect())) == sorted(map(tuple, df.collect())) and (got.nrows, got.ncols) == (50, 40)


def test_many_comments(spark, tmp_path):
    text = BANNER + "real general\n" + "% more\n" * 5000 + "2 2 1\n1 2 3\n"
    assert read(spark, tmp_path, text)[1] == [(0, 1, 3)]
