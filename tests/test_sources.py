import pytest
from brute import minimal_uccs

import solekey as sk
from solekey.plans.search import find

TOOLS = """
tool,kind,weight,length,price,shelf,box,handles,sharp,made of
hammer,hand,0.9,32,11.5,a,1,1,no,steel wood
saw,hand,0.7,55,14.0,a,2,1,yes,steel wood
drill,power,1.8,27,89.0,b,1,1,no,plastic
plane,hand,1.1,24,31.5,b,2,2,yes,steel
router,power,3.4,29,99.0,c,1,2,yes,plastic
"""


def test_carriage_returns_and_header_as_data(spark, tmp_path):
    path = tmp_path / "tools.csv"
    path.write_bytes(TOOLS.strip().replace("\n", "\r").encode())
    df = sk.read_delimited(spark, str(path))
    assert df.count() == 6 and df.columns == [f"c{i}" for i in range(10)]
    rows = [tuple(line.split(",")) for line in TOOLS.strip().splitlines()]
    assert {tuple(c) for c in find(df)[0]} == set(minimal_uccs(rows, 10))


def test_header(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(TOOLS.strip() + "\n" + "tool,kind,weight,length,price,shelf,box,handles,sharp,made of\n")
    df = sk.read_delimited(spark, str(tmp_path), header=True)
    assert df.count() == 12 and df.columns[0] == "tool" and df.where("tool = 'tool'").count() == 2


def test_every_line_is_a_row(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("a,b\n\n a,b,1\na,b,2\n,\n\n")
    rows = sorted(map(tuple, sk.read_delimited(spark, str(path)).collect()), key=repr)
    none = (None, None, None)
    assert rows == sorted([("a", "b", None), none, (" a", "b", "1"), ("a", "b", "2"), none, none], key=repr)
    with pytest.raises(ValueError, match="2 lines"):
        sk.read_delimited(spark, str(path), width=2)


def test_what_is_written_comes_back(spark, tmp_path):
    rows = [(" a", "1"), ("a ", None), ("a", "\t"), (None, None), ('"q"', "\\E")]
    df = spark.createDataFrame(rows, "`k``x` string, v string")
    for n, delimiter in enumerate(("|", ",", "\\E", "::")):
        out = str(tmp_path / str(n))
        if delimiter == "\\E":
            with pytest.raises(ValueError):
                sk.write_delimited(df, out, delimiter)
            continue
        sk.write_delimited(df, out, delimiter)
        assert sorted(map(tuple, sk.read_delimited(spark, out, delimiter).collect()), key=repr) == sorted(rows, key=repr)
    for value in ("", "x|y", "x\ny", "x\ry"):
        with pytest.raises(ValueError, match="1 rows"):
            sk.write_delimited(spark.createDataFrame([(value, 1)], "k string, v int"), str(tmp_path / "no"), "|")
        assert not (tmp_path / "no").exists()


def test_literal_delimiter_quotes_and_ragged_lines(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text('a|"b|c\nd|"e\n|f|g\n')
    df = sk.read_delimited(spark, str(path), delimiter="|", width=3)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(
        [("a", '"b', "c"), ("d", '"e', None), (None, "f", "g")], key=repr
    )


def test_integers(spark, tmp_path):
    path = tmp_path / "numbers"
    path.write_text("1004;47\n3;90;505\n;; 12 ;\n")
    df = sk.read_integers(spark, str(path))
    assert sorted(r.value for r in df.collect()) == [3, 12, 47, 90, 505, 1004]
    path.write_text("1004;47\n3;90;505\n")
    assert sk.exact_median(sk.read_integers(spark, str(path)), "value").first().value == 90


def test_write_and_read_back(spark, tmp_path):
    out = str(tmp_path / "out")
    sk.write_delimited(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a\t1", "b\t2"]
    assert sorted(map(tuple, sk.read_delimited(spark, out, delimiter="\t").collect())) == [("a", "1"), ("b", "2")]
