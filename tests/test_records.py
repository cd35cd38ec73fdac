import csv
import io
import random

import pytest

from retenta.sources import files


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_quoted_line_breaks_in_split_files(spark, tmp_path, split):
    """One file in many splits gives the same rows as Python's reader over the whole text."""
    rng, rows = random.Random(5), [["id", "note", "more"]]
    pieces = ["a", "b c", "line\nbreak", "two\n\nbreaks", 'a "mark"', ";", ",", "", "é", '"\n"', "x" * 30]
    for i in range(400):
        rows.append([str(i), *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(2))])
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    (tmp_path / "in.csv").write_text(text.getvalue() + '400,5" pipe,plain\n401,after,it\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = spark.read.text(str(tmp_path / "in.csv"))
        assert (lines.rdd.getNumPartitions() > 20) == (split == 64)
        got = {r["record"]: r["text"] for r in files.records(spark, str(tmp_path / "in.csv"), ",").collect()}
        good, bad = files.read_delimited(spark, str(tmp_path / "in.csv"))
        table = sorted(tuple(v or "" for v in r) for r in good.collect())
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = rows + [["400", '5" pipe', "plain"], ["401", "after", "it"]]
    parsed = [next(csv.reader(io.StringIO(got[k]))) for k in sorted(got)]
    assert sorted(got) == list(range(1, 404)) and [p[0] for p in parsed] == [w[0] for w in want] and parsed[:401] == want[:401]
    assert table == sorted(tuple(x.lstrip() for x in w) for w in want[1:])
