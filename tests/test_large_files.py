"""Large delimited files are split when the caller says that no value has a line break."""

import pytest

from tallyward.sources.files import load_file


@pytest.mark.parametrize(("suffix", "sep"), [("csv", ","), ("tsv", "\t")])
def test_load_file_splits(spark, folder, suffix, sep):
    path = f"{folder}/rows.{suffix}"
    with open(path, "w") as f:
        f.write(f"a{sep}b\n" + "".join(f"{i}{sep}{'x' * 200}\n" for i in range(50_000)))
    whole = load_file(spark, path, "whole", schema="a long, b string", mask=False).df
    split = load_file(spark, path, "split", schema="a long, b string", mask=False, multi_line=False).df
    assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
    assert sorted(r["a"] for r in split.select("a").collect()) == list(range(50_000)) and whole.count() == 50_000
