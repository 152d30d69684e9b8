import pytest

from fenestra.sources.readers import counter_rows


def written(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return f"file://{tmp_path}/{name}"


def test_csv(spark, tmp_path):
    path = written(tmp_path, "a.csv", ["ktype, eurocode ,hit_count", "12, ab1 ,3", "12,AB1,7", "", "0,AB1,4", "x,AB1,4", "13,,4", "14,cd,", "15x,ef,2y", "16,gh"])
    assert sorted(map(tuple, counter_rows(spark, path, "csv").collect())) == [(12, "AB1", 7), (14, "CD", 1), (15, "EF", 2), (16, "GH", 1)]


def test_ndjson_and_seed(spark, tmp_path):
    lines = ['{"ktype": 12, "eurocode": " ab1", "hit_count": 3}', '{"ktype": "12", "eurocode": "AB1", "hit_count": "9"}', "{broken", '{"ktype": 13, "eurocode": "undefined"}', '{"ktype": 14, "eurocode": null}', '{"eurocode": "zz"}', '{"ktype": 15, "eurocode": "q", "hit_count": 0}']
    path = written(tmp_path, "a.ndjson", lines)
    assert sorted(map(tuple, counter_rows(spark, path, "ndjson").collect())) == [(12, "AB1", 9), (15, "Q", 1)]
    assert counter_rows(spark, path, "seed").collect() == []
    with pytest.raises(ValueError, match="no such form"):
        counter_rows(spark, path, "xml")
