"""A JSON bundle cut into many byte ranges gives the rows of the whole-file reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import normalize as N
from cadenza.sources.payloads import read_payload
from cadenza.sources.split_json import read_split_payload


def tracks(n, seed=1):
    rnd = random.Random(seed)
    odd = ['a "quoted" name', "brackets ]}[{ , inside", "back\\slash", 'ends with \\"', "comma, comma", "", "ünï, [x]"]
    out = []
    for i in range(n):
        t = {"id": str(i), "name": rnd.choice(odd), "artists": [{"id": f"a{k}", "name": rnd.choice(odd)} for k in range(rnd.randrange(3))], "album": {"id": "x", "name": rnd.choice(odd), "images": [{"url": "u,v"}]}, "popularity": 1.5, "external_urls": {"page": "p,[q"}}
        out.append(rnd.choice([t, t, t, None]) if i else t)
    return out


@pytest.mark.parametrize("size", [37, 200, 5000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_same_rows_as_the_whole_file(spark, tmp_path, size, indent):
    for k, body in enumerate([{"tracks": tracks(60)}, {"href": "a, {b", "total": 3, "tracks": tracks(7, 2), "next": None}, {"tracks": []}, {"tracks": [{"id": "one"}]}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(body, indent=indent))
    path = str(tmp_path / "*.json")
    want = N.track_metadata(read_payload(spark, path, "tracks"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = read_split_payload(spark, path, "tracks")
        got = N.track_metadata(read)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert read.count() == sum(len(json.loads(p.read_text())["tracks"]) for p in tmp_path.iterdir())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_a_large_bundle_is_read_by_many_tasks(spark, tmp_path):
    body = '{"audio_features": [' + ", ".join(f'{{"id": "t{i}", "danceability": {i % 7 / 7}, "duration_ms": {i}}}' for i in range(60_000)) + "]}"
    (tmp_path / "bundle.json").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
        got = N.audio_features(read_split_payload(spark, str(tmp_path / "bundle.json"), "audio_features"))
        assert got.agg(F.count("*"), F.countDistinct("track_id"), F.sum("duration_ms")).first()[:] == (60_000, 60_000, 60_000 * 59_999 // 2)
        assert got.rdd.getNumPartitions() >= 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_file_and_other_kinds(spark, tmp_path):
    assert read_split_payload(spark, str(tmp_path / "none.json"), "artists").count() == 0
    with pytest.raises(ValueError):
        read_split_payload(spark, str(tmp_path / "none.json"), "playlist")
