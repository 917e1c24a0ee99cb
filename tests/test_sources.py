import json

import pytest

from cadenza.operators import normalize as N
from cadenza.operators.interactions import coverage_stats, listens_to_interactions, matrix_stats, aggregate_strengths, merge_interactions
from cadenza.operators.catalog import build_catalog
from cadenza.sources import listens as L
from cadenza.sources.bundles import curate_bundle
from cadenza.sources.payloads import playlist_artist_ids, playlist_track_ids, read_payload
from cadenza.sources.tables import load_item_model, read_newest_run, save_evaluation, save_item_model, write_run, write_table

LOG = [
    "user_1\t2009-05-04T23:08:57Z\ta1\tArtist One\tr1\tSong Alpha",
    "user_1\t2009-05-05T00:08:57Z\ta1\t  artist one \tr1\tsong   alpha",
    "user_1\t2009-05-05T01:08:57Z\ta2\tArtist Two\tr2\tSong Beta",
    "user_2\tnot a time\ta1\tArtist One\tr1\tSong \"Alpha",
    "user_2\t2009-05-05T01:08:57Z\ta1\t \tr1\tSong Alpha",
    "broken line",
]


def test_headerless_log(spark, tmp_path):
    path = tmp_path / "log.tsv"
    path.write_text("\n\n" + "\n".join(LOG) + "\n")
    assert L.is_headerless_log(spark, str(path))
    rows = listens_to_interactions(L.read_listens(spark, str(path))).collect()
    assert len(rows) == 3
    alpha = next(r for r in rows if r["user_id"] == "user_1" and r["listen_count"] == 2)
    assert alpha["track_name"] == "Song Alpha" and alpha["interaction_strength"] == 2.0
    assert str(alpha["first_timestamp"]) == "2009-05-04 23:08:57" and str(alpha["last_timestamp"]) == "2009-05-05 00:08:57"
    assert alpha["track_id"].startswith("track_") and len(alpha["track_id"]) == 22
    other = next(r for r in rows if r["user_id"] == "user_2")
    assert other["first_timestamp"] is None and other["track_id"] == alpha["track_id"]


def test_chunked_equals_whole(spark, tmp_path):
    path = tmp_path / "log.tsv"
    path.write_text("\n".join(LOG))
    rows = L.read_listens(spark, str(path))
    parts = [listens_to_interactions(rows.where(c)) for c in ("track_name = 'Song Alpha'", "track_name <> 'Song Alpha'")]
    columns = ["user_id", "track_id", "listen_count", "first_timestamp", "last_timestamp", "track_name"]
    assert sorted(map(tuple, merge_interactions(*parts).select(*columns).collect()), key=str) == sorted(
        map(tuple, listens_to_interactions(rows).select(*columns).collect()), key=str)


def test_headered_log_and_column_roles(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("User;Artist;Song;played_at\nu1;A;Song One;2020-01-01T00:00:00Z\nu1;A;Song One;2020-01-02T00:00:00Z\nu2;B;Two;\n")
    assert not L.is_headerless_log(spark, str(path))
    rows = listens_to_interactions(L.read_listens(spark, str(path))).collect()
    assert {(r["user_id"], r["track_name"], r["listen_count"]) for r in rows} == {("u1", "Song One", 2), ("u2", "Two", 1)}
    with pytest.raises(ValueError, match="artist"):
        L.infer_columns(["user", "track"])


def _track(i, **kw):
    base = {"id": i, "name": f" Track {i} ", "artists": [{"id": "B", "name": "Zed"}, {"id": "A", "name": "Abe"}],
            "album": {"id": "al", "name": "Album", "release_date": "2001-02-03", "total_tracks": 9, "images": [{"url": "big"}, {"url": "small"}]},
            "duration_ms": 1000, "explicit": True, "popularity": 40, "external_urls": {"page": "http://x"}}
    return {**base, **kw}


def test_payloads_to_curated_tables(spark, tmp_path):
    files = {
        "tracks": {"tracks": [_track("1"), None, _track("2", album=None, popularity=None)]},
        "audio_features": {"audio_features": [{"id": "1", "danceability": 0.5, "tempo": 100.0, "duration_ms": 5}, None]},
        "artists": {"artists": [{"id": "B", "name": "Zed", "genres": ["Indie  Pop", "rock"], "followers": {"total": 7}, "popularity": 50}]},
        "playlist": {"playlist_id": "p", "items": [{"added_at": "t", "track": _track("1")}, {"added_at": "t", "track": None}, {"track": _track("1")}]},
    }
    read = {}
    for kind, body in files.items():
        path = tmp_path / f"{kind}.json"
        path.write_text(json.dumps(body, indent=1))
        read[kind] = read_payload(spark, str(path), kind)
    assert read_payload(spark, str(tmp_path / "missing.json"), "tracks").count() == 0
    meta, audio = N.track_metadata(read["tracks"]), N.audio_features(read["audio_features"])
    artists, playlist = N.artist_metadata(read["artists"]), N.playlist_tracks(read["playlist"])
    first = {r["track_id"]: r for r in meta.collect()}
    assert first["1"]["name"] == "Track 1" and first["1"]["artist_ids"] == "a, b" and first["1"]["artist_names"] == "Abe, Zed"
    assert first["1"]["album_image_url"] == "big" and first["2"]["album_image_url"] == "" and first["2"]["popularity"] == 0.0
    assert playlist.count() == 3 and playlist.where("track_id = ''").count() == 1
    level = {r["track_id"]: r for r in N.track_level(meta, audio, playlist, artists).collect()}
    assert level["1"]["primary_artist_id"] == "B" and level["1"]["danceability"] == 0.5 and level["1"]["duration_ms"] == 1000
    assert level["1"]["playlist_occurrences"] == 2 and level["2"]["playlist_occurrences"] == 0
    assert level["1"]["artist_genres"] == "indie pop, rock" and level["1"]["artist_followers_total"] == 7
    artist = N.artist_level(artists, N.track_level(meta, audio, playlist, artists)).collect()
    assert len(artist) == 1 and artist[0]["track_count"] == 2 and artist[0]["avg_danceability"] == 0.25
    assert [(r["track_id"], r["pos"]) for r in playlist_track_ids(read["playlist"]).collect()] == [("1", 0)]
    ids = sorted(playlist_artist_ids(read["playlist"]).collect(), key=lambda r: (r["pos"], r["artist_pos"]))
    assert [r["artist_id"] for r in ids] == ["B", "A"]


def test_audio_only_base_and_missing_ratio(spark):
    audio = spark.createDataFrame([("1", 0.4), ("2", None)], "track_id string, danceability double")
    assert N.track_level(None, audio).count() == 2
    assert {r["column_name"]: r["missing_ratio"] for r in N.missing_ratio(audio).collect()} == {"track_id": 0.0, "danceability": 0.5}
    with pytest.raises(ValueError):
        N.track_level(None)


def test_interaction_stats(spark):
    rows = spark.createDataFrame([("u1", "t1", "2"), ("u1", "t1", "1"), ("u1", "t2", "1"), ("u2", "t2", "3"), ("u2", "t3", "x"), (" ", "t3", "9")],
                                 "user_id string, track_id string, interaction_strength string")
    sums = aggregate_strengths(rows)
    assert {(r[0], r[1]): r[2] for r in sums.collect()} == {("u1", "t1"): 3.0, ("u1", "t2"): 1.0, ("u2", "t2"): 3.0, ("u2", "t3"): 0.0}
    s = matrix_stats(sums).first()
    assert (s["users"], s["tracks"], s["interactions"]) == (2, 3, 4) and s["density"] == pytest.approx(4 / 6)


def test_coverage_stats(spark):
    i = spark.createDataFrame([("u1", "t1"), ("u1", "t2"), ("u2", "t1"), ("u2", "t3"), ("u3", "t3")], "user_id string, track_id string")
    c = spark.createDataFrame([(f"t{n}",) for n in range(1, 5)], "track_id string")
    r = coverage_stats(i, c, min_user_interactions=2).first()
    assert (r["interaction_count"], r["user_count"], r["unique_tracks_in_interactions"], r["unique_tracks_in_catalog"]) == (5, 3, 3, 4)
    assert r["average_interactions_per_user"] == pytest.approx(5 / 3) and r["median_interactions_per_user"] == 2.0
    assert r["tracks_with_more_than_one_listener_pct"] == pytest.approx(200 / 3) and r["possible_interactions"] == 9
    assert r["matrix_density"] == pytest.approx(5 / 9) and r["evaluated_users"] == 2
    assert r["average_train_interactions_per_evaluated_user"] == 1.0
    empty = coverage_stats(i.where("false"), c).first()
    assert empty["interaction_count"] == 0 and empty["matrix_sparsity"] == 1.0 and empty["median_users_per_track"] == 0.0


def test_catalog_with_nulls(spark):
    i = spark.createDataFrame([("u", "t1", None, None, 2.0), ("u", "t2", "The Band!", "Two Words", 4.0)],
                              "user_id string, track_id string, artist_name string, track_name string, interaction_strength double")
    rows = {r["track_id"]: r for r in build_catalog(i).collect()}
    assert rows["t1"]["track_name"] == "" and rows["t1"]["title_token_count"] == 0 and rows["t1"]["artist_genres"] == "artist_unknown"
    assert rows["t2"]["artist_genres"] == "artist_the_band" and rows["t2"]["popularity"] == 100.0 and rows["t1"]["catalog_popularity"] == 0.5


def test_run_tables_and_model_files(spark, tmp_path):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,)], "x int")
    write_run(a, str(tmp_path / "r"), "20240101")
    write_run(b, str(tmp_path / "r"), "20240201")
    assert [r["x"] for r in read_newest_run(spark, str(tmp_path / "r")).collect()] == [2]
    save_evaluation(a, b, str(tmp_path / "e"), "1")
    assert read_newest_run(spark, str(tmp_path / "e/coverage")).first()["x"] == 2
    save_item_model(a, b, str(tmp_path / "m"))
    near, inter = load_item_model(spark, str(tmp_path / "m"))
    assert near.first()["x"] == 1 and inter.first()["x"] == 2
    write_table(a, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["x"] == "1"


def test_bundle_of_files_to_six_tables(spark, tmp_path):
    files = {
        "tracks": {"tracks": [_track("1"), _track("2")]}, "audio_features": {"audio_features": [{"id": "1", "danceability": 0.5}]},
        "artists": {"artists": [{"id": "B", "name": "Zed", "genres": ["rock"]}]},
        "playlist": {"playlist_id": "p", "items": [{"track": _track("1")}, {"track": _track("1")}]},
    }
    for kind, body in files.items():
        (tmp_path / f"{kind}.json").write_text(json.dumps(body))
    paths = {kind: str(tmp_path / f"{kind}.json") for kind in files}
    out = curate_bundle(spark, paths, str(tmp_path / "out"), "20240101")
    assert set(out) == {"track_metadata", "audio_features", "artist_metadata", "playlist_tracks", "track_level", "artist_level"}
    assert {r["track_id"]: r["playlist_occurrences"] for r in out["track_level"].collect()} == {"1": 2, "2": 0}
    assert out["artist_level"].first()["track_count"] == 2
    # A later run without metadata takes the audio features as base; both runs stay on disk.
    later = curate_bundle(spark, {**paths, "tracks": str(tmp_path / "none.json"), "artists": None}, str(tmp_path / "out"), "20240201")
    assert [r["track_id"] for r in later["track_level"].collect()] == ["1"] and later["artist_metadata"].count() == 0
    assert {p.name for p in (tmp_path / "out/track_level").iterdir() if p.is_dir()} == {"run_ts=20240101", "run_ts=20240201"}
    with pytest.raises(ValueError):
        curate_bundle(spark, {"songs": "x"}, str(tmp_path / "out"), "1")
