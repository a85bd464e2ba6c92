import zlib

from helpers import awkward, awkward_rows, empty

from tillroll.llm import sharding


def test_places_sizes_and_checksums(spark):
    got = sharding.assign(awkward(spark), 4).collect()
    expected = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32(r[1].encode()) if r[1] is not None else None) for r in awkward_rows())
    assert sorted(((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r["vslot"], r["shard"]) == r["shard"]


def test_near_equal_bytes(spark):
    rows = [(i, "x" * (50 + i * 37 % 900)) for i in range(4000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 16).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16


def test_rebalancing_moves_little_and_versions_stay(spark, tmp_path):
    store = str(tmp_path / "map")
    first = [(i, "x" * (i % 300)) for i in range(3000)]
    sharding.assign(spark.createDataFrame(first, "doc_id bigint, text string"), 8, store).count()
    version, old = sharding.latest_map(spark, store)
    assert version == 1
    sharding.assign(spark.createDataFrame(first, "doc_id bigint, text string"), 8, store).count()
    assert sharding.latest_map(spark, store)[0] == 1  # nothing changed: no new version
    more = first + [(i, "y" * (i % 500)) for i in range(3000, 3600)]
    sharding.assign(spark.createDataFrame(more, "doc_id bigint, text string"), 9, store).count()
    version, new = sharding.latest_map(spark, store)
    moved = sum(old[s] != new[s] for s in old)
    assert version == 2 and set(new.values()) == set(range(9))
    assert moved < sharding.SLOTS * 0.35
    assert spark.read.parquet(store).count() == 2 * sharding.SLOTS


def test_shards_can_be_given_up():
    sizes = {s: 10 + s % 7 for s in range(sharding.SLOTS)}
    fewer = sharding.rebalance(sharding.pack(sizes, 5), sizes, 3)
    load = [sum(sizes[s] for s in fewer if fewer[s] == k) for k in range(3)]
    assert set(fewer.values()) == {0, 1, 2} and max(load) - min(load) <= 0.003 * sum(load)


def test_empty(spark):
    assert sharding.assign(empty(spark), 4).count() == 0


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The first map counts, whole; no row comes twice."""
    store, rows = str(tmp_path / "map"), [(i, "x" * (i % 90)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sharding.assign(docs, 4, store).count()
    first = sharding.latest_map(spark, store)
    sharding.write_map(spark, store, 1, {s: 3 - v for s, v in first[1].items()})
    assert sharding.latest_map(spark, store) == first
    assert sharding.assign(docs, 4, store).count() == 500
