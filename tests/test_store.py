import threading

import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators.store import Busy, Conflict, LeaseLost, Store


def cache(spark, *keys):
    return spark.createDataFrame([(k, [1.0], None) for k in keys], schemas.CACHE)


def keys(store, table="embedding_cache", key="content_hash"):
    return sorted(r[0] for r in store.read(table).select(key).collect())


def test_tables_change_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    changes = store.begin()
    changes.append("embedding_cache", cache(spark, "a"))
    changes.set_metadata(model="m")
    assert keys(store) == [] and store.get_metadata("model") is None
    assert [r[0] for r in changes.read("embedding_cache").select("content_hash").collect()] == ["a"]
    pinned = store.snapshot()
    assert store.commit(changes) == 1
    assert keys(store) == ["a"] and store.get_metadata("model") == "m" and pinned.read("metadata").count() == 0
    assert store.commit(store.begin()) == 1  # nothing to land


def test_a_reader_keeps_its_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.append("embedding_cache", cache(spark, "a"))
    rows = store.snapshot().read("embedding_cache")
    store.replace("embedding_cache", cache(spark, "b", "c"))
    store.append("embedding_cache", cache(spark, "d"))
    assert [r.content_hash for r in rows.collect()] == ["a"] and keys(store) == ["b", "c", "d"]


def test_two_writers_both_land(spark, tmp_path):
    """Changes that meet are worked out again from the newer state; those of other tables stay beside."""
    store = Store(spark, str(tmp_path / "index"))
    first, second = store.begin(), store.begin()
    first.upsert("embedding_cache", cache(spark, "a"))
    second.upsert("embedding_cache", cache(spark, "b"))
    third = store.begin()
    third.set_metadata(model="m")
    store.commit(first)
    with pytest.raises(Conflict, match="embedding_cache"):
        store.commit(second)
    store.commit(third)
    store.upsert("embedding_cache", cache(spark, "b"))
    assert keys(store) == ["a", "b"] and store.get_metadata("model") == "m"
    failed = []

    def write(name):
        try:
            Store(spark, store.root).run(lambda t: t.append("embedding_cache", cache(spark, name)), attempts=20)
        except Exception as error:
            failed.append(error)

    writers = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and keys(store) == ["a", "b", "w0", "w1", "w2", "w3"]


def test_a_number_is_claimed_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    state = store.log.newest()
    state.version = 7
    won = []
    claims = [threading.Thread(target=lambda: won.append(Store(spark, store.root).log.claim(state))) for _ in range(6)]
    for c in claims:
        c.start()
    for c in claims:
        c.join()
    assert sorted(won) == [False] * 5 + [True] and store.log.names(store.log.folder) == ["000000000007.json"]


def test_a_lease_that_ran_out(spark, tmp_path):
    now = [100.0]
    store, other = (Store(spark, str(tmp_path / "index"), clock=lambda: now[0]) for _ in range(2))
    fence = store.log.acquire("one", 10)
    late = store.begin(fence)
    late.append("embedding_cache", cache(spark, "late"))
    with pytest.raises(Busy, match="one is writing"):
        other.log.acquire("two", 10)
    with pytest.raises(Busy):
        other.append("embedding_cache", cache(spark, "x"))
    now[0] += 5
    store.log.renew(fence, 10)
    now[0] += 9
    with pytest.raises(Busy):
        other.log.acquire("two", 10)
    now[0] += 2
    with pytest.raises(LeaseLost):  # though nobody has taken it yet
        store.commit(late)
    newer = other.log.acquire("two", 10)
    assert newer == fence + 1
    with pytest.raises(LeaseLost):
        store.commit(late)
    with pytest.raises(LeaseLost):
        store.log.renew(fence, 10)
    store.log.release(fence)  # not its own any more
    other.run(lambda t: t.append("embedding_cache", cache(spark, "x")), newer)
    other.log.release(newer)
    other.append("embedding_cache", cache(spark, "y"))
    assert keys(store) == ["x", "y"]
    with store.log.lease(60) as third, pytest.raises(Busy):
        assert third == newer + 1
        other.append("embedding_cache", cache(spark, "z"))


def test_a_lease_is_renewed_while_at_work(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    with store.log.lease(1.5) as fence:
        threading.Event().wait(4)
        store.run(lambda t: t.append("embedding_cache", cache(spark, "a")), fence)
    assert keys(store) == ["a"]


def test_keys_stay_unique(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.upsert("embedding_cache", cache(spark, "a", "a", "b"))
    store.upsert("embedding_cache", cache(spark, "b", "b", "c"))
    assert keys(store) == ["a", "b", "c"]


def test_compact_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    for k in "abcd":
        store.append("embedding_cache", cache(spark, k))
    store.begin().append("embedding_cache", cache(spark, "lost"))
    store.append("lists", spark.createDataFrame([("c", [1.0], 0), ("d", [2.0], 1)], schemas.LISTS))
    store.append("lists", spark.createDataFrame([("e", [1.0], 1)], schemas.LISTS))
    store.compact(3)
    assert len(store.snapshot().state.tables["embedding_cache"]) == 1 and keys(store) == ["a", "b", "c", "d"]
    assert store.vacuum(1) == 5 and keys(store) == ["a", "b", "c", "d"]
    assert store.read("lists").filter(F.col("list") == 1).count() == 2 and keys(store, "lists", "chunk_id") == ["c", "d", "e"]
    assert store.log.names(store.log.folder) == ["000000000007.json"]
    with store.log.lease(60), pytest.raises(Busy):
        store.vacuum()
