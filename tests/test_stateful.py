from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.streaming import stateful as M
from plumbline.streaming.sampling import sample_share

SCHEMA = "id long, k string, at timestamp, bad boolean"
START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", M.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def messages(many, seed=0):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 3_000_000, many))
    return [(i, ["a", "b", "c", "hot"][min(int(rng.integers(9)), 3)], START + timedelta(milliseconds=int(x // 7 * 7)), bool(rng.random() < 0.02)) for i, x in enumerate(at)]


def greedy(rows, period):
    last, out = {}, set()
    for i, k, at, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or at - last[k] >= timedelta(milliseconds=period):
            last[k] = at
            out.add(i)
        elif bad:
            out.add(i)
    return out


@pytest.mark.parametrize(("period", "slice_s"), [(10_000, 60), (1_000, 30), (45_000, 45), (10_000, 86_400)])
def test_recorded_periods_on_a_table(spark, period, slice_s):
    """Slices shorter than a key's messages: what is picked equals the sequential rule."""
    rows = messages(1500)
    frame = spark.createDataFrame([*rows, (9000, "a", None, True), (9001, "a", None, False)], SCHEMA)
    got = [r.id for r in M.sample_recorded(frame, "k", "at", "id", period, F.col("bad"), slice_s).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows, period) | {9000}
    none = M.sample_recorded(frame, "k", "at", "id", period, None, slice_s)
    assert {r.id for r in none.collect()} == greedy([(i, k, at, False) for i, k, at, _ in rows], period)
    assert M.sample_recorded(frame.limit(0), "k", "at", "id").collect() == []


def written(spark, rows, folder, parts):
    """Files of a stream, in order of arrival."""
    for n, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def drained(stream, folder):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_recorded_periods_on_a_stream(rocks, tmp_path):
    """Rows out of order across files, a stop in between and a restart: the result is the table's, each row once."""
    rows = messages(300, 1)
    order = sorted(range(300), key=lambda i: (rows[i][2] + timedelta(seconds=(i * 7919 % 50))))
    end = [(8000 + i, "end", START + timedelta(days=1 + i), False) for i in range(2)]
    rows += end
    parts = [order[:100], order[100:180], order[180:], [300], [301]]

    def run():
        return M.stream_sample_recorded(source(rocks, tmp_path), "k", "at", "id", 10_000, "2 minutes", F.col("bad"))

    written(rocks, rows, tmp_path, parts[:2])
    drained(run(), tmp_path)
    for n, part in enumerate(parts[2:], 2):
        rocks.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    last = drained(run(), tmp_path)
    got = [r.id for r in rocks.read.parquet(f"{tmp_path}/out").collect() if r.k != "end"]
    assert len(got) == len(set(got)) and set(got) == greedy(rows[:300], 10_000)
    state = [o["numRowsTotal"] for o in last.lastProgress["stateOperators"]]
    assert sum(state) <= 6  # only the last key's held row, its last time and timers


def test_shares_on_a_stream(rocks, tmp_path):
    rows = messages(200, 2)
    rows += [(8000, "end", START + timedelta(days=1), False)]
    written(rocks, rows, tmp_path, [range(100, 200), range(100), [200]])
    drained(M.stream_sample_share(source(rocks, tmp_path), "k", "at", "id", 0.2, "1 hour"), tmp_path)
    got = [r.id for r in rocks.read.parquet(f"{tmp_path}/out").collect() if r.k != "end"]
    want = {r.id for r in sample_share(rocks.createDataFrame(rows[:200], SCHEMA), "id", 0.2, "k", "at").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_signed_statistics_on_a_stream(rocks, tmp_path):
    """Deletes of extremes, of all rows of a key, and one that is ahead of its row."""
    rng = np.random.default_rng(5)
    live, files = [], []
    for _ in range(4):
        part = []
        for _ in range(300):
            if live and rng.random() < 0.45:
                k, v = live.pop(int(rng.integers(len(live))))
                part.append((k, v, -1))
            else:
                k, v = ["a", "b"][int(rng.integers(2))], float(np.round(rng.normal(0, 50), 1))
                live.append((k, v))
                part.append((k, v, 1))
        files.append(part)
    files[0] += [("gone", 1.5, 1), ("gone", 1.5, 1), ("ahead", 7.0, -1), ("ahead", 1.0, 1), ("a", None, 1)]
    files[2] += [("gone", 1.5, -1), ("gone", 1.5, -1), ("ahead", 7.0, 1), ("ahead", 9.0, 1)]
    for low in (min, max):
        k, v = low(live, key=lambda x: x[1])
        live.remove((k, v))
        files[3].append((k, v, -1))
    live += [("ahead", 1.0), ("ahead", 9.0)]
    shape = "k string, v double, s long"
    for n, part in enumerate(files):
        rocks.createDataFrame(part, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = rocks.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    query = M.stream_signed_extremes(stream, "k", "v", "s").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    final = {r[1]: r[2:] for r in sorted(seen, key=lambda r: r[0])}
    whole = rocks.createDataFrame([x for part in files for x in part], shape)
    table = {r.k: r for r in M.signed_extremes(whole, ["k"], "v", "s").collect()}
    assert final.pop("gone") == (0, None, None, None, None) and "gone" not in table
    assert set(final) == set(table) == {"a", "b", "ahead"}
    for k, (n, total, mean, low, high) in final.items():
        values = [v for key, v in live if key == k]
        assert (n, low, high) == (len(values), min(values), max(values)) == (table[k].n, table[k].min, table[k].max)
        assert total == pytest.approx(sum(values)) and mean == pytest.approx(table[k]["mean"]) and total == pytest.approx(table[k]["sum"])


def test_multiset_against_a_sorted_list(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = np.random.default_rng(0)
    blocks, plain = {}, []
    held = M.Multiset([], [], lambda n: tuple(map(list, blocks[n])), lambda n, v, c: blocks.__setitem__(n, (v, c)), lambda n: blocks.pop(n))
    for _ in range(3000):
        if plain and rng.random() < 0.5:
            v = plain.pop(int(rng.integers(len(plain))))
            assert held.add(v, -1) == -1
        else:
            v = float(rng.integers(60))
            plain.append(v)
            assert held.add(v, 1) == 1
        assert (held.end(False), held.end(True)) == ((min(plain), max(plain)) if plain else (None, None))
        assert all(len(v) <= 4 for v, _ in blocks.values()) and set(blocks) == set(held.names)
