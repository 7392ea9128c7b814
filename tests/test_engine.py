"""Golden cases, and the engine against the sequential model on random scripts."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.model import Store
from tests.model import parse as model_parse
from tidemark.functions import codec, hashing
from tidemark.functions.commands import parse, reply
from tidemark.operators import changelog, layout, segments
from tidemark.sources import logs, scratch, sst
from tidemark.sources.store import SegmentStore
from tidemark.streaming.state import run_to_table, stored_state

SESSION = [("SET username=john", "OK"), ("SET score=42", "OK"), ("GET username", "john"), ("DELETE score", "OK"), ("GET score", "NOT_FOUND")]
GOLDEN = {
    "SET name=maria": ("SET", "name", "maria"), "set name = maria rosa": ("SET", "name", "mariarosa"), "SETname=maria": ("SET", "name", "maria"), "settings=1": ("SET", "tings", "1"),
    "SET k=v=w": ("SET", "k", "vw"), "SET abc=": ("SET", "abc", ""), "SET abc": ("SET", "abc", ""), "SET =abc": ("SET", "", "abc"), "SET ===": ("SET", "", ""), "  S e T a = 1": ("SET", "a", "1"),
    "SET K=1": ("SET", "K", "1"), "GET name": ("GET", "name", ""), "getname": ("GET", "name", ""), "getter": ("GET", "ter", ""), "GET =x": ("GET", "", "x"), "GET a=b": ("GET", "a", "b"),
    "DELETE name": ("DELETE", "name", ""), "delete a=b": ("DELETE", "a=b", ""), "deleted": ("DELETE", "d", ""),
    **dict.fromkeys(["SET a=", "SET ab", "GET", "GET  ", "DELETE", "DEL name", "PUT a=1", "exit", "", "SET a:b=1", "SET a=1:2", "SET a=\t1", "SET é=1", "s", "g ", "d", "   "]),
}


def commands(spark, raws):
    return parse(spark.createDataFrame(list(enumerate(raws)), "seq long, raw string"))


def random_script(rng, n):
    out = []
    for _ in range(n):
        key = rng.choice("abcdef")
        out.append(rng.choice([f"SET {key}xx={rng.randrange(99)}", f"SET {key}xx=", f"GET {key}xx", f"DELETE {key}xx", f"DELETE {key}xx", "SET a:b=1", "GET", f"set {key} y y = {rng.randrange(9)}"]))
    return out


def test_parse_goldens(spark):
    rows = commands(spark, list(GOLDEN)).orderBy("seq").collect()
    for r, (raw, want) in zip(rows, GOLDEN.items(), strict=True):
        assert ((r["cmd"], r["key"], r["value"]) if r["valid"] else None) == want, raw
        assert model_parse(raw) == (want, r["reject_code"])
    assert not commands(spark, [None]).first()["valid"]


def test_session_and_script_file(spark, tmp_path):
    path = tmp_path / "script.txt"
    path.write_text("\n".join(["", *[c for c, _ in SESSION], "exit", "SET never=1"]))
    got = changelog.responses(parse(logs.read_script(spark, str(path)))).orderBy("seq").collect()
    assert [r["response"] for r in got] == [r for _, r in SESSION]
    framed = b"".join(struct.pack(">I", len(c)) + c.encode() for c, _ in SESSION)
    read = logs.read_frames(spark.createDataFrame([(framed + b"\0\0\0\x09torn",)], "content binary"))
    assert [r["raw"] for r in read.orderBy("seq").collect()] == [c for c, _ in SESSION]


@pytest.mark.parametrize("seed", range(3))
def test_both_semantics_against_the_model(spark, seed):
    script = random_script(random.Random(seed), 400)
    parsed = commands(spark, script).repartition(3).cache()
    for semantics in ("documented", "observed"):
        model = Store(semantics, 700)
        want = [model.run(c) for c in script]
        placed = segments.segments(parsed, 700)
        df = changelog.responses(parsed) if semantics == "documented" else changelog.responses_observed(parsed, placed.select("seq", "segment_id"))
        assert [r["response"] for r in df.orderBy("seq").collect()] == want
        live = {k: v for k in "abcdef" for k in (f"{k}xx", f"{k}yy") if (v := model.run(f"GET {k}")) != "NOT_FOUND"}
        state = changelog.snapshot(parsed) if semantics == "documented" else changelog.snapshot_observed(parsed.where("valid").join(placed, "seq"))
        assert {r["key"]: r["value"] for r in state.collect()} == {k: v for k, v in live.items()}
    table = segments.segment_table(parsed, placed, 700, final_flush=False)
    levels = segments.level_layout(table).orderBy("segment_id").collect()
    assert (levels[-1]["l0_files"], levels[-1]["l1_files"]) == (len(model.l0), len(model.l1))
    last = changelog.segment_entries(parsed.where("valid").join(placed, "seq").where(F.col("segment_id") == len(levels)))
    assert {r["key"]: r["value"] for r in last.collect()} == model.memory


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=60), st.integers(1, 90), st.integers(1, 7))
def test_fold_in_batches_equals_a_loop(ops, limit, batch):
    want, segment, total, has_set = [], 0, 0, False
    for delta, is_set in ops:
        total, has_set = total + delta, has_set or is_set
        want.append((segment, total))
        if total >= limit and has_set:
            segment, total, has_set = segment + 1, 0, False
    got, state = [], (0, 0, False)
    for at in range(0, len(ops), batch):
        part = ops[at : at + batch]
        ids, running, state = segments.fold_segments(np.array([d for d, _ in part]), np.array([s for _, s in part]), limit, state)
        got += zip(ids.tolist(), running.tolist(), strict=True)
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=60), st.integers(1, 90), st.lists(st.integers(0, 60), max_size=6), st.integers(0, 150), st.booleans())
def test_summaries_of_ranges_equal_the_fold(ops, limit, cuts, carried, has_set):
    delta = np.array([d if d or not s else 1 for d, s in ops], np.int64)  # a SET always writes something
    is_set = np.array([s for _, s in ops], bool)
    carried = carried % limit if has_set else carried
    want = segments.fold_segments(delta, is_set, limit, (3, carried, has_set))[2]
    parts = [segments.summarise(delta[p], is_set[p], limit) for p in np.split(np.arange(len(ops)), sorted(min(c, len(ops)) for c in cuts))]
    parts = [segments.Summary.from_bytes(x.to_bytes()) for x in parts]
    for tree in (parts, [segments.compose(parts, limit)], [segments.compose(parts[:2], limit), *parts[2:]]):
        state = np.array([3]), np.array([carried]), np.array([has_set])
        for x in tree:
            state = x.apply(limit, *state)
        assert tuple(x[0].item() for x in state) == tuple(want)


@pytest.mark.parametrize(("range_rows", "fan_in"), [(1 << 20, 64), (37, 64), (23, 2)])
def test_segments_in_ranges(spark, range_rows, fan_in):
    parsed = commands(spark, random_script(random.Random(12), 700)).repartition(3)
    rows = parsed.where("valid").orderBy("seq").collect()
    delta = np.array([0 if r["cmd"] == "GET" else len(r["key"]) + len(r["value"]) + 64 for r in rows])
    ids, running, _ = segments.fold_segments(delta, np.array([r["cmd"] == "SET" for r in rows]), 900, (0, 0, False))
    got = segments.segments(parsed, 900, range_rows, fan_in).orderBy("seq").collect()
    assert [tuple(r) for r in got] == list(zip([r["seq"] for r in rows], ids.tolist(), running.tolist(), strict=True)) and ids[-1] > 20
    assert segments.segments(parsed.limit(0)).count() == 0


def test_replies_in_chunks(spark):
    script = random_script(random.Random(13), 500)
    model = Store()
    want = [model.run(c) for c in script]
    got = changelog.responses(commands(spark, script).repartition(3), chunk_bits=4).orderBy("seq").collect()
    assert [r["response"] for r in got] == want


def test_replies_to_failed_writes(spark):
    rows = [("SET", True, True, "OK"), ("SET", False, True, "ERROR: failed to write WAL"), ("SET", True, False, "ERROR: failed to set key"), ("DELETE", False, None, "ERROR: failed to write WAL"), ("DELETE", True, False, "OK"), ("GET", None, None, "v"), (None, None, None, "ERROR: bad request")]
    df = spark.createDataFrame(rows, "cmd string, logged boolean, stored boolean, want string")
    got = df.select("want", reply(F.col("cmd"), F.lit("v"), F.col("logged"), F.col("stored")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_delete_across_a_flush(spark):
    parsed = commands(spark, ["SET a=123", "DELETE a", "GET a", "SET abc=1", "SET abc=", "GET abc"])
    placed = segments.segments(parsed, 1)
    assert [r[1] for r in changelog.responses(parsed).orderBy("seq").collect()][2] == "NOT_FOUND"
    observed = [r[1] for r in changelog.responses_observed(parsed, placed.select("seq", "segment_id")).orderBy("seq").collect()]
    assert observed[2] == "123" and observed[5] == "NOT_FOUND"


# formats


def test_wal_record_and_torn_tails(spark):
    record = bytes.fromhex("0000001201000000046E616D65000000056D61726961")
    assert bytes(commands(spark, ["SET name=maria"]).select(codec.wal_record(F.col("cmd"), F.col("key"), F.col("value"))).first()[0]) == record
    assert list(codec.decode_wal(record)) == [("SET", b"name", b"maria")]
    for cut in range(1, len(record)):
        assert list(codec.decode_wal(record * 2 + record[:cut])) == [("SET", b"name", b"maria")] * 2
        seen = list(codec.decode_wal(record[:cut], "observed"))
        assert seen == ([("SET", b"name", record[17:cut])] if cut >= 17 else [])
    delete = bytes.fromhex("0000000703000000026162")
    assert list(codec.decode_wal(delete[:-1])) == [] and list(codec.decode_wal(delete[:-1], "observed")) == [("DELETE", b"a", b"")]
    assert list(codec.decode_wal(b"\0\0\0\x06" + delete[4:])) == []


def test_wal_files(spark, tmp_path):
    (tmp_path / "wal").write_bytes(bytes.fromhex("0000001201000000046E616D65000000056D61726961" * 2 + "00000012"))
    assert logs.read_wal_files(spark, str(tmp_path)).count() == 2


def test_wal_files_are_replayed_in_the_order_of_their_names(spark, tmp_path):
    for k in range(6):
        sets = [("SET", "name", f"v{k}"), ("SET", f"own{k}", "x")]
        df = spark.createDataFrame(sets, "cmd string, key string, value string")
        image = b"".join(bytes(r[0]) for r in df.select(codec.wal_record(F.col("cmd"), F.col("key"), F.col("value"))).collect())
        (tmp_path / f"wal-{k}").write_bytes(image)
    replayed = logs.read_wal_files(spark, str(tmp_path))
    assert {r["value"]: r["log_id"] for r in replayed.where("key = 'name'").collect()} == {f"v{k}": k + 1 for k in range(6)}
    state = changelog.snapshot(replayed.withColumn("seq", F.struct("log_id", "ordinal")))
    assert {r["key"]: r["value"] for r in state.collect()} == {"name": "v5"} | {f"own{k}": "x" for k in range(6)}


def test_table_file_golden(spark):
    entries = spark.createDataFrame([(0, "username", "john", False), (0, "score", None, True)], "segment_id long, key string, value string, tombstone boolean")
    data = b"".join(codec.encode_entry(k, v, t) for k, v, t in [(b"score", None, True), (b"username", b"john", False)])
    assert data.hex() == "0000000573636f72650100000008757365726e616d6500000000046a6f686e"
    assert list(codec.decode_entries(data)) == [(b"score", None, True), (b"username", b"john", False)] and list(codec.decode_entries(data[:-1])) == [(b"score", None, True)]
    laid = layout.entry_layout(entries)
    assert [tuple(r)[1:] for r in laid.orderBy("ordinal").collect()] == [(0, "score", 10, 12), (1, "username", 21, 22)]
    meta = layout.metadata(laid).first()
    assert (meta["data_end"], meta["index_offset"], meta["file_size"], meta["min_key"], meta["max_key"]) == (43, 56, 117, "score", "username")
    bloom = hashing.Bloom.build([b"score", b"username"])
    assert (bloom.m, bloom.k) == (64, 20) and bloom.to_bytes()[5:].hex() == "955339155bb1511b"


def test_table_file_golden_bytes(spark, tmp_path):
    entries = [(b"score", None, True), (b"username", b"john", False)]
    raw = sst.encode_table(entries, 1, 5)
    data = "0000000573636f72650100000008757365726e616d6500000000046a6f686e"
    index = "00000001" + "00000005" + b"score".hex() + "000000000000000c"
    footer = "000000000000002b" + "000000000000002b" + "0000000000000038" + "00000002" + "00000001" + "0000000000000005"
    assert raw.hex() == b"SSTR1.0\0".hex() + "00000002" + data + "00000040" + "14" + "955339155bb1511b" + index + footer and len(raw) == 117
    table = sst.TableFile.open(raw)
    assert list(table.scan()) == entries and (table.level, table.created_ms, table.entry_count) == (1, 5, 2)
    assert table.get(b"score") == (None, True) and table.get(b"username") == (b"john", False) and table.get(b"zzz") is None and table.get(b"a") is None
    many = [(f"k{i:05d}".encode(), b"" if i % 7 == 0 else str(i).encode(), False) for i in range(1000)]
    table = sst.TableFile.open(sst.encode_table(many, 0, 0))
    assert len(table.index) == 63 and all(table.get(k) == (v, t) for k, v, t in many) and not any(table.get(f"m{i}".encode()) for i in range(500))
    for bad in (b"", raw[:50], b"X" + raw[1:], raw[:-1], raw[:77] + b"\xff" * 24 + raw[101:]):
        with pytest.raises((sst.BadTable, ValueError, struct.error)):
            sst.TableFile.open(bad)
    for name, content in (("L0_2.sst", raw), ("L0_1.sst", sst.encode_table(many, 0, 0)), ("L0_3.sst", raw[:40]), ("other.txt", raw)):
        (tmp_path / name).write_bytes(content)
    read = sst.read_table_files(spark, str(tmp_path))
    assert {(r["segment_id"], r["count"]) for r in read.groupBy("segment_id").count().collect()} == {(0, 1000), (1, 2)}


def test_u64(spark):
    got = spark.range(1).select(codec.read_u64(codec.u64(F.lit(2**62 + 5))), codec.u64(F.lit(258))).first()
    assert got[0] == 2**62 + 5 and bytes(got[1]) == bytes([0] * 6 + [1, 2])


def test_hash_goldens(spark):
    want = {"": (0xF0549B6C14F656F6, 0x81E8602732DA49DC), "a": (0x2C6B8FE6B276F963, 0xD15D83F54A5F8B4A), "name": (0xEB65934631299276, 0x1CB3664AC0B9224B), "username": (0xB7A5862D4D7AACA3, 0x85F739CFD5BEE253), "username1": (0x0111AC602F0DEFC4, 0x0E907C2E545926CE)}
    for k, seed in enumerate(hashing.SEEDS):
        assert hashing.murmur64([w.encode() for w in want], seed).tolist() == [v[k] for v in want.values()]
    df = spark.createDataFrame([(w,) for w in want], "key string").select("key", hashing.murmur64_column("key", F.lit(hashing.SEEDS[1] - (1 << 64))).alias("h"))
    assert {r["key"]: r["h"] % (1 << 64) for r in df.collect()} == {w: v[1] for w, v in want.items()}


@pytest.mark.parametrize(("n", "m", "k"), [(1, 64, 20), (2, 64, 20), (4, 64, 11), (10, 96, 7), (16, 154, 7), (50, 480, 7), (100, 959, 7), (1000, 9586, 7), (10000, 95851, 7)])
def test_bloom_shape(spark, n, m, k):
    assert codec.bloom_shape(n) == (m, k)
    a, b = codec.bloom_columns(F.lit(n))
    assert tuple(spark.range(1).select(a, b).first()) == (m, k)


def test_bloom_rates():
    keys, others = [f"k{i}".encode() for i in range(2000)], [f"o{i}".encode() for i in range(20000)]
    bloom = hashing.Bloom.from_bytes(hashing.Bloom.build(keys).to_bytes())
    assert bloom.might_contain(keys).all() and bloom.might_contain(others).mean() < 0.02
    with pytest.raises(ValueError):
        hashing.Bloom.from_bytes(bloom.to_bytes()[:-1])


def test_sessions_of_scripts_and_frames(spark, tmp_path):
    for name, lines in (("b.txt", ["SET k=second", "GET k"]), ("a.txt", ["SET k=first", "", "GET k", "exit", "DELETE k"])):
        (tmp_path / name).write_text("\n".join(lines))
    read = logs.read_script(spark, str(tmp_path))
    assert [(r["session"], r["raw"]) for r in read.orderBy("seq").collect()] == [(0, "SET k=first"), (0, "GET k"), (1, "SET k=second"), (1, "GET k")]
    assert {r["value"] for r in changelog.snapshot(parse(read)).collect()} == {"second"} and read.select("seq").distinct().count() == 4
    framed = [(n, b"".join(struct.pack(">I", len(c)) + c for c in (b"SET k=%d" % n, b"GET k"))) for n in (7, 3)]
    df = spark.createDataFrame(framed, "stream long, content binary")
    read = logs.read_frames(df, session="stream")
    assert [r["raw"] for r in read.orderBy("seq").collect()] == ["SET k=3", "GET k", "SET k=7", "GET k"]
    with pytest.raises(ValueError):
        logs.read_frames(df)


def test_scratch_is_deleted_with_its_scope(spark):
    import glob

    with scratch.scratch_scope(spark):
        table = scratch.scratch_table(spark.range(5), "scoped")
        kept = scratch.checkpoint(spark.range(7).selectExpr("id * 2 AS id"))
        assert table.count() == 5 and kept.count() == 7
        assert glob.glob(f"{scratch.shared_dir(spark).removeprefix('file:')}/scoped-*")
    assert not glob.glob(f"{scratch.shared_dir(spark).removeprefix('file:')}/scoped-*")


# store and stream


def test_store(spark, tmp_path):
    store, model = SegmentStore(spark, str(tmp_path / "store")), Store()
    assert store.get("a") == "NOT_FOUND"
    rng = random.Random(4)
    for _ in range(6):
        rows = {rng.choice("abcdefgh"): rng.choice([None, "", "1", "2"]) for _ in range(5)}
        store.flush(spark.createDataFrame([(k, v, v is None) for k, v in rows.items()], "key string, value string, tombstone boolean"))
        model.memory = rows
        model.flush()
        assert all(store.get(k) == model.run(f"GET {k}" if k else "GET  ") for k in "abcdefgh")
        levels = [r["level"] for r in store.manifest().collect()]
        assert (levels.count(0), levels.count(1)) == (len(model.l0), len(model.l1))
    before = {k: store.get(k) for k in "abcdefgh"}
    store.compact(drop_tombstones=True)
    assert before == {k: store.get(k) for k in "abcdefgh"} and not store.entries().where("tombstone").count()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,a)" in store.entries("a")._jdf.queryExecution().executedPlan().toString() or not store.manifest().where("min_key <= 'a'").count()


def test_store_loads_answers_and_keeps_old_versions(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    rows = [(n, f"k{i}", None if (n + i) % 5 == 0 else f"{n}-{i}") for n in range(6) for i in range(n, n + 20)]
    df = spark.createDataFrame([(n, k, v, v is None) for n, k, v in rows], "segment_id long, key string, value string, tombstone boolean")
    store.load(df)
    last = {k: v for _, k, v in rows}
    keys = spark.createDataFrame([(f"k{i}",) for i in range(30)] + [("k1",)], "key string")
    want = {f"k{i}": last.get(f"k{i}") or "NOT_FOUND" for i in range(30)}
    assert {r["key"]: r["response"] for r in store.multi_get(keys).collect()} == want and store.table_count() == 6
    assert store.multi_get(keys.limit(0)).count() == 0 and SegmentStore(spark, str(tmp_path / "none")).multi_get(keys).where("response <> 'NOT_FOUND'").count() == 0
    reader = store.multi_get(keys)
    store.compact()
    assert {r["key"]: r["response"] for r in reader.collect()} == want  # the files of the version before are still there
    assert {r["key"]: r["response"] for r in store.multi_get(keys).collect()} == want and store.table_count() == 1
    store.flush(spark.createDataFrame([("k1", "new", False)], "key string, value string, tombstone boolean"))
    store.vacuum(1)
    assert store.get("k1") == "new" and store.get("k2") == want["k2"] and len(store.versions()) == 1


def test_store_discovers_segments_without_a_manifest(spark, tmp_path):
    import shutil

    store = SegmentStore(spark, str(tmp_path / "store"))
    for value in ("1", "2"):
        store.flush(spark.createDataFrame([("a", value, False), (f"own{value}", value, False)], "key string, value string, tombstone boolean"))
    shutil.rmtree(tmp_path / "store" / "manifests")
    assert store.get("a") == "NOT_FOUND"
    store.discover()
    assert (store.get("a"), store.get("own1"), store.table_count()) == ("2", "1", 2)


def test_stream_merges_changes_and_shows_its_state(spark, tmp_path):
    script = random_script(random.Random(3), 200)
    source, state = tmp_path / "in", tmp_path / "state"
    for part in range(5):
        rows = [(i, c) for i, c in enumerate(script) if i % 5 == part]
        spark.createDataFrame(rows, "seq long, raw string").coalesce(1).write.mode("append").parquet(str(source))
        got = run_to_table(spark.readStream.schema("seq long, raw string").parquet(str(source)), str(state), merge_every=2)
    parsed = commands(spark, script)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, changelog.snapshot(parsed).collect()))
    assert len(list((state / "changes").glob("batch=*"))) < 2 and len(list((state / "changes").glob("merged-*"))) == 1
    held = stored_state(spark, str(state))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, changelog.last_mutations(parsed).collect()))


def test_stream_restarts_and_reorders(spark, tmp_path):
    script = random_script(random.Random(9), 300)
    rows = list(enumerate(script))
    random.Random(1).shuffle(rows)
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(rows[part::3], "seq long, raw string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("seq long, raw string").parquet(str(source))
        got = run_to_table(stream, str(tmp_path / "state"))
        seen = [r for p in range(part + 1) for r in rows[p::3]]
        want = changelog.snapshot(parse(spark.createDataFrame(seen, "seq long, raw string")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
