"""State of conversations: order, cuts, replays, ends and timers."""

import json
import time

from pyspark.sql import functions as F

from kakusu.streaming import conversations
from kakusu.streaming.conversations import carry_mapping, carry_mapping_stream, restore_deltas
from kakusu.streaming.runner import ROCKSDB, replay, shared_place, spread

PAIR = ["EMAIL_ADDRESS", "IP_ADDRESS"]
CHUNKS = "conv_id long, seq long, chunk string, mapping map<string,string>, done boolean"


def state_rows(query):
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


def test_deltas_in_any_order(spark):
    """Cuts within a placeholder, a replayed chunk, an early last chunk, a tail that only looks like a placeholder."""
    known = {"<EMAIL_ADDRESS_0_5>": "a@b.jp", "<URL_0_" + "1" * 80 + ">": "long"}
    rows = [(1, 3, "5> x <", None, True), (1, 1, "RESS_0_", None, False), (1, 1, "RESS_0_", None, False), (1, 2, None, None, False), (1, 0, "mail <EMAIL_ADD", known, False),
            (2, 0, "a < b <EMAIL", None, True), (3, 0, "<URL_0_" + "1" * 79, known, False), (3, 1, "1><UNKNOWN_1>", None, True)]
    out = replay(spark.createDataFrame(rows, CHUNKS).repartition(6), lambda s: restore_deltas(s, "conv_id"), steps=6).collect()
    text = {k: "".join(r["restored"] for r in sorted(out, key=lambda r: r["seq"]) if r["conv_id"] == k) for k in (1, 2, 3)}
    assert text == {1: "mail a@b.jp x <", 2: "a < b <EMAIL", 3: "long<UNKNOWN_1>"}
    assert len(out) == 7


def test_state_goes_with_the_last_chunk_and_with_the_timer(spark):
    place = shared_place(spark)
    rows = spark.createDataFrame([(1, 0, "x", {"<URL_1>": "u"}, True), (2, 0, "held <URL", {"<URL_1>": "u"}, False), (2, 2, "early", None, False)], CHUNKS)
    rows.write.parquet(f"{place}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = restore_deltas(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), "conv_id", timeout_ms=3000)
        run = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/c").trigger(processingTime="1 second").start()
        end, held = time.time() + 60, None
        while time.time() < end and (held is None or held > 0):
            time.sleep(0.5)
            if run.lastProgress and run.lastProgress["stateOperators"]:
                held = state_rows(run)
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert held == 0
    got = sorted((r["conv_id"], r["seq"], r["restored"]) for r in spark.read.parquet(f"{place}/out").collect())
    assert got == [(1, 0, "x"), (2, 0, "held "), (2, 2, "<URLearly")]


TURNS = [(1, 0, "x@a.jp and y@a.jp"), (1, 1, "y@a.jp 10.0.0.1"), (1, 2, None), (2, 0, "y@a.jp"), (1, 3, "10.0.0.1 x@a.jp x@a.jp"), (3, 0, ""), (None, 0, "z@a.jp")]


def test_one_placeholder_for_one_original(spark):
    df = spark.createDataFrame([(*t, "n") for t in TURNS], "conv_id long, turn long, text string, names string").repartition(4)
    want = sorted([(1, 0, "<EMAIL_ADDRESS_1> and <EMAIL_ADDRESS_2>"), (1, 1, "<EMAIL_ADDRESS_2> <IP_ADDRESS_3>"), (1, 2, None), (2, 0, "<EMAIL_ADDRESS_1>"), (1, 3, "<IP_ADDRESS_3> <EMAIL_ADDRESS_1> <EMAIL_ADDRESS_1>"), (3, 0, ""), (None, 0, "<EMAIL_ADDRESS_1>")], key=repr)
    for block in (1, 2, 64):
        out = carry_mapping(df, entities=PAIR, block=block)
        assert sorted(map(tuple, out.select("conv_id", "turn", "redacted").collect()), key=repr) == want
    streamed = replay(df, lambda s: carry_mapping_stream(s, entities=PAIR), steps=4)
    assert sorted((tuple(r) for r in streamed.select("conv_id", "turn", "redacted").collect()), key=repr) == want
    assert {(r["conv_id"], r["turn"]): r["mapping"] for r in streamed.collect()} == {(r["conv_id"], r["turn"]): r["mapping"] for r in out.collect()}
    assert carry_mapping(df.limit(0), entities=PAIR).collect() == []


def test_a_conversation_that_is_done_starts_anew(spark):
    rows = spark.createDataFrame([(1, 0, "x@a.jp", False), (1, 1, "y@a.jp", True)], "conv_id long, turn long, text string, over boolean")
    place = shared_place(spark)
    for k in range(2):  # the same conversation twice: the second time nothing is known of the first
        out = replay(rows, lambda s: carry_mapping_stream(s, entities=PAIR, done_col="over"))
        assert sorted(r["redacted"] for r in out.collect()) == ["<EMAIL_ADDRESS_1>", "<EMAIL_ADDRESS_2>"]
    rows.write.parquet(f"{place}/in")
    assert spark.read.parquet(f"{place}/in").filter(F.col("over")).count() == 1


class _Counted:
    """A state that keeps tuples and counts what it is asked."""

    def __init__(self):
        self.kept, self.asked = {}, 0

    def _ask(self, answer=None):
        self.asked += 1
        return answer

    def get(self):
        return self._ask(self.kept.get(()))

    def exists(self):
        return self._ask(() in self.kept)

    def update(self, value):
        self._ask(self.kept.update({(): value}))

    def getValue(self, key):
        return self._ask(self.kept.get(key))

    def containsKey(self, key):
        return self._ask(key in self.kept)

    def updateValue(self, key, value):
        self._ask(self.kept.update({key: value}))

    def removeKey(self, key):
        self._ask(self.kept.pop(key))

    def iterator(self):
        return self._ask(iter(list(self.kept.items())))

    def clear(self):
        self._ask(self.kept.clear())


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, _Counted())

    getMapState = getValueState


def test_a_key_asks_its_state_little():
    """Each question is a round trip: one for a response of one chunk; rows that are early for a moment only are never written."""
    handle, processor = _Handle(), conversations._Restore(None, ["conv_id", "seq", "restored"])
    processor.init(handle)
    row = lambda seq, chunk, done: {"seq": seq, "value": json.dumps({"chunk": chunk, "mapping": {"<URL_1>": "u"}}), "done": done}
    run = lambda *rows: [r["restored"] for r in processor.handleInputRows((1,), iter(rows), None)]
    asked = lambda: sum(s.asked for s in handle.states.values())
    assert run(row(0, "a <URL_1>", True)) == ["a u"] and asked() == 1
    assert run(row(2, "c", True), row(1, "_1>", False), row(0, "<URL", False)) == ["", "u", "c"] and asked() == 2
    assert run(row(1, "_1>", True)) == [] and asked() == 5
    assert run(row(0, "<URL", False)) == ["", "u"] and not any(s.kept for s in handle.states.values())


def test_micro_batches_have_files_for_all_cores(spark):
    rows = spread(spark.range(1000), "id", steps=3)
    assert rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
