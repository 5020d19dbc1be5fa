"""Outcome tables, file sources and sinks, and the poll state machine in batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from fundtrail.functions import money, status
from fundtrail.operators import cases
from fundtrail.sources import dataset, explorer, lists, sinks
from fundtrail.streaming import polls as watch
from fundtrail.streaming import watchlist


@pytest.mark.parametrize(
    "first,second,expected",
    [
        (429, 404, "rate-limited"), (400, None, "timeout"), (400, 404, "bad-address"), (500, 400, "api-error"),
        (429, 429, "rate-limited"), (None, 429, "rate-limited"), (404, 404, "bad-address"), (500, 503, "api-error"),
        (401, 403, "api-error"), (500, 200, "answered"), (200, 429, "answered"), (None, None, "timeout"),
    ],
)
def test_lookup_verdict(spark, first, second, expected):
    rows = [("a", s, s is None) for s in (first, second)]
    df = spark.createDataFrame(rows, "address string, status int, timed_out boolean")
    assert cases.lookup_verdict(df).first()["lookup"] == expected


def test_one_rejection_alone_is_no_verdict(spark):
    df = spark.createDataFrame([("a", 404, False)], "address string, status int, timed_out boolean")
    assert cases.lookup_verdict(df).first()["lookup"] == "api-error"


def test_request_failures(spark):
    table = [
        (404, False, None, None, "pipeline", "dataset-miss"), (None, True, None, None, "retryable", "timeout"),
        (429, False, None, None, "retryable", "rate-limited"), (503, False, True, "timeout", "retryable", "timeout"),
        (503, False, True, None, "retryable", "api-error"), (503, False, False, None, "fallback", "service-error"),
        (422, False, None, None, "invalid-input", "invalid-request"), (500, False, None, None, "fallback", "service-error"),
        (None, False, None, None, "fallback", "unreachable"),
    ]
    df = spark.createDataFrame(table, "status int, aborted boolean, retryable boolean, kind string, ws string, wk string")
    got = df.select("ws", "wk", status.request_failure(F.col("status"), F.col("aborted"), F.col("retryable"), F.col("kind")).alias("s"))
    assert all((r["s"]["source"], r["s"]["kind"]) == (r["ws"], r["wk"]) for r in got.collect())


def test_outcomes_stay_apart(spark):
    table = [
        ("retryable", None, None, True, True, "retryable"), ("invalid-input", None, None, True, True, "invalid_input"),
        ("fallback", None, None, True, True, "fallback"), ("pipeline", "invalid-address-format", None, False, False, "empty"),
        ("pipeline", "not-found-on-chain", None, False, False, "empty"), ("pipeline", "live-lookup", "rate-limited", True, True, "retryable"),
        ("pipeline", "live-lookup", None, True, False, "incomplete"), ("pipeline", "elliptic-indexed", None, False, True, "incomplete"),
        ("pipeline", "elliptic-indexed", None, True, True, "pipeline"), ("pipeline", None, None, True, True, "empty"),
    ]
    df = spark.createDataFrame(table, "request_source string, source string, failure string, has_rules boolean, has_verdict boolean, want string")
    assert all(r["outcome"] == r["want"] for r in cases.case_outcomes(df).collect())


def test_money(spark):
    df = spark.createDataFrame([(150000000, 1000, 600), (1, 7, 0)], "sats long, fee long, weight long")
    rows = df.select(
        money.sats_to_btc(F.col("sats")).cast("string").alias("btc"), money.sats_to_inr(F.col("sats")).alias("inr"),
        money.fee_rate(F.col("fee"), F.col("weight")).alias("rate"), money.clamp_hops(F.col("fee")).alias("hops"),
    ).collect()
    assert tuple(rows[0]) == ("1.50000000", 1342200, 7, 10) and tuple(rows[1]) == ("0.00000001", 0, 0, 7)


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_dataset_folder(spark, tmp_path):
    write(tmp_path, "Actors Dataset/txs_features_actors.csv", "no\n")
    write(tmp_path, "deep/er/my_txs_Features.csv", "a,3,0.5\nb,4,1.5\n")
    write(tmp_path, "txs_classes.csv", "txId,class\nb, Unknown \na,1\n")
    write(tmp_path, "txs_edgelist.csv", "txId1,txId2\na,b\n")
    nodes, edges = dataset.load_dataset(spark, str(tmp_path), n_features=2)
    assert {(r["tx_id"], r["label"], r["time_step"]) for r in nodes.collect()} == {("a", 1, 3), ("b", -1, 4)}
    assert [tuple(r) for r in edges.collect()] == [("a", "b")]
    with pytest.raises(dataset.DatasetError, match="columns"):
        dataset.load_dataset(spark, str(tmp_path), n_features=3)
    write(tmp_path, "txs_classes.csv", "txId,class\nb,9\na,1\n")
    with pytest.raises(dataset.DatasetError, match="9"):
        dataset.load_dataset(spark, str(tmp_path), n_features=2)
    write(tmp_path, "txs_classes.csv", "txId,class\nc,2\na,1\n")
    with pytest.raises(dataset.DatasetError, match="ids"):
        dataset.load_dataset(spark, str(tmp_path), n_features=2)
    write(tmp_path, "txs_classes.csv", "txId,class\nb,2\na,1\n")
    write(tmp_path, "deep/er/my_txs_Features.csv", "a,3,0.5\nb,4,much\n")
    with pytest.raises(dataset.DatasetError, match="1 feature lines that don't parse, among them 'b,4,much'"):
        dataset.load_dataset(spark, str(tmp_path), n_features=2)
    assert dataset.scan_address_map(spark, str(tmp_path / "deep")).count() == 0
    with pytest.raises(FileNotFoundError):
        dataset.find_files(spark, str(tmp_path / "none"), "x")


def test_dataset_files_are_read_once(spark, tmp_path, monkeypatch):
    """Each raw file is scanned by one written table, and the tables outlive the files."""
    from fundtrail import session

    plans = []
    write_table = session.materialize

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write_table(df, name)

    monkeypatch.setattr(dataset, "materialize", noted)
    write(tmp_path, "raw/txs_features.csv", "a,3,0.5\nb,4,1.5\n")
    write(tmp_path, "raw/txs_classes.csv", "txId,class\nb,2\na,1\n")
    write(tmp_path, "raw/txs_edgelist.csv", "txId1,txId2\na,b\n")
    nodes, edges = dataset.load_dataset(spark, str(tmp_path / "raw"), n_features=2)
    assert [p.count(" csv") for p in plans] == [2, 1]
    for file in (tmp_path / "raw").iterdir():
        file.unlink()
    assert (nodes.count(), edges.count()) == (2, 1)


def test_lists(spark, tmp_path):
    text = "# note\n\nx1, Name ,src,IN\nx2,Bare\nx3\n,NoAddress\nx4,Blank,,\n"
    write(tmp_path, "tags.txt", text)
    tags = {r["address"]: tuple(r)[1:4] for r in lists.read_exchange_tags(spark, str(tmp_path / "tags.txt")).collect()}
    assert tags == {"x1": ("Name", "src", "IN"), "x2": ("Bare", "unsourced", None), "x4": ("Blank", "unsourced", None)}
    lines = lists.read_lines(spark, str(tmp_path / "tags.txt"))
    assert {r["line"] for r in lists.rejected_tags(lines).collect()} == {"x3", ",NoAddress"}
    assert lists.read_mixers(spark, str(tmp_path / "absent.txt")).count() == 0
    bulk = spark.createDataFrame([(" 12345678901 ",), ("1234567890",), ("",)], "line string")
    assert [r[0] for r in lists.parse_bulk_complaints(bulk).collect()] == ["12345678901"]
    one = spark.createDataFrame([("k", "s", "c", " w ", None), ("k", "s", "c", "  ", 5.0)], "ack_number string, victim_state string, scam_category string, suspect_address string, amount_inr double")
    row = lists.complaints(one).collect()
    assert len(row) == 1 and (row[0]["suspect_address"], row[0]["amount_inr"], row[0]["amount_btc"]) == ("w", 100000.0, 0.1118)


def test_explorer_json(spark):
    esplora = """{"txid":"t","status":{"block_time":0},"vin":[{"txid":"p","vout":4294967295},{"txid":"q","vout":1,"prevout":{"scriptpubkey_address":"a","value":9}}],"vout":[{"value":0},{"scriptpubkey_address":"b","value":8}]}"""
    row = explorer.parse_esplora(spark.createDataFrame([(esplora,)], "json string")).first()
    assert (row["tx_hash"], row["timestamp"], row["block_height"]) == ("t", None, None)
    assert [i["address"] for i in row["inputs"]] == [None, "a"] and [o["address"] for o in row["outputs"]] == [None, "b"]
    cypher = """{"hash":"t","confirmed":"%s","block_height":%d,"inputs":[{"prev_hash":"","output_index":-1},{"addresses":["a","z"],"output_value":9}],"outputs":[{"addresses":null,"value":0}]}"""
    texts = [cypher % ("2014-05-22T03:46:25Z", 7), cypher % ("rubbish", -1), '{"hash":"u","confirmed":1400000000}', cypher % ("2014-05-22T05:46:25.5+02:00", 0)]
    rows = explorer.parse_blockcypher(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert [r["timestamp"] for r in rows] == [1400730385, None, 1400000000, 1400730385]
    assert [r["block_height"] for r in rows] == [7, None, None, None]
    assert [i["address"] for i in rows[0]["inputs"]] == [None, "a"] and rows[2]["inputs"] == []


def test_audit_log_keeps_every_run(spark, tmp_path):
    report = spark.createDataFrame([(1, True)], "n int, leakage_free boolean")
    for run in ("run-1", "run-2"):
        sinks.append_audit(str(tmp_path / "audit"), report, run)
    schema = report.withColumn("run_id", F.lit("")).schema
    assert spark.read.schema(schema).json(str(tmp_path / "audit")).count() == 2
    assert sinks.latest_audit(spark, str(tmp_path / "audit"), schema).first()["run_id"] == "run-2"


ME, OTHER = "1Me", "1Other"


def tx(name, ins, outs, fee=100, weight=400):
    return {
        "txid": name, "fee": fee, "weight": weight,
        "vin": [{"prevout": {"scriptpubkey_address": a, "value": v} if a else None} for a, v in ins],
        "vout": [{"scriptpubkey_address": a, "value": v} for a, v in outs],
    }


PAY = tx("pay", [(ME, 500)], [(ME, 100), (OTHER, 390)])
SPEND = tx("spend", [(ME, 500)], [(None, 0), (OTHER, 390)], fee=5, weight=0)
GAIN = tx("gain", [(OTHER, 70)], [(ME, 60)])
NOISE = tx("noise", [(OTHER, 7)], [(OTHER, 6)])


def polls_df(spark, rows):
    return spark.createDataFrame([(i, a, ts, ok, why, txs) for i, (a, ts, ok, why, txs) in enumerate(rows)], watch.POLL_SCHEMA)


def test_alert_fields(spark):
    rows = [(ME, 1, True, None, [NOISE, SPEND, GAIN]), (ME, 2, True, None, [PAY]), (ME, 3, True, None, [tx("c", [(None, 0)], [(ME, 5)])]), (ME.lower(), 4, True, None, [GAIN])]
    got = {r["poll_ts"]: r for r in watch.mempool_alerts(watch.read_polls(polls_df(spark, rows))).collect()}
    assert (got[1]["tx_hash"], got[1]["direction"], got[1]["counterparty"], got[1]["fee_rate"]) == ("spend", "outgoing", "Unknown", 0)
    assert (got[2]["direction"], str(got[2]["amount_btc"]), got[2]["counterparty"], got[2]["fee_rate"]) == ("incoming", "0.00000600", ME, 1)
    assert got[3]["counterparty"] == "Unknown" and 4 not in got
    loose = watch.mempool_alerts(watch.read_polls(polls_df(spark, rows), case_insensitive=True))
    assert 4 in {r["poll_ts"] for r in loose.collect()}


# One address per case: polls in order, then the expected (alert, reason, last success).
TRANSITIONS = {
    "raise": ([(1, True, None, [GAIN])], ("gain", None, 1)),
    "failure keeps alert and freshness": ([(1, True, None, [GAIN]), (2, False, "rate-limited", None)], ("gain", "rate-limited", 1)),
    "no reason means api error": ([(1, False, None, None)], (None, "api-error", None)),
    "unreadable body is a failure": ([(1, True, None, [GAIN]), (2, None, None, None)], ("gain", "api-error", 1)),
    "success and empty clears": ([(1, True, None, [GAIN]), (2, True, None, [])], (None, None, 2)),
    "success and irrelevant keeps": ([(1, True, None, [GAIN]), (2, True, None, [NOISE])], ("gain", None, 2)),
    "success and relevant replaces": ([(1, True, None, [GAIN]), (2, True, None, [PAY])], ("pay", None, 2)),
    "recovery clears the error": ([(1, False, "timeout", None), (2, True, None, [])], (None, None, 2)),
    "late poll does not win": ([(5, True, None, [PAY]), (3, True, None, [GAIN])], ("pay", None, 5)),
}


def transition_polls(spark):
    flat = [(name, ts, ok, why, txs and [_renamed(t, name) for t in txs]) for name, (steps, _) in TRANSITIONS.items() for ts, ok, why, txs in steps]
    return polls_df(spark, flat)


def _renamed(t, name):
    swap = lambda a: name if a == ME else a
    return {**t, "vin": [{"prevout": {"scriptpubkey_address": swap(i["prevout"]["scriptpubkey_address"]), "value": i["prevout"]["value"]}} for i in t["vin"]],
            "vout": [{"scriptpubkey_address": swap(o["scriptpubkey_address"]), "value": o["value"]} for o in t["vout"]]}


def as_dict(state):
    return {r["address"]: (r["alert"]["tx_hash"] if r["alert"] else None, r["reason"], r["last_ok_ts"]) for r in state.collect()}


WANT = {name: want for name, (_, want) in TRANSITIONS.items()}


def test_state_transitions_in_batch(spark):
    outcomes = watch.read_polls(transition_polls(spark))
    assert as_dict(watch.alert_state(outcomes)) == WANT
    for bucket in (F.lit(0), F.col("poll_ts")):
        history = watch.alert_history(outcomes, bucket)
        last = history.groupBy("address").agg(F.max_by(F.struct("alert", "reason", "last_ok_ts"), "poll_ts").alias("s")).select("address", "s.*")
        assert as_dict(last) == WANT


def test_state_as_a_stream_over_late_files(spark, tmp_path):
    """Polls land in arrival order, one file each, and the stream restarts half-way."""
    landing, listed = tmp_path / "landing", spark.createDataFrame([(n,) for n in TRANSITIONS] + [("idle",)], "address string")
    rows = transition_polls(spark)
    count = rows.count()
    for part in (rows.where(F.col("poll_id") < count // 2), rows.where(F.col("poll_id") >= count // 2)):
        part.repartition(4).write.mode("append").json(str(landing))
        stream = watch.stream_polls(spark, str(landing), max_files=2)
        watch.stream_alert_state(stream, str(tmp_path / "state"), str(tmp_path / "cp"), {"availableNow": True}, compact_every=2).awaitTermination()
    path = str(tmp_path / "list")
    state = lambda: as_dict(watch.read_alert_state(spark, str(tmp_path / "state"), path))
    assert state() == {}  # nobody is listed yet
    listed.withColumn("verdict", F.lit("watch")).write.parquet(path)
    assert state() == WANT
    spark.createDataFrame([("raise", "watch")], watchlist.WATCH_SCHEMA).write.mode("overwrite").parquet(path)
    assert set(state()) == {"raise"}
    assert len(watch.batch_folders(spark, str(tmp_path / "state"))) <= 2


def test_a_wallet_off_the_list_loses_its_state(spark, tmp_path):
    landing, path, sink = tmp_path / "landing", str(tmp_path / "list"), str(tmp_path / "state")
    rows = transition_polls(spark)
    put = lambda names: spark.createDataFrame([(n, "watch") for n in names], watchlist.WATCH_SCHEMA).write.mode("overwrite").parquet(path)
    kept = lambda: spark.read.parquet(sink).select("address").distinct().count()

    def poll(part):
        part.coalesce(1).write.mode("append").json(str(landing))
        stream = watch.stream_polls(spark, str(landing))
        watch.stream_alert_state(stream, sink, str(tmp_path / "cp"), {"availableNow": True}, compact_every=2, watchlist=path).awaitTermination()

    put(TRANSITIONS)
    poll(rows)
    assert kept() == len(TRANSITIONS) and as_dict(watch.read_alert_state(spark, sink, path)) == WANT
    put(["raise", "recovery clears the error"])
    later = rows.where("address = 'raise'").withColumn("poll_id", F.col("poll_id") + 100).withColumn("poll_ts", F.col("poll_ts") + 100)
    for i in range(2):
        poll(later.withColumn("poll_id", F.col("poll_id") + i))
    assert kept() == 2 and as_dict(watch.read_alert_state(spark, sink, path)) == {"raise": ("gain", None, 101), "recovery clears the error": WANT["recovery clears the error"]}
    put([*TRANSITIONS])  # back on the list they start anew
    assert set(as_dict(watch.read_alert_state(spark, sink, path))) == {"raise", "recovery clears the error"}


def test_alert_feed_follows_the_list_of_a_running_stream(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "list")
    rows = transition_polls(spark).where("address = 'raise'")
    landing.mkdir()
    feed = watch.stream_alerts(watch.stream_polls(spark, str(landing)), path, str(tmp_path / "alerts"), str(tmp_path / "cp"), {"processingTime": "100 milliseconds"})
    try:
        rows.coalesce(1).write.mode("append").json(str(landing))
        feed.processAllAvailable()
        spark.createDataFrame([("raise", "watch")], watchlist.WATCH_SCHEMA).write.parquet(path)
        rows.withColumn("poll_id", F.col("poll_id") + 1000).coalesce(1).write.mode("append").json(str(landing))
        feed.processAllAvailable()
        spark.createDataFrame([], watchlist.WATCH_SCHEMA).write.mode("overwrite").parquet(path)
        rows.withColumn("poll_id", F.col("poll_id") + 2000).coalesce(1).write.mode("append").json(str(landing))
        feed.processAllAvailable()
    finally:
        feed.stop()
    got = [r["poll_id"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()]
    assert got and all(1000 <= i < 2000 for i in got)


def test_unlisted_addresses_are_not_watched(spark):
    listed = spark.createDataFrame([("raise",)], "address string")
    assert watch.watched_polls(transition_polls(spark), listed).count() == 1


def test_watchlist_adds_once_without_regard_to_case(spark):
    listed = spark.createDataFrame([("1ABC", "watch")], "address string, verdict string")
    verdicts = spark.createDataFrame([("1abc", "confirmed"), ("x", "watch"), ("X", "watch"), ("y", "none")], "address string, verdict string")
    assert sorted(tuple(r) for r in watchlist.watchlist_insert(verdicts, listed).collect()) == [("1ABC", "watch"), ("X", "watch")]


def test_row_status(spark):
    rows = [("a", None, 1, "UNCONFIRMED TX", "checked"), (None, "timeout", None, "CHECK FAILED (timeout)", "never checked successfully"), (None, None, None, "Idle / Monitoring", "not yet polled")]
    df = spark.createDataFrame(rows, "alert string, reason string, ok long, s string, f string")
    s, f = status.poll_status(F.col("alert"), F.col("reason"), F.col("ok"))
    assert all(r[0] == r[2] and r[1] == r[3] for r in df.select(s, f, "s", "f").collect())


def test_failed_lookup_is_never_no_match(spark):
    df = spark.createDataFrame([("n", False), (None, False), (None, True)], "name string, failed boolean")
    got = [r[0] for r in df.select(status.attribution_status(F.col("name"), F.col("failed"))).collect()]
    assert got == ["matched", "no-match", "lookup-failed"]
