import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from conftest import make_bars, series
from ohlcflow.sources import ingest
from ohlcflow.sources import store as S


def test_save_load_list_overwrite(spark):
    root = tempfile.mkdtemp(prefix="store-")
    path = os.path.join(root, "bars")
    assert S.read_bars(spark, path).count() == 0
    a = series("AAA", "2024-01-01", [1.0, 2.0, 3.0])
    b = series("BBB", "2024-01-01", [5.0, 6.0])
    S.save_bars(make_bars(spark, a + b), path, buckets=1)
    bars = S.read_bars(spark, path)
    assert [r.symbol for r in S.list_symbols(bars).collect()] == ["AAA", "BBB"]
    # overwrite AAA only: BBB (same bucket) must survive
    S.save_bars(make_bars(spark, series("AAA", "2024-02-01", [9.0])), path, buckets=1)
    bars = S.read_bars(spark, path)
    assert S.load_symbol(bars, " aaa").count() == 1
    assert S.load_symbol(bars, "BBB").count() == 2
    assert S.read_symbol(spark, path, "bbb").count() == 2
    assert [r.date for r in S.head(bars, "BBB", 1).collect()] == [dt.date(2024, 1, 1)]
    req = spark.createDataFrame([("AAA",), ("ZZZ",)], "symbol string")
    assert [r.symbol for r in S.symbols_present(req, bars).collect()] == ["AAA"]
    assert [r.symbol for r in S.symbols_missing(req, bars).collect()] == ["ZZZ"]


def test_symbol_from_file_name(spark):
    d = tempfile.mkdtemp(prefix="perfile-")
    t = pa.table({"date": pa.array([dt.date(2024, 1, 1)], pa.date32()), "open": [1.0], "high": [2.0],
                  "low": [0.5], "close": [1.5], "volume": pa.array([10], pa.int64())})
    pq.write_table(t, os.path.join(d, "BRK.B.parquet"))
    pq.write_table(t, os.path.join(d, "MSFT.parquet"))
    got = sorted(r.symbol for r in S.read_symbol_files(spark, d).collect())
    assert got == ["BRK.B", "MSFT"]


def _landing():
    d = tempfile.mkdtemp(prefix="landing-")
    files = {
        "good.csv": "date,close,high,low,open,volume,adjClose\n2024-01-02,10,11,9,9.5,100,10\n"
                    "2024-01-03,12,13,11,11.5,200000000,12\n",
        "small.csv": "date,open,high,low,close,volume\n2024-01-02,1,1,1,1,5\n",
        "header.csv": "date,open,high,low,close,volume\n",
        "empty.csv": "",
        "baddate.csv": "date,open,high,low,close,volume\n2024-01-02,1,1,1,1,5\n2024-13-01,1,1,1,1,5\n",
    }
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    return d


def test_landing_parse_and_reject(spark):
    good, rejected = ingest.landing_bars(spark, _landing())
    rows = {(r.symbol, r.date): r for r in good.collect()}
    assert set(s for s, _ in rows) == {"GOOD", "SMALL"}
    g = rows[("GOOD", dt.date(2024, 1, 3))]
    assert (g.open, g.high, g.low, g.close, g.volume) == (11.5, 13.0, 11.0, 12.0, 200000000)
    assert {r.symbol for r in rejected.collect()} == {"HEADER", "EMPTY", "BADDATE"}


def test_sync_status_messages(spark):
    st = {r.symbol: r for r in ingest.sync_status(spark, _landing(), threshold=1e9).collect()}
    assert st["GOOD"].ok and st["GOOD"].message == "Synced"
    assert st["GOOD"].dollar_volume == 10 * 100 + 12 * 200000000
    assert st["SMALL"].message == "Synced (below threshold: $5)"
    for s in ("HEADER", "EMPTY", "BADDATE"):
        assert not st[s].ok and st[s].message == "Failed to fetch or empty data" and st[s].dollar_volume == 0.0


def test_universe_file(spark):
    d = tempfile.mkdtemp(prefix="universe-")
    p = os.path.join(d, "tickers.txt")
    with open(p, "w") as f:
        f.write(" aapl\n# etf\n\n\tMSFT \r\n#x\naapl\n")
    assert [r.symbol for r in ingest.read_universe(spark, p).orderBy("line").collect()] == ["AAPL", "MSFT", "AAPL"]


def test_timeframe_store(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tf-"), "bars")
    S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [1.0, 2.0])), path, buckets=2, timeframe="1d")
    S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [5.0])), path, buckets=2, timeframe="1w")
    assert S.read_timeframe(spark, path, "1d").count() == 2
    assert S.read_timeframe(spark, path, "1w").count() == 1
    S.save_bars(make_bars(spark, series("AAA", "2024-03-01", [7.0])), path, buckets=2, timeframe="1d")
    assert S.read_timeframe(spark, path, "1d").count() == 1
    assert S.read_timeframe(spark, path, "1w").count() == 1


def test_tail_table_scans_equal_full_store(spark, monkeypatch):
    from pyspark.sql import functions as F
    from conftest import SF_SMALL
    from ohlcflow.operators import indicators as I
    from ohlcflow.plans import predicates as P
    from ohlcflow.plans.scan import scan, scan_store
    from ohlcflow.sources.derived import bars_from_lineitem

    monkeypatch.setattr(S, "TAIL_ROWS", 400)   # below the ~530 bars per symbol of the fixture
    d = tempfile.mkdtemp(prefix="tail-")
    path = os.path.join(d, "bars")
    bars = bars_from_lineitem(spark, SF_SMALL)
    S.save_bars(bars, path, buckets=4)
    S.build_tail(spark, path)
    full = S.read_bars(spark, path)
    assert full.count() == bars.count()                      # the tail folder is hidden from the store
    tail = S.snapshot_bars(spark, path, 350)
    assert 0 < tail.count() < full.count()
    crit = [P.Predicate("all", (I.sma(50), I.extrema(252), I.rsi(2), I.atr(5), I.sma_200_1m_ago()),
                        lambda: F.lit(True))]

    def same(a, b):
        ra = sorted(a.collect(), key=lambda r: r.symbol)
        rb = sorted(b.select(*a.columns).collect(), key=lambda r: r.symbol)
        assert len(ra) == len(rb) == 10
        for x, y in zip(ra, rb):
            for c in a.columns:
                u, v = x[c], y[c]
                assert (u == v) or (isinstance(u, float) and abs(u - v) <= 1e-9 * max(1.0, abs(v))), (c, u, v)

    same(scan_store(spark, path, crit), scan(full, crit))
    # replacing one symbol's history (drop its last 30 bars) updates the tail too
    s1 = bars.where(F.col("symbol") == "S1")
    cut = s1.agg(F.max("date")).first()[0]
    shorter = s1.where(F.col("date") <= F.date_sub(F.lit(cut), 60))
    S.save_bars(shorter, path, buckets=4)
    full = S.read_bars(spark, path)
    same(scan_store(spark, path, crit), scan(full, crit))
    # a lookback beyond the tail falls back to the whole store
    assert S.snapshot_bars(spark, path, 5000).count() == full.count()


def test_large_landing_file_is_split_and_parsed_whole(spark):
    """A file larger than a split is read by several tasks; every line still gets its header."""
    d = tempfile.mkdtemp(prefix="landing-big-")
    start = dt.date(2000, 1, 1)
    lines = ["volume,close,date,open,high,low"]          # header order differs from the schema
    for i in range(3000):
        day = (start + dt.timedelta(days=i)).isoformat()
        lines.append(f"{100 + i},{10 + i % 7},{day},{9 + i % 7},{11 + i % 7},{8 + i % 7}")
    with open(os.path.join(d, "big.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = spark.read.format("text").load(d)
        assert raw.rdd.getNumPartitions() > 4
        good, rejected = ingest.landing_bars(spark, d)
        rows = good.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rejected.count() == 0
    assert len(rows) == 3000
    r = {x.date: x for x in rows}[start + dt.timedelta(days=10)]
    assert (r.symbol, r.open, r.high, r.low, r.close, r.volume) == ("BIG", 12.0, 14.0, 11.0, 13.0, 110)


def test_tail_table_of_a_timeframe_store(spark, monkeypatch):
    from conftest import SF_SMALL
    from ohlcflow.plans import predicates as P
    from ohlcflow.plans.scan import scan, scan_store
    from ohlcflow.sources.derived import bars_from_lineitem
    monkeypatch.setattr(S, "TAIL_ROWS", 400)
    path = os.path.join(tempfile.mkdtemp(prefix="tail-tf-"), "bars")
    bars = bars_from_lineitem(spark, SF_SMALL)
    S.save_bars(bars, path, buckets=4, timeframe="1d")
    S.save_bars(bars.limit(50), path, buckets=4, timeframe="1w")
    S.build_tail(spark, path)
    crit = [P.trend_template()]
    a = sorted(r.symbol for r in scan_store(spark, path, crit, timeframe="1d").collect())
    b = sorted(r.symbol for r in scan(S.read_timeframe(spark, path, "1d"), crit).collect())
    assert a == b
    assert S.snapshot_bars(spark, path, 300, "1d").select("symbol", "date").distinct().count() == \
        S.snapshot_bars(spark, path, 300, "1d").count()


def test_store_names_buckets_and_missing_symbols(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="store-"), "bars")
    S.save_bars(make_bars(spark, series("aapl ", "2024-01-01", [1.0, 2.0]) + series("MSFT", "2024-01-01", [5.0])),
                path, buckets=8)
    # the count is remembered, another one refused, and a symbol's history never doubles
    S.save_bars(make_bars(spark, series("AAPL", "2024-03-01", [3.0])), path)
    with pytest.raises(ValueError):
        S.save_bars(make_bars(spark, series("AAPL", "2024-03-01", [3.0])), path, buckets=64)
    assert [r.close for r in S.read_symbol(spark, path, "aapl").collect()] == [3.0]
    plan = S.read_symbol(spark, path, "AAPL")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    with pytest.raises(KeyError):
        S.read_symbol(spark, path, "NONE")
    with pytest.raises(FileNotFoundError):
        S.read_symbol(spark, path + "-none", "AAPL")
    assert S.read_symbol_files(spark, path + "-none").count() == 0


def test_timeframe_must_be_named(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tf-"), "bars")
    S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [1.0, 2.0])), path, buckets=2, timeframe="1d")
    for read in (lambda: S.read_bars(spark, path), lambda: S.read_symbol(spark, path, "AAA"),
                 lambda: S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [1.0])), path)):
        with pytest.raises(ValueError):
            read()


def test_intraday_store_keeps_the_time(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="intraday-"), "bars")
    rows = [("AAA", dt.datetime(2024, 1, 2, 9, 30 + 15 * i % 60 if i < 2 else 0 if i == 2 else 15), 1.0, 2.0, 0.5, 1.5, 10)
            for i in range(2)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, "
                                       "close double, volume long")
    S.save_bars(bars, path, buckets=2, timeframe="15min")
    got = S.read_symbol(spark, path, "AAA", "15min").collect()
    assert [r.ts for r in got] == [r[1] for r in rows]
    S.build_tail(spark, path)
    assert S.snapshot_bars(spark, path, 5, "15min").count() == 2


def test_stale_tail_is_not_read(spark, monkeypatch):
    path = os.path.join(tempfile.mkdtemp(prefix="stale-"), "bars")
    S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [1.0] * 30)), path, buckets=2)
    S.build_tail(spark, path)
    # a save that dies after the store and before the tail
    def fail(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(S, "tail_of", lambda *a, **k: fail())
    with pytest.raises(RuntimeError):
        S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [2.0] * 31)), path)
    assert {r.close for r in S.snapshot_bars(spark, path, 5).collect()} == {2.0}


def test_quoted_fields_and_bad_numbers(spark):
    d = tempfile.mkdtemp(prefix="landing-")
    files = {"q.csv": '"date","open","high","low","close","volume","note"\n"2024-01-02","1","2","0.5","1.5","10","a, b"\n',
             "bad.csv": "date,open,high,low,close,volume\n2024-01-02,1,2,0.5,abc,10\n2024-01-03,1,2,0.5,1,10\n",
             "part.csv": "date,open,high,low,close\n2024-01-02,1,2,0.5,1\n",
             "none.csv": "date,open,high,low,close,volume\n2024-01-02,1,2,0.5,,10\n"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    good, rejected = ingest.landing_bars(spark, d)
    assert sorted((r.symbol, r.close) for r in good.collect()) == [("NONE", None), ("Q", 1.5)]
    assert {(r.symbol, r.reason) for r in rejected.collect()} == {("BAD", "bad_close"), ("PART", "bad_volume")}


def _write(files, d=None):
    d = d or tempfile.mkdtemp(prefix="landing-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    return d


def test_records_across_lines_and_splits(spark):
    """Random quoting over files cut into many splits: the records of Python's csv module."""
    import csv
    import random
    from pyspark.sql import functions as F
    from ohlcflow.sources.records import read_lines, records
    rng = random.Random(11)
    cells = lambda: rng.choice(["", "1.5", "x", '"a"', '"a,b"', '"a\nb"', '"a""b"', '"a""\n\n,""b"', '5"', '"\n"', '""', '""""'])
    files = {}
    for k in range(12):
        lines = [",".join(cells() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 400))]
        files[f"f{k}.csv"] = "\n".join(x for x in lines if x.strip()) + rng.choice(["", "\n"])
    files["plain.csv"] = "a,b\n1,2\n\n3,4\n"
    d = _write(files)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = records(read_lines(spark, d, "*.csv")).select(
            F.regexp_extract("_path", r"([^/]+)$", 1).alias("f"), "_at", "_text", "_broken").orderBy("f", "_at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in files.items():
        got = [r._text for r in rows if r.f == name]
        want = [r for r in csv.reader(text.splitlines(True)) if r]
        assert [next(csv.reader(x.splitlines(True))) for x in got] == want, name
        assert not any(r._broken for r in rows)


def test_lines_in_quotes_many_columns_and_broken_quotes(spark):
    head = ",".join(f"extra{i}" for i in range(300)) + ",date,open,high,low,close,volume,note\n"
    line = lambda day, note: ",".join(["e"] * 300) + f",{day},1,2,0.5,1.5,10,{note}\n"
    d = _write({
        "wide.csv": head + line("2024-01-02", "x"),
        "multi.csv": 'date,"no\nte",open,high,low,close,volume\n2024-01-02,"a\n2024-01-03,9,9,9,9,9\n",1,2,0.5,1.5,10\n'
                     '2024-01-04,"""q"", \r\nz",1,2,0.5,2.5,10\n\n',
        "stray.csv": 'date,note,open,high,low,close,volume\n2024-01-02,5" disk,1,2,0.5,1.5,10\n',
        "open.csv": 'date,note,open,high,low,close,volume\n2024-01-02,x,1,2,0.5,1.5,10\n'
                    '2024-01-03,"never closed,1,2,0.5,1.5,10\n2024-01-04,x,1,2,0.5,1.5,10\n',
        "A+B C.csv": head + line("2024-01-05", '"y"'), "none.csv": ""})
    good, rejected = ingest.landing_bars(spark, d)
    got = sorted((r.symbol, str(r.date), r.close) for r in good.collect())
    assert got == [("A+B C", "2024-01-05", 1.5), ("MULTI", "2024-01-02", 1.5), ("MULTI", "2024-01-04", 2.5),
                   ("STRAY", "2024-01-02", 1.5), ("WIDE", "2024-01-02", 1.5)]
    assert {(r.symbol, r.reason) for r in rejected.collect()} == {("OPEN", "bad_date"), ("NONE", "empty")}


def test_increments_read_only_new_files(spark, monkeypatch):
    bar = "date,open,high,low,close,volume\n2024-01-02,1,2,0.5,{},10\n"
    d = _write({"a.csv": bar.format(1), "b.csv": bar.format(2), "empty.csv": ""})
    store = os.path.join(tempfile.mkdtemp(prefix="incr-"), "bars")
    status = lambda: {r.symbol: r.ok for r in ingest.sync_increment(spark, d, store).collect()}
    assert status() == {"A": True, "B": True, "EMPTY": False}
    assert status() == {}
    _write({"c.csv": bar.format(3), "b.csv": bar.format(25)}, d)
    with monkeypatch.context() as m:  # a call that dies before the save is repeated by the next
        m.setattr(ingest, "save_bars", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            status()
    assert status() == {"B": True, "C": True}
    assert {r.symbol: r.close for r in S.read_bars(spark, store).collect()} == {"A": 1.0, "B": 25.0, "C": 3.0}
    assert status() == {}


def test_files_under_their_names_are_written_by_the_tasks(spark, monkeypatch):
    """One file a value, also where a value spans batches; the driver calls no file system for them."""
    from ohlcflow.sources import files
    rows = [("A", "1"), ("A", "2"), ("A", "3"), ("B%2", "é"), ("B%2", None), (None, "n"), ("", "m")]
    df = spark.createDataFrame(rows, "file string, value string").repartition(1).sortWithinPartitions("file")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    monkeypatch.setattr(type(df), "write", None)
    try:
        d = tempfile.mkdtemp(prefix="named-")
        files.write_files(df.where("coalesce(file, '') != ''"), f"file://{d}", ".csv")
        files.write_files(df.where("file IS NULL"), d, ".csv")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {n: open(os.path.join(d, n), encoding="utf-8").read() for n in os.listdir(d)}
    assert got == {"A.csv": "1\n2\n3\n", "B%252.csv": "é\n\n", "__HIVE_DEFAULT_PARTITION__.csv": "n\n"}


def test_stem_of_a_path(spark):
    from ohlcflow.sources.files import stem
    paths = ["file:/a.csv/b/BRK.B.csv", "/x/.csv", "/x/y.txt", "z.csv", "/x/z.csv/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(stem(F.col("p"), ".csv").alias("s"))
    assert [r.s for r in df.collect()] == ["BRK.B", "", "", "z", ""]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_second_save_writes_its_symbols(spark, tmp_path):
    """The joins with the store read a written table of symbols, not the new bars again."""
    from ohlcflow.sources import store
    names, written = [], store.scratch_table
    store.scratch_table = lambda df, name: names.append((name, df.columns)) or written(df, name)
    try:
        S.save_bars(make_bars(spark, series("AAA", "2024-01-01", [1.0]) + series("BBB", "2024-01-01", [2.0])), str(tmp_path), buckets=1)
        S.save_bars(make_bars(spark, series("AAA", "2024-01-02", [3.0])), str(tmp_path))
    finally:
        store.scratch_table = written
    assert ("store-symbols", ["bucket", "symbol"]) in names
    assert sorted((r.symbol, r.close) for r in S.read_bars(spark, str(tmp_path)).collect()) == [("AAA", 3.0), ("BBB", 2.0)]


def test_bars_move_only_columns_of_the_table(spark):
    from conftest import SF_SMALL
    from ohlcflow.sources.derived import bars_from_lineitem
    plan = bars_from_lineitem(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "struct(" not in below and "concat(" not in below


def _odd_landing(spark, seed=7):
    """Files of odd records under a random header, with bad, short and unclosed ones, and some a field too long."""
    import random
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "1.5", " 2 ", "x", '"3"', '"a,b"', '"a\nb"', '"a""b"', '5"', '""', '""""', ' "4" ', '"5" ', '"a" b', "\t6"])
    fields, made = ["date", "open", "high", "low", "close", "volume"], {}
    for k in range(40):
        head = [f'"{x}"' if rng.random() < .3 else x.upper() if rng.random() < .3 else x for x in fields[:rng.choice([5, 6, 6, 6])]]
        head += [rng.choice(['n', '"n,m"', '"n\nm"', "date"]) for _ in range(rng.randint(0, 4))]
        rng.shuffle(head)
        rows, odd = [",".join(head)], rng.choice([0, 0, .1, .5])
        for i in range(rng.randint(0, 60)):
            row = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" if x.strip('"').lower() == "date" else
                   cell() if rng.random() < odd or x.strip('"').lower() not in fields else rng.choice([f"{i}.25", f'"{i}"', f" {i}"]) for x in head]
            rows.append(",".join(row[:rng.choice([99, 99, len(row) - 1])] + ["z"] * (rng.random() < .03)))
            rows += [rng.choice(["", "  "])] * (rng.random() < .1)
        made[f"f{k}.csv"] = rng.choice(["\n", "\r\n", "\r"]).join(rows) + rng.choice(["", "\n", '\n"open'])
    made |= {"A[1]{x}*.csv": made["f1.csv"], "bom.csv": "\ufeff" + made["f2.csv"], "none.csv": "", "blank.csv": "\n \n", "_hidden.csv": "x",
             "F3.csv": made["f3.csv"], "é ü%20.csv": made["f4.csv"], "other.txt": "x"}
    d = tempfile.mkdtemp(prefix="landing-")
    for name, text in made.items():
        with open(os.path.join(d, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return d


def test_whole_files_read_as_split_ones(spark, monkeypatch):
    """Files that a task reads whole give the rows that Spark's text source and parser give."""
    from ohlcflow.sources import small_files
    d = _odd_landing(spark)
    rows = lambda: sorted(map(str, ingest.read_landing(spark, d).collect()))
    monkeypatch.setattr(small_files, "ROWS", 7)
    whole = rows()
    monkeypatch.setattr(small_files, "WHOLE", 0)
    split = rows()
    monkeypatch.setattr(ingest, "local_folder", lambda *_: None)
    assert whole == split == rows()
    assert len(whole) > 500 and any("bad=None" in x for x in whole)


def test_quotes_by_pieces_equal_the_patterns(spark):
    import random
    from ohlcflow.sources import small_files
    from ohlcflow.sources.records import ends_inside
    rng = random.Random(2)
    lines = ["".join(rng.choice('"",a \t') for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(
        "x", ends_inside(F.col("x"), False).alias("a"), ends_inside(F.col("x"), True).alias("b")).collect()
    assert all((r.a, r.b) == tuple(small_files.inside_behind(r.x.encode(), i) for i in (False, True)) for r in got)


def test_landing_records_are_parsed_once_without_joins(spark):
    """Small files: no window over lines, no join of records, one parse."""
    import re
    line = '2024-01-02,1,2,0.5,1.5,10,"a\nb"\n'
    d = _write({f"s{i}.csv": "date,open,high,low,close,volume,note\n" + line * 3 for i in range(50)})
    df = ingest.read_landing(spark, d)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and len(re.findall(r"Join", plan)) == 1  # of the listed symbols without a record
    assert len(re.findall("MapInArrow", plan)) == 1 and df.count() == 150


def test_increments_keep_no_file_names_in_the_driver(spark, monkeypatch):
    """A local folder is listed and read by tasks; no source of Spark indexes its files in the driver."""
    bar = "date,open,high,low,close,volume\n2024-01-02,1,2,0.5,{},10\n"
    d = _write({f"s{i}.csv": bar.format(i) for i in range(300)} | {"empty.csv": ""})
    monkeypatch.setattr(type(spark.range(1)), "inputFiles", lambda *_: 1 / 0)
    monkeypatch.setattr(type(spark.read), "text", lambda *_: 1 / 0)
    store = os.path.join(tempfile.mkdtemp(prefix="incr-"), "bars")
    status = lambda: {r.symbol: r.ok for r in ingest.sync_increment(spark, d, store).collect()}
    assert status() == {f"S{i}": True for i in range(300)} | {"EMPTY": False}
    _write({"s7.csv": bar.format(77), "new.csv": bar.format(1)}, d)
    assert status() == {"S7": True, "NEW": True}
    assert S.read_bars(spark, store).count() == 301
