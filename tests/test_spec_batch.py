from ohlcflow.plans.batch import batch_scan, recipes_from_rows
from ohlcflow.plans.scan import report, scan, sort_results
from ohlcflow.plans.spec import ScanSpec, parse_recipe_text, recipe_text


def test_merge_precedence():
    recipe = {"min_price": 150.0, "sort": "volume", "trend_template": True, "min_adr": 2}
    s = ScanSpec(min_price=10.0).merge(recipe)
    assert s.min_price == 10.0 and s.min_adr == 2.0 and s.sort == "volume" and s.trend_template
    # defaults cannot override a recipe (the screener's rule)
    assert ScanSpec(trend_template=False, sort="symbol").merge(recipe).trend_template is True
    assert ScanSpec(sort="close").merge(recipe).sort == "close"


def test_to_map_drops_none_keeps_false():
    m = ScanSpec(min_price=150.0).to_map()
    assert m == {"min_price": 150.0, "trend_template": False, "sort": "symbol"}
    assert ScanSpec.from_map({"min_price": 150.0, "bogus": 1}).min_price == 150.0


def test_recipe_text_roundtrip():
    text = "min_price: 150.0\nsort: symbol\ntrend_template: false\n"
    m = parse_recipe_text(text)
    assert m == {"min_price": 150.0, "sort": "symbol", "trend_template": False}
    assert parse_recipe_text(recipe_text(ScanSpec.from_map(m))) == m


def test_sort_desc_nulls_first(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", None), ("C", 3.0), ("D", 3.0)], "symbol string, close double")
    assert [r.symbol for r in sort_results(df, "close").collect()] == ["B", "C", "D", "A"]
    assert [r.symbol for r in sort_results(df, "nope").orderBy("symbol").collect()] == ["A", "B", "C", "D"]


def test_report_zero_and_missing(spark, ref_fixtures):
    rows = report(scan(ref_fixtures["latest"], [])).collect()
    assert all(r.rvol_20 is None and r.sma_200 is None for r in rows)


def test_batch_equals_loop(small_bars, spark):
    recipes = [("a", ScanSpec(min_price=1000.0, min_relative_volume=0.8)),
               ("b", ScanSpec(min_adr=2.0)), ("c", ScanSpec(gap_up=1.0, min_volume=10.0)),
               ("d", ScanSpec(trend_template=True)), ("e", ScanSpec())]
    got = {(r.recipe, r.symbol) for r in batch_scan(small_bars, recipes).collect()}
    want = {(name, r.symbol) for name, spec in recipes for r in scan(small_bars, spec).collect()}
    assert got == want and len(got) > 0


def test_recipes_from_rows(spark):
    from ohlcflow.schema import RECIPE_SCHEMA
    df = spark.createDataFrame([("x", 10.0, None, None, None, None, True)], RECIPE_SCHEMA)
    [(name, spec)] = recipes_from_rows(df.collect())
    assert name == "x" and spec.min_price == 10.0 and spec.trend_template and spec.min_volume is None


def _random_recipes(n, seed):
    import random
    rng = random.Random(seed)
    some = lambda p, lo, hi: round(rng.uniform(lo, hi), rng.choice([0, 2])) if rng.random() < p else None
    rows = [(f"r{i}", some(.7, 900, 2200), some(.4, 0, 50), some(.5, 0, 2), some(.3, 0, 9), some(.4, -20, 90),
             rng.choice([True, False, None])) for i in range(n)]
    return rows + [("all", None, None, None, None, None, None), ("twice", 1000.0, None, None, None, None, False),
                   ("twice", 1000.0, None, None, None, None, False), ("none", float("nan"), None, None, None, None, False),
                   ("any volume", None, 1.0, None, None, None, None)]


def test_recipe_table_equals_loop(small_bars, spark, monkeypatch):
    """Thresholds of every kind, copies, several blocks: as one scan per recipe."""
    from ohlcflow.plans import recipe_index
    from ohlcflow.schema import RECIPE_SCHEMA
    monkeypatch.setattr(recipe_index, "BLOCK", 100)
    monkeypatch.setattr(recipe_index, "BUCKETS", 8)
    rows = _random_recipes(400, 3)
    got = sorted(map(str, recipe_index.batch_scan_table(small_bars, spark.createDataFrame(rows, RECIPE_SCHEMA)).select(
        "recipe", "symbol").collect()))
    snap = recipe_index.I.snapshot_with(small_bars, recipe_index.INDICATORS)
    trend = recipe_index.P.trend_template().condition
    bars = [r.asDict() for r in snap.withColumn("trend", trend).collect()]
    nan = lambda x: x != x

    def ge(v, t):
        return t is None or (v is not None and (nan(v) or (not nan(t) and v >= t)))

    want = []
    for name, price, volume, rvol, adr, gap, template in rows:
        for b in bars:
            if (ge(b["close"], price) and ge(b["volume"], volume) and ge(b["rvol_20"], rvol) and ge(b["adr_20"], adr)
                    and (gap is None or b["open"] > b["prev_high"] * (1.0 + gap / 100.0))
                    and (not template or b["trend"])):
                want.append(str((name, b["symbol"])))
    assert len(want) > 200
    assert got == sorted(f"Row(recipe={x.split(', ')[0][1:]}, symbol={x.split(', ')[1][:-1]})" for x in want)


def test_recipe_table_of_long_list_and_of_nothing(small_bars, spark):
    from ohlcflow.plans.recipe_index import batch_scan_table
    from ohlcflow.schema import RECIPE_SCHEMA
    recipes = [(f"r{i}", ScanSpec(min_price=900.0 + 60 * i, min_adr=float(i % 5), trend_template=i % 7 == 0))
               for i in range(20)]
    got = {(r.recipe, r.symbol) for r in batch_scan(small_bars, recipes).collect()}
    want = {(r.recipe, r.symbol) for r in batch_scan(small_bars, recipes[:10]).collect()}
    want |= {(r.recipe, r.symbol) for r in batch_scan(small_bars, recipes[10:]).collect()}
    assert got == want and got
    assert batch_scan_table(small_bars, spark.createDataFrame([], RECIPE_SCHEMA)).collect() == []
    assert batch_scan_table(small_bars.limit(0), spark.createDataFrame([("x", *[None] * 6)], RECIPE_SCHEMA)).collect() == []


def test_recipe_table_plan_does_not_grow(small_bars, spark):
    """The plan of 50 recipes and of 5,000 has the same operators and joins no table pairwise."""
    import re
    from ohlcflow.plans.recipe_index import batch_scan_table
    from ohlcflow.schema import RECIPE_SCHEMA
    texts = []
    for n in (50, 5000):
        df = batch_scan_table(small_bars, spark.createDataFrame(_random_recipes(n, 1), RECIPE_SCHEMA))
        texts.append(df._jdf.queryExecution().optimizedPlan().toString())
    nodes = [re.findall(r"^[ :+-]*([A-Z]\w+)", t, re.M) for t in texts]
    assert nodes[0] == nodes[1]
    assert abs(len(texts[0]) - len(texts[1])) < 0.1 * len(texts[0])


def test_recipe_table_exchanges_no_match(small_bars, spark):
    """Nothing behind the tasks that find the matches joins, sorts or moves them."""
    import re
    from ohlcflow.plans.recipe_index import batch_scan_table
    from ohlcflow.schema import RECIPE_SCHEMA
    df = batch_scan_table(small_bars, spark.createDataFrame(_random_recipes(300, 1), RECIPE_SCHEMA))
    nodes = re.findall(r"^[ :+*()0-9-]*([A-Z]\w+)", df._jdf.queryExecution().sparkPlan().toString(), re.M)
    assert not [n for n in nodes[:nodes.index("MapInArrow")] if re.search("Exchange|Join|Sort|Repartition", n)]


def test_recipe_blocks_equal_the_conditions_on_odd_values(spark, monkeypatch):
    """NULL, NaN, infinite, zero and negative values on both sides: as Spark's own comparisons."""
    import random
    import pyarrow as pa
    from pyspark.sql import functions as F
    from ohlcflow.plans import recipe_index
    rng = random.Random(5)
    monkeypatch.setattr(recipe_index, "NAMES", 50)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -100.0, -250.0, 1.0, 2.5, 100.0]
    some = lambda: rng.choice([*odd, *[None] * 8])
    recipes = [(f"r{i}", *[some() for _ in range(5)], rng.choice([None, 1.0])) for i in range(150)]
    value = lambda: rng.choice(odd)
    bars = [(f"s{i}", *[value() for _ in range(5)], rng.choice([0.0, 1.0]), value()) for i in range(200)]
    c = recipe_index.CRITERIA
    columns = ["name", *c]
    block = recipe_index._Block([pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in recipes],
                                                            pa.schema([("name", pa.string()), *[(x, pa.float64()) for x in c]]))])
    rows = pa.RecordBatch.from_pylist(
        [dict(zip([*columns, "prev_high"], b, strict=True)) | {"date": None, "volume": None} for b in bars],
        pa.schema([("name", pa.string()), *[(x, pa.float64()) for x in (*c, "prev_high")], ("date", pa.date32()), ("volume", pa.int64())]))
    got = {(s, r) for b in block.matches(rows) for s, names in zip(*[b.column(x).to_pylist() for x in ("symbol", "recipes")], strict=True)
           for r in names}
    left = spark.createDataFrame(recipes, "recipe string, " + ", ".join(f"{x} double" for x in c))
    right = spark.createDataFrame(bars, "symbol string, " + ", ".join(f"v_{x} double" for x in c) + ", prev_high double")
    tests = [F.col(x).isNull() | F.coalesce(F.col("v_gap_up") > F.col("prev_high") * (1.0 + F.col(x) / 100.0) if x == "gap_up"
                                            else F.col(f"v_{x}") >= F.col(x), F.lit(False)) for x in c]
    pairs = left.crossJoin(right)
    for t in tests:
        pairs = pairs.where(t)
    want = {(r.symbol, r.recipe) for r in pairs.collect()}
    assert got == want and len(want) > 200
