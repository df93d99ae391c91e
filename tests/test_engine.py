"""Trees, flows, choices, lookups, encodings and sources on small fixtures with known values."""

from enum import IntEnum

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeflow.functions import ExpressionError
from treeflow.functions.compiler import override
from treeflow.functions.timing import TimingLog
from treeflow.operators import choice, encoding, lookup
from treeflow.operators.nesting import NestingTree, construct_nesting_tree
from treeflow.operators.table import Table, concat_tables
from treeflow.plans import Flow, Node, Relationship, Tree
from treeflow.plans.tree import positions
from treeflow.sources import DataStore, ReadOnlyError, construct, from_arrow, from_matrices, from_parquet_3d
from treeflow.sources.spec import read_spec
from treeflow.sources.store import BlockTable
from treeflow.sources.tensors import read_node, release, share, write_node
from treeflow.streaming import apply_stream, write_stream


@pytest.fixture(scope="module")
def nodes(spark):
    c = spark.createDataFrame
    persons = [(441, 45, "Andre", 14, "Car", 11), (445, 88, "Bruce", 25, "Bus", 11), (552, 56, "Carol", 55, "Car", 22), (556, 15, "David", 8, "Car", 22), (934, 71, "Eugene", 21, "Walk", 33)]
    tours = [(4411, "Car", 441, 101, 102, "AM", 0, 1), (4451, "Bus", 445, 102, 103, "MD", 1, 2), (5521, "Car", 552, 103, 103, "AM", 2, 2), (5561, "Car", 556, 101, 101, "AM", 0, 0), (9341, "Walk", 934, 103, 102, "MD", 2, 1)]
    cells = [(101 + i // 3, 101 + i % 3, p, step * (i + 1)) for p, step in (("AM", 11.1), ("MD", 1.1)) for i in range(9)]
    return {
        "tours": Node.table("tours", c(tours, "tour_id long, TourMode string, person_id long, origin int, destination int, time_period string, oi int, di int"), "tour_id"),
        "persons": Node.table("persons", c(persons, "person_id long, Income int, Name string, Age int, WorkMode string, household_id long"), "person_id"),
        "households": Node.table("households", c([(11, 1), (22, 2), (33, 1)], "household_id long, n_cars int"), "household_id", unique=True),
        "skims": Node.tensor("skims", (("otaz", "dtaz", "timeperiod"), c(cells, "otaz int, dtaz int, timeperiod string, cartime double"))),
    }


LINKS = ["tours.person_id @ persons.person_id", "persons.household_id @ households.household_id", "tours.origin @ skims.otaz", "tours.destination @ skims.dtaz", "tours.time_period @ skims.timeperiod"]


@pytest.fixture(scope="module")
def tree(nodes):
    return Tree("tours", relationships=LINKS, **nodes)


def values(df, column="x", key="tour_id"):
    return [r[column] for r in df.orderBy(key).collect()]


def run(tree, expression, **options):
    return values(tree.setup_flow({"x": expression}, **{"dtype": "float64"} | options).load())


def test_lookups(tree):
    assert run(tree, "tours.TourMode == 'Bus'") == [0, 1, 0, 0, 0]
    assert run(tree, "WorkMode == 'Walk'") == [0, 0, 0, 0, 1]
    assert run(tree, "skims.cartime") == pytest.approx([22.2, 6.6, 99.9, 11.1, 8.8])
    assert run(tree, "skims.reverse('cartime')") == pytest.approx([44.4, 8.8, 99.9, 11.1, 6.6])
    assert run(tree, "skims.max('cartime')") == pytest.approx([44.4, 8.8, 99.9, 11.1, 8.8])
    assert run(tree, "n_cars + Age") == [15, 26, 57, 10, 22]


def test_positions_and_constants(nodes):
    t = Tree("tours", relationships=["tours.oi -> skims.otaz", "tours.di -> skims.dtaz"], tours=nodes["tours"], skims=nodes["skims"])
    assert run(t, "skims['cartime', 'AM']") == pytest.approx([22.2, 66.6, 99.9, 11.1, 88.8])
    with pytest.raises(KeyError):
        run(t, "skims.cartime")


def test_misses_and_duplicates(spark, nodes):
    persons = nodes["persons"].where("person_id <> 552")
    t = lambda policy: Tree("tours", relationships=LINKS[:1], on_missing=policy, tours=nodes["tours"], persons=persons)
    assert run(t("first"), "Age") == [14, 25, 14, 8, 21]
    assert run(t("null"), "Age") == [14, 25, None, 8, 21]
    with pytest.raises(Exception, match="no such label"):
        run(t("error"), "Age")
    twice = Node.table("persons", persons.frames[0].df.select("person_id", "Age", F.lit(0).alias("at")).unionByName(spark.createDataFrame([(441, 99, 1)], "person_id long, Age int, at int")), "person_id", order={"person_id": "at"})
    assert run(Tree("tours", relationships=LINKS[:1], tours=nodes["tours"], persons=twice), "Age")[0] == 99


def test_types_and_categories_of_keys(nodes):
    with pytest.raises(ValueError, match="cannot find"):
        run(Tree("tours", relationships=["tours.TourMode @ persons.person_id"], tours=nodes["tours"], persons=nodes["persons"]), "Age")
    a = Node.table("tours", nodes["tours"].frames[0].df, "tour_id", categories={"time_period": ("AM", "MD")})
    b = Node("skims", nodes["skims"].frames, categories={"timeperiod": ("AM", "PM")})
    with pytest.raises(ValueError, match="categories"):
        run(Tree("tours", relationships=LINKS[2:], tours=a, skims=b), "skims.cartime")


def test_missing_category_values(spark):
    df = spark.createDataFrame([(1, "Car"), (2, "Bus"), (3, "Walk"), (4, None)], "k int, m string")
    t = Tree("a", a=Node.table("a", df, "k"))
    go = lambda e: values(t.setup_flow({"x": e}, dtype="float64").load(), key="k")
    assert go("m == 'Bus'") == [0, 1, 0, 0]
    assert go("'Walk' == m") == [0, 0, 1, 0]
    assert go("m != 'Bus'") == [1, 0, 1, 1]
    assert go("m == 'BAD'") == [0, 0, 0, 0]
    assert go("(m != 'BAD') * 2") == [2, 2, 2, 2]
    assert go("np.exp(m == 'BAD') * 2.2") == [2.2] * 4
    assert go("m.isna()") == [0, 0, 0, 1]


def test_numbers(tree):
    assert run(tree, "Income / 0") == [float("inf")] * 5
    assert run(tree, "(Income - 60) // 7") == [-3, 4, -1, -7, 1]
    assert run(tree, "(Income - 60) % 7") == [6, 0, 3, 4, 4]
    assert run(tree, "(Income - 60) % -7") == [-1, 0, -4, -3, -3]
    assert run(tree, "log(Age - 8)")[3] == float("-inf")
    assert run(tree, "piece(Age, 10, 20)") == [4, 10, 10, 0, 10]
    assert run(tree, "hard_sigmoid(Age, 10, 20)") == pytest.approx([0.4, 1, 1, 0, 1])
    assert run(tree, "10 < Age <= 25") == [1, 1, 0, 0, 1]
    assert run(tree, "np.nan == Age") == [0] * 5


def test_definitions(tree):
    f = tree.setup_flow({"a": "Age / 3", "b": "a * 3", "odd name!": "b + 1"}, dtype="float32")
    assert values(f.load(), "odd name!") == pytest.approx([15, 26, 56, 9, 22])
    with pytest.raises(ValueError, match="itself"):
        tree.setup_flow({"zz": "zz"})
    with pytest.raises(KeyError):
        tree.setup_flow({"x": "unknown_thing + 1"})
    with pytest.raises(ExpressionError):
        tree.setup_flow({"x": "1 +"})
    with pytest.raises(ExpressionError):
        tree.setup_flow({"x": "Name + 1"})
    assert Flow.of(tree, {"x": "Age"}) is Flow.of(tree, {"x": "Age"})


def test_mask_and_shapes(tree):
    f = tree.setup_flow({"x": "Age"})
    masked = values(f.load(mask=F.col("__root_origin") == 101))
    assert [v == v for v in masked] == [True, False, False, True, False]
    with pytest.raises(TypeError):
        tree.setup_flow({"x": "Age"}, dtype="int32").load(mask=F.lit(True))
    assert f.load_dataarray().columns == ["tour_id", "expressions", "value"]
    assert f.init_streamer()(552 * 10 + 1).count() == 1
    with pytest.raises(NotImplementedError):
        f.dot([[[1.0]]])
    with pytest.raises(ValueError):
        f.dot([1.0, 2.0])


def test_only_needed_joins(tree):
    plan = tree.setup_flow({"x": "tours.origin + 1"}).load()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_catalog(tree, nodes):
    r = Relationship.parse("a.b -> c.d")
    assert (r.indexing, str(r)) == ("position", "a.b -> c.d")
    with pytest.raises(ValueError):
        Relationship.parse("a.b = c.d")
    with pytest.raises(ValueError):
        Relationship("a", "b", "c", "d", "nearest")
    assert "persons" in tree.to_dot() and tree.root == "tours" and set(tree.dims()) >= {"otaz", "tour_id"}
    with pytest.raises(KeyError):
        tree.replace_datasets(nowhere=nodes["tours"])
    small = tree.replace_datasets(tours=nodes["tours"].where("tour_id < 5000"))
    assert run(small, "Age") == [14, 25]
    fixed = Tree("tours", relationships=[*LINKS[:1], "tours.household_id @ households.household_id"], tours=nodes["tours"], persons=nodes["persons"], households=nodes["households"])
    assert "persons.household_id @ households.household_id" in fixed.list_relationships()
    with pytest.raises(KeyError):
        tree.get("nothing")
    assert tree.merged_dataset(["Age", "n_cars"]).columns == ["tour_id", "Age", "n_cars"]


def test_blending(spark):
    c = spark.createDataFrame
    walk = c([(100, 100, 0.01), (100, 101, 0.2), (100, 102, 0.3), (200, 201, 3.2)], "o int, d int, v double")
    zone = c([(m, 1 if m < 150 else 2) for m in (100, 101, 102, 103, 200, 201, 202)], "maz int, taz int")
    dense = c([(1, 1, 0.12), (2, 2, 0.17), (1, 2, 0.3), (2, 1, 0.3)], "otaz int, dtaz int, DISTWALK double")
    trips = c([(1, 100, 100), (2, 100, 101), (3, 100, 103), (4, 200, 201), (5, 200, 202)], "tour_id int, a int, b int")
    n = Node.tensor("skims", (("otaz", "dtaz"), dense)).redirected(zone, "maz", "taz", otaz="omaz", dtaz="dmaz").with_blend("DISTWALK", walk, "o", "d", "v", ("omaz", "dmaz"), 1.0)
    t = Tree("trips", relationships=["trips.a @ skims.omaz", "trips.b @ skims.dmaz"], trips=Node.table("trips", trips, "tour_id"), skims=n)
    assert run(t, "skims.DISTWALK") == pytest.approx([0.0111, 0.184, 0.12, 0.17, 0.17])
    assert run(t, "skims.DISTWALK.clip(upper=0.15)") == pytest.approx([0.0111, 0.15, 0.12, 0.15, 0.15])
    assert run(t, "skims.reverse('DISTWALK')") == pytest.approx([0.0111, 0.12, 0.12, 0.17, 0.17])
    bare = Node.tensor("skims", (("otaz", "dtaz"), dense)).redirected(zone, "maz", "taz", otaz="omaz", dtaz="dmaz").with_blend("JUMP", walk, "o", "d", "v", ("omaz", "dmaz"))
    t = Tree("trips", relationships=["trips.a @ skims.omaz", "trips.b @ skims.dmaz"], trips=Node.table("trips", trips, "tour_id"), skims=bare)
    assert run(t, "skims.JUMP") == pytest.approx([0.01, 0.2, 0, 3.2, 0])


def test_choices_and_nests(tree):
    f = tree.setup_flow({"age": "Age", "cars": "n_cars", "one": "1"}, dtype="float64")
    b = {"CAR": {"age": 0.02, "cars": 0.3}, "BUS": {"one": 0.2}, "WALK": {"age": -0.01}}
    flat = construct_nesting_tree(list(b), {"name": "root", "coefficient": 1.0, "alternatives": [{"name": "M", "coefficient": 1.0, "alternatives": ["CAR", "BUS"]}, "WALK"]})
    mnl = f.logit_draws(b, 3, probabilities=True, logsums=2, seed=1).orderBy("tour_id").collect()
    nl = f.logit_draws(b, 3, probabilities=True, logsums=2, seed=1, nesting=flat).orderBy("tour_id").collect()
    for x, y in zip(mnl, nl, strict=True):
        assert x["p_CAR"] + x["p_BUS"] + x["p_WALK"] == pytest.approx(1)
        assert (x["p_CAR"], x["logsum"], x["choice_0"]) == (pytest.approx(y["p_CAR"]), pytest.approx(y["logsum"]), y["choice_0"])
    assert f.logit_draws(b, 3, seed=1).orderBy("tour_id").collect() == f.logit_draws(b, 3, seed=1).orderBy("tour_id").collect()
    hit = f.logit_draws(b, [F.lit(0.0), F.lit(0.999999999), F.lit(1.0)]).orderBy("tour_id").first()
    assert (hit["choice_0"], hit["choice_1"], hit["choice_2"]) == (0, 2, 2)
    masked = f.logit_draws(b, 1, logsums=2, mask=F.lit(False)).first()
    assert (masked["choice_0"], masked["prob_0"], masked["logsum"]) == (-1, 0, 0)
    counts = f.logit_draws(b, 7, pick_counted=True).groupBy("tour_id").agg(F.sum("pick_count").alias("n")).collect()
    assert {r["n"] for r in counts} == {7}
    with pytest.raises(ValueError):
        f.logit_draws([1.0, 1.0, 1.0])


def test_nesting_tree():
    t = NestingTree(["CAR", "BUS", "WALK"])
    m = t.new_node([1, 2], name="MOTOR", parameter="mu")
    a = t.as_arrays({"mu": 0.5})
    assert a["n_nodes"] == 5 and a["n_alts"] == 3 and a["mu_params"] == [0.5, 1.0]
    assert a["edges_up"] == [3, 3, 4, 4] and a["edges_dn"] == [0, 1, 2, 3] and a["start_slots"] == [0, 2] and a["len_slots"] == [2, 2]
    assert NestingTree.from_dict(t.to_dict()) == t and "MOTOR" in t.description()
    with pytest.raises(ValueError):
        t.add_edge(0, 1)
    assert t.subgraph_from(m).elementals == [1, 2]
    t.remove_node(m)
    assert t.children(0) == [1, 2, 3]


def test_point_lookups(nodes):
    p = nodes["tours"].frames[0].df.select("tour_id", "origin", "destination", "oi", "di", "time_period", F.when(F.col("time_period") == "AM", 0).otherwise(1).alias("ti"))
    got = lookup.at(nodes["skims"], "cartime", p, otaz="origin", dtaz="destination", timeperiod="time_period")
    assert values(got, "cartime") == pytest.approx([22.2, 6.6, 99.9, 11.1, 8.8])
    got = lookup.iat(nodes["skims"], ["cartime"], p, append="v_", otaz="oi", dtaz="di", timeperiod="ti")
    assert values(got, "v_cartime") == pytest.approx([22.2, 6.6, 99.9, 11.1, 8.8])
    with pytest.raises(Exception, match="no such label"):
        lookup.at(nodes["skims"], "cartime", p.withColumn("origin", F.lit(7)), otaz="origin", dtaz="destination", timeperiod="time_period").collect()
    back = lookup.DatasetWrapper(nodes["skims"], "origin", "destination", "time_period").set_df(p).lookup("cartime", reverse=True)
    assert values(back, "cartime") == pytest.approx([44.4, 8.8, 99.9, 11.1, 6.6])


def test_encodings(spark):
    df = spark.createDataFrame([(1, 0.12, "a"), (2, 0.37, "b"), (3, None, None), (4, 0.28, "a")], "k int, v double, s string")
    f = encoding.fixed_point(df, "v", scale=0.01)
    assert [r["v"] for r in f.orderBy("k").collect()] == [12, 37, -1, 28]
    back = encoding.decode(f, "v")
    assert [r["v"] for r in back.orderBy("k").collect()] == pytest.approx([0.12, 0.37, None, 0.28])
    d = encoding.by_dictionary(df, "s")
    assert [r["s"] for r in d.orderBy("k").collect()] == [0, 1, -1, 0]
    assert [r["s"] for r in encoding.decode(d, "s").orderBy("k").collect()] == ["a", "b", None, "a"]
    coded, table = encoding.joint_dictionary(df, ["v", "s"], "both")
    assert table.count() == 4
    with pytest.raises(encoding.ValueDecodeError):
        encoding.decode(coded, "both_offsets")
    assert sorted(r["k"] for r in encoding.decode(coded, "both_offsets", table).collect()) == [1, 2, 3, 4]
    assert encoding.smash_bins([(1, 9), (2, 1), (3, 8), (10, 1)], 1) == [1, 10]
    cat = encoding.with_categories(df, "s", ["b", "a"])
    assert [r[0] for r in cat.orderBy("k").select(encoding.codes(cat, "s")).collect()] == [1, 0, -1, 1]
    with pytest.raises(encoding.ArrayIsNotCategoricalError):
        encoding.categories(df, "s")

    class M(IntEnum):
        Car = 1
        Bus = 2

    e = encoding.as_int_enum(spark.createDataFrame([("Car",), ("Car|Bus",)], "m string"), "m", M)
    assert sorted(r["m"] for r in e.collect()) == [1, 3] and encoding.categories(e, "m") == ["_0", "Car", "Bus"]


def test_tables(spark):
    t = Table.from_pydict(spark, {"a": [1, 2, 3], "b": [1.0, 2.0, 3.0]})
    assert [r["value"] for r in t.eval("a * 2 + b").orderBy("__row").collect()] == [3, 6, 9]
    assert t.eval("c = max(a, 2)").to_pandas()["c"].tolist() == [2, 2, 3]
    assert Table.concat([t, t]).to_pandas()["a"].tolist() == [1, 2, 3, 1, 2, 3]
    assert len(Table.of_length(spark, 4)) == 4
    with pytest.raises(ValueError):
        concat_tables([t.to_df(), t.to_df().select("a")])
    with pytest.raises(ValueError):
        t.append_column("a", 1, overwrite=False)
    with pytest.raises(ValueError):
        from_arrow(spark, pa.table({"a": [1, 2]}), index=[1, 1])
    assert construct(spark, ["x", "y"]).columns == ["x", "y"]


def test_wide_files(spark, tmp_path):
    rows = [(o, d, float(o * 1000 + d), o * 10.0 + d, o * 10 + d + 0.5) for o in (11, 22) for d in (11, 22)]
    spark.createDataFrame(rows, "o int, d int, DIST double, TIME__AM double, TIME__PM double").write.parquet(str(tmp_path / "a"))
    n = from_parquet_3d(spark, str(tmp_path / "a"), ("o", "d", "t"), time_periods=["AM", "MD", "PM"], check=True)
    three = next(f.df for f in n.frames if "t" in f.dims)
    assert {(r["o"], r["t"]): r["TIME"] for r in three.where("d = 22").collect()} == {(11, "AM"): 132, (11, "MD"): 0, (11, "PM"): 132.5, (22, "AM"): 242, (22, "MD"): 0, (22, "PM"): 242.5}
    with pytest.raises(ValueError):
        from_parquet_3d(spark, str(tmp_path / "a"), ("o", "d", "t"))
    with pytest.raises(KeyError):
        from_parquet_3d(spark, str(tmp_path / "a"), ("x", "d", "t"), time_periods=["AM"])
    with pytest.raises(KeyError):
        from_parquet_3d(spark, str(tmp_path / "a"), ("o", "d", "t"), time_periods=["AM"])
    m = from_matrices(spark, {"DIST": [[1, 2], [3, 4]]}, ("o", "d"))
    assert sorted((r["o"], r["d"], r["DIST"]) for r in m.frames[0].df.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)]
    with pytest.raises(ValueError):
        from_matrices(spark, {"DIST": [[1, 2]]}, ("o", "d"), labels=[1])


def test_nodes_as_folders(spark, nodes, tmp_path):
    write_node(nodes["skims"], f"file://{tmp_path}/n", partition_by="timeperiod")
    back = read_node(spark, f"file://{tmp_path}/n")
    assert back.dims == nodes["skims"].dims and back.frames[0].df.exceptAll(nodes["skims"].frames[0].df).count() == 0
    release(share(back))
    with pytest.raises(FileNotFoundError):
        read_node(spark, f"file://{tmp_path}/m")
    timing = TimingLog()
    with timing.step("a"):
        pass
    assert timing.seconds["a"] >= 0


def test_store(spark, tmp_path):
    s = DataStore(spark, f"file://{tmp_path}/s")
    s.set_data("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    s.make_checkpoint("one")
    s.update("t", spark.createDataFrame([(1, 10), (2, 20)], "k int, w int"))
    s.make_checkpoint("two")
    assert spark.read.parquet(f"file://{tmp_path}/s/t/two-*").columns == ["k", "w"]
    r = DataStore(spark, s.directory, mode="r")
    r.restore_checkpoint("two")
    assert sorted(map(tuple, r.get_dataframe("t").collect())) == [(1, "a", 10), (2, "b", 20)]
    with pytest.raises(ReadOnlyError):
        r.make_checkpoint("three")
    with pytest.raises(FileNotFoundError):
        r.restore_checkpoint("nine")
    with pytest.raises(FileExistsError):
        s.make_checkpoint("two", overwrite=False)
    # a second checkpoint under one name keeps what the first one wrote
    s.update("t", spark.createDataFrame([(1, 5), (2, 6)], "k int, x int"))
    s.make_checkpoint("two")
    for name, want in (("two", [(1, "a", 10, 5), (2, "b", 20, 6)]), ("one", [(1, "a"), (2, "b")])):
        again = DataStore(spark, s.directory)
        again.restore_checkpoint(name)
        assert sorted(map(tuple, again.get_dataframe("t").collect())) == want


def test_blocks_of_rows_and_columns_at_once(spark, tmp_path):
    blocks = BlockTable(spark, f"file://{tmp_path}/b")
    blocks.write(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "__row long, v string"), "first")
    both = [(0, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (3, "d", 4.0), (4, "e", 5.0)]
    blocks.write(spark.createDataFrame(both, "__row long, v string, w double"), "second")
    assert sorted(map(tuple, blocks.read().collect())) == both == sorted(map(tuple, blocks.read("second").collect()))
    assert blocks.read("first").columns == ["__row", "v"]
    blocks.write(spark.createDataFrame(both, "__row long, v string, w double"))
    assert len(blocks.blocks()) == 3


def test_positions(spark):
    for values, kind in (([3, None, 1, 2, 1], "int"), (["b", None, "ab", "a", "é", "longer than seven", "longer than seven bytes"], "string"), ([0.5, float("nan"), -1.0, None], "double"), ([True, False], "boolean"), ([], "int")):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, i int").repartition(3)
        got = positions(df, "v").orderBy("__pos").collect()
        order = lambda v: (v is not None, isinstance(v, float) and v != v, (v.encode() if isinstance(v, str) else v) if v is not None and v == v else 0)
        assert [(str(r["v"]), r["i"], r["__pos"]) for r in got] == [(str(v), i, p) for p, (v, i) in enumerate(sorted(zip(values, range(9)), key=lambda x: (order(x[0]), x[1])))]
    many = positions(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(5), "v")
    assert many.where("v <> __pos").count() == 0 and many.count() == 5000


def test_streamer_over_two_dims(spark):
    sides = [spark.createDataFrame([(i,) for i in range(4)], f"{d} int") for d in ("a", "b")]
    t = Tree("pairs", pairs=Node.product("pairs", ("a", sides[0]), ("b", sides[1])))
    stream = t.setup_flow({"x": "a * 10 + b"}, dtype="float64").init_streamer()
    assert [r["x"] for r in stream(2, 3).collect()] == [23.0]
    assert sorted(r["x"] for r in stream(1).collect()) == [10.0, 11.0, 12.0, 13.0]
    assert stream(9, 9).collect() == []
    with pytest.raises(ValueError):
        stream(1, 2, 3)


def test_override_marker():
    assert override("a + b  # note: adds things") == "a + b  # note: adds things"
    assert override("x == '# flow: no'") == "x == '# flow: no'"
    assert override("a  # flow: b + 1") == "b + 1" and override("a  # mine: b", "mine") == "b" and override("a  # flow: b", None) == "a  # flow: b"


def brute_smash(counts, bits):
    """One merge after another, each found by looking at all values."""
    n = dict(counts)
    while len(n) > 1 << bits:
        values = sorted(n)
        inner = [(n[v], v) for v in values[1:-1]]
        if not inner:
            break
        c, v = min(inner)
        i = values.index(v)
        near = values[i - 1] if v - values[i - 1] <= values[i + 1] - v else values[i + 1]
        n[near] += n.pop(v)
    return sorted(n)


def test_rare_values_merge(spark):
    import random

    rnd = random.Random(8)
    for _ in range(200):
        counts = [(v, rnd.randint(1, 6)) for v in rnd.sample(range(100), rnd.randint(1, 30))]
        assert encoding.smash_bins(counts, 3) == brute_smash(counts, 3)
    df = spark.createDataFrame([(i, i % 40) for i in range(200)], "k int, v int")
    coded = encoding.by_dictionary(df, "v", bitwidth=3)
    values = encoding.Encoding.of(coded, "v").values
    assert list(values) == brute_smash([(v, 5) for v in range(40)], 3)
    assert all(abs(values[r["v"]] - r["k"] % 40) == min(abs(x - r["k"] % 40) for x in values) for r in coded.collect())


def test_spec():
    s = read_spec("Label,Expression,A,B\nx,age + 1,0.5,coef\ny,one,,2\n", values={"coef": 3.0})
    assert s.definitions == {"x": "age + 1", "y": "one"} and s.coefficients == {"A": {"x": 0.5, "y": 0.0}, "B": {"x": 3.0, "y": 2.0}}
    with pytest.raises(KeyError):
        read_spec("Label,Expression,A\nx,1,who\n")


def test_stream(spark, tmp_path):
    from treeflow.queries import events_flow

    sf = "/root/testdata/sf0.001"
    flow = events_flow(spark, sf)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    q = write_stream(apply_stream(flow, stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(flow.load()).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == flow.load().count()
    with pytest.raises(ValueError):
        apply_stream(flow, spark.range(1))


def test_long_choices(spark):
    cells = Node.product("cells", ("who", spark.range(3).select(F.col("id").alias("who"))), ("alt", spark.range(4).select(F.col("id").alias("alt"))))
    t = Tree("cells", cells=cells)
    f = t.setup_flow({"u": "alt * who"}, dtype="float64")
    out = f.logit_draws([0.5], [F.lit(0.0), F.lit(0.999999999999), F.lit(1.0)]).collect()
    assert {(r["who"], r["draw"]): r["choice"] for r in out} == {(w, d): (0 if d == 0 else 3) for w in range(3) for d in range(3)}
    assert f.logit_draws([0.5], logsums=1).count() == 3
    # of who 1 all cells are masked, of who 0 and 2 the outer ones
    mask = (F.col("__root_who") != 1) & F.col("__root_alt").between(1, 2)
    out = f.logit_draws([0.5], [F.lit(0.0), F.lit(0.999999999999)], mask=mask, logsums=2).collect()
    assert {(r["who"], r["draw"]): r["choice"] for r in out} == {(0, 0): 1, (0, 1): 2, (1, 0): -1, (1, 1): -1, (2, 0): 1, (2, 1): 2}
    assert {r["who"]: (r["prob"], r["logsum"]) for r in out if r["who"] == 1} == {1: (0.0, 0.0)}
    counted = f.logit_draws([0.5], 5, mask=mask, pick_counted=True).groupBy("who").agg(F.sum("pick_count").alias("n")).collect()
    assert {r["who"]: r["n"] for r in counted} == {0: 5, 1: 0, 2: 5}
    assert {r["who"]: r["logsum"] for r in f.logit_draws([0.5], logsums=1, mask=F.lit(False)).collect()} == {0: 0.0, 1: 0.0, 2: 0.0}
    named = Tree("cells", cells=Node.product("cells", ("who", spark.range(2).select(F.col("id").alias("who"))), ("alt", spark.createDataFrame([("a",), ("b",)], "alt string"))))
    out = named.setup_flow({"u": "who * 1.0"}, dtype="float64").logit_draws([0.5], 1, mask=F.col("__root_who") == 0).collect()
    assert {r["who"]: r["choice"] is None for r in out} == {0: False, 1: True}


def test_branches_and_single_dim(tree):
    assert values(tree["persons"].Income, "persons_Income") == values(tree["persons.Income"], "persons_Income") == [45, 88, 56, 15, 71]
    assert values(tree["persons"]["Age"], "persons_Age") == [14, 25, 55, 8, 21]
    with pytest.raises(AttributeError):
        tree["persons"].nothing
    assert tree.nodes["persons"].single_dim == "person_id"
    with pytest.raises(ValueError):
        tree.nodes["skims"].single_dim


def test_utility_table(spark):
    both = choice.utility_to_probability(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), ["a", "b"]).first()
    assert both["p_a"] == pytest.approx(0.5)
