import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tristrata.operators import profiling
from tristrata.operators.profiling import discover_fks, discover_keys, profile_columns, same_meaning
from tristrata.plans.build import build_model, run_model
from tristrata.plans.propose import classify, column_frame, edge_frame, find_tables, propose_model, scd_type, two_hop_frame
from tristrata.plans.specs import (
    DimensionSpec, FactSpec, ForeignKey, GoldSpec, KeyPath, Metric, ModelSpec, TableSpec,
)


@pytest.fixture(scope="module")
def shop(spark):
    n = 30
    return {
        "customers": spark.createDataFrame([(i, f"c{i}", "US") for i in range(n)],
                                           "customer_id int, company_name string, country string"),
        "products": spark.createDataFrame([(100 + i, f"p{i % 7}", 1.5 * i) for i in range(n)],
                                          "product_id int, product_name string, unit_price double"),
        "orders": spark.createDataFrame(
            [(1000 + i, i % 20, f"2024-0{1 + i % 3}-01", float(i)) for i in range(n)],
            "order_id int, customer_id int, order_date string, freight double",
        ).withColumn("order_date", F.col("order_date").cast("date")),
        "order_details": spark.createDataFrame(
            [(1000 + i, 100 + (i + j) % 15, j, 2.0) for i in range(n) for j in range(3)],
            "order_id int, product_id int, quantity int, unit_price double"),
    }


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", [1]), (2, None, [1]), (2, "a", None)], "n int, s string, l array<int>")
    for exact in (True, False):
        assert rows(profile_columns("t", df, exact), "column_name", "data_type", "row_count", "null_count",
                    "distinct_count", "min_value", "max_value") == [
            ("l", "array<int>", 3, 1, 1, None, None), ("n", "int", 3, 0, 2, "1", "2"), ("s", "string", 3, 1, 2, "a", "b")]


def test_keys(spark, shop):
    assert discover_keys(shop["customers"]) == [("customer_id",), ("company_name",)]
    assert discover_keys(shop["order_details"]) == [("order_id", "product_id"), ("order_id", "quantity")]
    df = spark.createDataFrame([(a, b, c, 0) for a in range(3) for b in range(3) for c in range(3)],
                               "a int, b int, c int, d int")
    assert discover_keys(df) == [("a", "b", "c")]
    assert discover_keys(df, 2) == []
    assert discover_keys(df.limit(0)) == []
    nullable = spark.createDataFrame([(1, None), (2, 1), (2, 2)], "a int, b int")
    assert discover_keys(nullable) == []


def found_edges(df):
    return rows(df.filter("rank = 1"), "child_table", "child_column", "parent_table", "parent_column", "evidence")


@pytest.mark.parametrize("bits", [62, 2])
def test_inclusions_by_brute_force(spark, shop, monkeypatch, bits):
    """Whatever number of masks the columns need, every inclusion and nothing else is found."""
    monkeypatch.setattr(profiling, "MASK_BITS", bits)
    keys = {n: discover_keys(df, 1) for n, df in shop.items()}
    found = discover_fks(shop, keys)
    values = {(n, f.name): {r[0] for r in df.select(f.name).distinct().collect()}
              for n, df in shop.items() for f in df.schema if f.dataType.simpleString() in ("int", "string")}
    expected = sorted((*c, *p) for c in values for p in values
                      if c != p and (p[1],) in keys[p[0]] and values[c] <= values[p])
    assert sorted(tuple(r) for r in found.select("child_table", "child_column", "parent_table", "parent_column").collect()
                  ) == expected
    edges = found_edges(found)
    assert ("orders", "customer_id", "customers", "customer_id", "name") in edges
    assert ("order_details", "product_id", "products", "product_id", "name") in edges
    assert ("order_details", "quantity", "customers", "customer_id", "containment only") in edges


def test_names_that_mean_the_same():
    assert same_meaning("l_orderkey", "orders", "o_orderkey") and same_meaning("customer_id", "customers", "customer_id")
    assert same_meaning("customer_id", "customers", "id") and not same_meaning("user_id", "customer", "c_custkey")


def tables(**links):
    """Table specifications from ``child='column>parent ...'``."""
    return {n: TableSpec(("id",), tuple(ForeignKey((c,), p, ("id",)) for c, p in (x.split(">") for x in text.split())))
            for n, text in links.items()}


def roles_of(spark, specs, overrides=None, **schemas):
    sources = {n: spark.createDataFrame([], schemas.get(n, "id int, " + ", ".join(
        [f"{c} int" for c in specs[n].fk_columns] + ["a string", "b string"]))) for n in specs}
    got = classify(column_frame(sources, specs), edge_frame(spark, specs), overrides)
    return {r["table_name"]: (r["role"], r["confidence"]) for r in got.collect()}


def test_roles(spark):
    specs = tables(doctor="", department="", patient="doctor_id>doctor", assigned="patient_id>patient dept_id>department",
                   works="doctor_id>doctor dept_id>department", treatment="patient_id>patient doctor_id>doctor",
                   bill="treatment_id>treatment patient_id>patient", codes="", lone="patient_id>patient",
                   log="", visit="patient_id>patient doctor_id>doctor", note="visit_id>visit")
    got = roles_of(
        spark, specs, {"codes": "dimension"},
        assigned="id int, patient_id int, dept_id int, date_assign date, room int",
        works="id int, doctor_id int, dept_id int", treatment="id int, patient_id int, doctor_id int, start date",
        log="id int, happened timestamp, amount double",
        visit="id int, patient_id int, doctor_id int, created_at timestamp, a string")
    assert got == {
        "doctor": ("dimension", 3), "department": ("dimension", 3), "patient": ("dimension", 2), "assigned": ("fact", 3),
        "works": ("bridge", 3), "treatment": ("fact", 2), "bill": ("fact", 3), "codes": ("dimension", 3),
        "lone": ("dimension", 1), "log": ("fact", 3), "visit": ("dimension", 2), "note": ("dimension", 1)}


def test_dated_bridge_is_a_fact(spark):
    specs = tables(a="", b="", link="x>a y>b")
    assert roles_of(spark, specs, link="id int, x int, y int, at_date date")["link"] == ("bridge", 3)
    assert roles_of(spark, specs, link="id int, x int, y int, paid double")["link"] == ("bridge", 3)


def test_two_hops(spark):
    specs = tables(film="", store="", staff="", inventory="film_id>film store_id>store created_by>staff",
                   rental="inventory_id>inventory staff_id>staff", payment="rental_id>rental staff_id>staff")
    roles = spark.createDataFrame([("film", "dimension"), ("store", "dimension"), ("staff", "dimension"),
                                   ("inventory", "dimension"), ("rental", "fact")], "table_name string, role string")
    paths = rows(two_hop_frame(edge_frame(spark, specs), roles), "child_table", "via_table", "carried_column")
    assert paths == [("payment", "rental", "inventory_id"), ("rental", "inventory", "film_id"),
                     ("rental", "inventory", "store_id")]


def test_scd_type():
    assert [scd_type(t) for t in ("dim_customers", "suppliers", "products", "order_status")] == [2, 2, 1, 1]


def test_proposed_model(shop):
    proposal = propose_model(shop, overrides={"orders": "fact"})
    assert {r["table_name"]: r["role"] for r in proposal.roles.collect()} == {
        "customers": "dimension", "products": "dimension", "orders": "fact", "order_details": "fact"}
    model = proposal.model
    assert [(d.name, d.scd_type) for d in model.dimensions] == [("dim_customers", 2), ("dim_products", 1)]
    details = model.fact("fct_order_details")
    assert details.dimension_keys == ("order_id", "product_id") and details.measures == ("quantity", "unit_price")
    assert [p.alias for p in details.key_paths] == ["customer_id"]
    gold = {g.fact: g for g in model.gold}["fct_order_details"]
    assert gold.dimensions == ("product_id",) and gold.date == "orders_order_date"
    assert [m.name for m in gold.metrics] == ["total_quantity", "total_unit_price", "row_count", "order_id_count"]
    built = build_model(shop, model, "2024-01-01 00:00:00")
    total = built.tables[gold.name].agg(F.sum("row_count"), F.sum("total_unit_price")).first()
    assert tuple(total) == (90, 180.0)
    assert built.checks("2024-01-01 00:00:00").filter("status <> 'pass'").count() == 0


def test_partition_children_follow_their_parent(shop):
    sources = {"customers": shop["customers"], "orders": shop["orders"], "orders_2024": shop["orders"], "x_1": shop["orders"]}
    proposal = propose_model(sources, partition_children={"orders_2024": "orders", "x_1": "unknown"})
    roles = {r["table_name"]: r["role"] for r in proposal.roles.collect()}
    assert roles["orders_2024"] == roles["orders"] and roles["x_1"] == "fact"
    assert {d.source for d in proposal.model.dimensions} | {f.source for f in proposal.model.facts} == {"customers", "orders"}


def shop_model():
    to_orders = ForeignKey(("order_id",), "orders", ("order_id",))
    specs = {
        "customers": TableSpec(("customer_id",)), "products": TableSpec(("product_id",)),
        "orders": TableSpec(("order_id",), (ForeignKey(("customer_id",), "customers", ("customer_id",)),)),
        "order_details": TableSpec(("order_id", "product_id"),
                                   (to_orders, ForeignKey(("product_id",), "products", ("product_id",)))),
        "product_tags": TableSpec((), (ForeignKey(("product_id",), "products", ("product_id",)),
                                       ForeignKey(("order_id",), "orders", ("order_id",)))),
    }
    return ModelSpec(
        specs, (DimensionSpec("dim_customers", "customers", 2), DimensionSpec("dim_products", "products")),
        (FactSpec("fct_order_details", "order_details", ("order_id", "product_id"), ("quantity",),
                  key_paths=(KeyPath(to_orders, "customer_id", "customer_id"),)),
         FactSpec("fct_orders", "orders", ("customer_id",), ("freight",))),
        (GoldSpec("agg", "fct_order_details", "monthly", (), (Metric("n", "COUNT"), Metric("q", "SUM", "quantity"))),
         GoldSpec("agg", "fct_orders", "daily", (), (Metric("n", "COUNT"),))))


def test_stored_model_over_two_runs(spark, shop, tmp_path):
    sources = shop | {"product_tags": shop["order_details"].select("product_id", "order_id").distinct()}
    root = str(tmp_path)
    first = run_model(spark, sources, shop_model(), root, "2024-04-01 00:00:00")
    assert set(first.tables) == {"dim_customers", "dim_products", "fct_order_details", "fct_orders", "bridge_product_tags",
                                 "agg_fct_order_details".replace("fct_", ""), "agg_orders"}
    assert first.tables["bridge_product_tags"].columns == ["order_id", "product_id"]
    moved = shop["customers"].withColumn("country", F.when(F.col("customer_id") == 3, "FR").otherwise(F.col("country")))
    late = shop["orders"].withColumn("freight", F.lit(99.0))
    second = run_model(spark, sources | {"customers": moved, "orders": late}, shop_model(), root, "2024-05-01 00:00:00")
    dim = second.tables["dim_customers"]
    assert dim.count() == 31 and dim.filter("is_current").count() == 30
    assert rows(dim.filter("customer_id = 3"), "country", "is_current") == [("FR", True), ("US", False)]
    # Only orders of the last seven days before the newest (March 1st) were taken again.
    changed = second.tables["fct_orders"].filter("freight = 99.0")
    assert rows(changed.select("order_date").distinct(), F.col("order_date").cast("string")) == [("2024-03-01",)]
    assert second.tables["fct_orders"].count() == 30
    assert second.tables["agg_order_details"].agg(F.sum("n")).first()[0] == 90
    assert spark.table("stg_public_orders").count() == 30
    failing = second.checks("2024-05-01 00:00:00").filter("status <> 'pass'")
    # The customer with two versions has two rows, yet its surrogate keys are unique.
    assert failing.count() == 0


def test_stored_model_of_empty_sources(spark, shop, tmp_path):
    empty = {n: df.limit(0) for n, df in shop.items()}
    built = run_model(spark, empty, shop_model(), str(tmp_path), "2024-04-01 00:00:00")
    assert {n: df.count() for n, df in built.tables.items() if df.count()} == {}
    again = run_model(spark, shop, shop_model(), str(tmp_path), "2024-05-01 00:00:00")
    assert again.tables["dim_customers"].count() == 30 and again.tables["fct_order_details"].count() == 90
    assert again.tables["agg_order_details"].agg(F.sum("n")).first()[0] == 90


def test_keys_of_any_width_and_kind(spark):
    wide = spark.createDataFrame([(a, b, c, d) for a in range(2) for b in range(2) for c in range(2) for d in range(2)], "a int, b int, c int, d int")
    assert discover_keys(wide) == [("a", "b", "c", "d")]
    assert discover_keys(wide, 3) == [] and discover_keys(wide.union(wide)) == []
    typed = wide.select((F.col("a") * 8 + F.col("b") * 4 + F.col("c") * 2 + F.col("d")).cast("decimal(38,0)").alias("id"), F.lit(1.5).alias("x"))
    assert discover_keys(typed) == [("id",)]
    children = typed.select((F.col("id") % 3).cast("int").alias("ref"))
    found = discover_fks({"p": typed, "c": children}, {"p": [("id",)], "c": []})
    assert rows(found, "child_column", "parent_column") == [("ref", "id")]


def test_keys_of_random_tables_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    for case in range(6):
        columns = [f"c{i}" for i in range(6)]
        data = [tuple(rng.randrange(rng.choice([1, 2, 4, 9])) for _ in columns) for _ in range(rng.choice([1, 6, 25]))]
        unique = [set(k) for n in range(1, 7) for k in combinations(range(6), n) if len({tuple(r[i] for i in k) for r in data}) == len(data)]
        expected = sorted([tuple(f"c{i}" for i in sorted(k)) for k in unique if not any(o < k for o in unique)], key=lambda k: (len(k), k))
        df = spark.createDataFrame(data, ", ".join(f"{c} int" for c in columns))
        monkeypatch.setattr(profiling, "SAMPLE_VALUES", rng.choice([1, 5, 50_000]))
        assert discover_keys(df) == expected
        least = min(map(len, expected), default=0)
        assert discover_keys(df, smallest_only=True) == [k for k in expected if len(k) == least]


def test_key_of_five_among_sixty_columns(spark, monkeypatch):
    """Five digits of the row number are the key; the other columns depend on one of them each."""
    digits = [f"cast(floor(id / {4 ** i}) % 4 as int) as k{i}" for i in range(5)]
    df = spark.range(1024).selectExpr("id", *digits).selectExpr(*(f"k{i}" for i in range(5)), *(f"k{i % 5} % 2 + {i} as x{i}" for i in range(55)))
    monkeypatch.setattr(profiling, "SAMPLE_VALUES", 200)
    passes, cells = [], profiling._cells
    monkeypatch.setattr(profiling, "_cells", lambda *args: passes.append(1) or cells(*args))
    assert discover_keys(df) == [("k0", "k1", "k2", "k3", "k4")]
    assert len(passes) < 40


def test_proposal_finds_a_key_of_four(spark):
    df = spark.range(81).selectExpr(*(f"cast(floor(id / {3 ** i}) % 3 as int) as {c}" for i, c in enumerate("abcd")), "1.5D as price")
    assert find_tables({"wide": df})[0]["wide"].primary_key == ("a", "b", "c", "d")


def test_candidates_with_a_part_in_common_are_settled_by_one_pass(spark, monkeypatch):
    """Few rows repeat a value of ``a`` and ``b``; whatever holds both is tried on these rows, not on all again."""
    rng = random.Random(3)
    data = [(i // 4, i % 4 + 4 * rng.randrange(60), rng.randrange(6), rng.randrange(6), rng.randrange(6)) for i in range(2000)]
    data += [(a, b, (c + 1) % 6, (d + 1) % 6, e) for a, b, c, d, e in data[::500]]
    df = spark.createDataFrame(data, "a int, b int, c int, d int, e int").repartition(3)
    unique = [set(k) for n in range(1, 6) for k in combinations("abcde", n) if len({tuple(r["abcde".index(c)] for c in k) for r in data}) == len(data)]
    expected = sorted([tuple(sorted(k)) for k in unique if not any(o < k for o in unique)], key=lambda k: (len(k), k))
    monkeypatch.setattr(profiling, "SAMPLE_VALUES", 100)
    parts, find = [], profiling._repeating
    monkeypatch.setattr(profiling, "_repeating", lambda *args: parts.append(find(*args)) or parts[-1])
    assert discover_keys(df) == expected and ("a", "b", "c") in expected
    tried = [p for r in parts for p in r.parts]
    assert not any(p != q and p & q == q for i, p in enumerate(tried) for q in tried[:i])
