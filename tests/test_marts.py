"""Raw files to marts on small hand-made files."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fretwork.functions.money import money_text, price_tier, stock_label
from fretwork.plans import analytics, marts, staging, warehouse
from fretwork.schemas import RAW
from fretwork.sources import raw_files
from fretwork.sources.catalog import generate_catalog

FILES = {
    "customers": """customer_id,first_name,last_name,email,skill_level,primary_instrument,years_playing,use_case,budget_range,created_at
C1,Ann,Bee,a@x,beginner,guitar,1,practice,0-500,2022-07-03
C2,Bob,,b@x,advanced,drums,5,live performance,500-2000,2022-08-09
C3,Cid,Dee,c@x,advanced,keys,many,studio recording,2000+,2022-09-30
""",
    "inventory": "product_id,quantity\nP0001,0\nP0002,7\n",
    "orders": """order_id,customer_id,product_id,quantity,unit_price,order_date,status
O1,C1,K11,1,140.25,2022-11-05,completed
O2,C1,K27,2,8.40,2022-11-17,completed
O2,C1,K27,1,8.40,2022-11-17,completed
O3,C1,,1,1.00,2022-10-01,completed
O4,C9,K1,1,1.00,2022-13-31,completed
""",
    "products": '''product_id,name,brand,category,subcategory,price,description,skill_level,use_case,in_stock,manufacturer_url
P0003,Axe,B,Guitar,Electric Guitar,10.00,"long, with ""quotes""",beginner,practice,true,
P0001,Axe,B,Guitar,Electric Guitar,10.00,one,beginner-advanced,practice,true,https://b
P0002,Axe,B,Guitar,Electric Guitar,20.00,two,beginner,practice,false,
P0004,Kit,B,Drums,Drum Kit,cheap,bad price,beginner,practice,true,
P0005,Kit,B,Drums,Drum Kit,1500,top,beginner,practice,true,
''',
    "se_handoffs": '''handoff_id,session_id,customer_snapshot,recommended_products,conversation_summary,priority,created_at,assigned_se
H1,S1,"{""name"": ""Ann"", ""budget"":  275, ""budget"":  310}","[""K11"", ""K27""]","first, long",medium,2022-12-02,Vera
H2,S2,"{broken","[]",x,high,2022-12-08,Otto
''',
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    out = str(tmp_path_factory.mktemp("warehouse"))
    audit = warehouse.build(spark, str(folder), out)
    return out, {r.table_name: r.row_count for r in audit.collect()}


def test_audit_counts_every_loaded_row(built):
    assert built[1] == {"raw_customers": 3, "raw_inventory": 2, "raw_orders": 5, "raw_products": 5, "raw_se_handoffs": 2}


def test_products_keep_lowest_id_per_name_and_price(spark, built):
    rows = {r.product_id: r for r in warehouse.read_mart(spark, built[0], "dim_products").collect()}
    assert sorted(rows) == ["P0001", "P0002", "P0005"]
    assert rows["P0001"].price == Decimal("10.00") and rows["P0001"].skill_levels_array == ["beginner", "advanced"]
    assert (rows["P0001"].price_tier, rows["P0005"].price_tier) == ("budget", "premium")
    assert rows["P0002"].in_stock is False


def test_customers_with_and_without_orders(spark, built):
    rows = {r.customer_id: r for r in warehouse.read_mart(spark, built[0], "dim_customers").collect()}
    assert sorted(rows) == ["C1", "C2"]
    one, two = rows["C1"], rows["C2"]
    assert (one.total_orders, one.lifetime_value) == (3, 166.45)
    assert one.purchased_product_ids == [None, "K11", "K27"]
    assert (str(one.first_order_date), str(one.last_order_date)) == ("2022-10-01", "2022-11-17")
    assert two.full_name is None and (two.total_orders, two.lifetime_value) == (0, 0.0)
    assert two.purchased_product_ids == [] and two.last_order_date is None


def test_bad_rows_go_to_quarantine(spark, built):
    def rejected(name):
        return [(r[0], r.rejected_column) for r in warehouse.read_table(spark, built[0], f"rejected_{name}").collect()]

    assert rejected("customers") == [("C3", "years_playing")]
    assert rejected("products") == [("P0004", "price")]
    assert rejected("orders") == [("O4", "order_date")]
    assert rejected("se_handoffs") == [("H2", "customer_snapshot")]
    assert rejected("inventory") == []


def test_recommendations_hold_compact_json(spark, built):
    (row,) = warehouse.read_mart(spark, built[0], "fct_recommendations").collect()
    assert row.customer_snapshot == '{"name":"Ann","budget":275,"budget":310}'
    assert row.recommended_products == '["K11","K27"]'
    assert str(row.created_at) == "2022-12-02 00:00:00"


def test_second_build_changes_nothing_and_keeps_marts_on_request(spark, built, tmp_path):
    before = sorted(map(str, warehouse.read_mart(spark, built[0], "dim_products").collect()))
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text if name != "products" else text.splitlines()[0] + "\n")
    raw = sorted(map(str, warehouse.read_table(spark, built[0], "raw_products").collect()))
    audit = warehouse.build(spark, str(tmp_path), built[0], replace=False)
    assert {r.table_name: r.row_count for r in audit.collect()} == built[1]
    assert sorted(map(str, warehouse.read_table(spark, built[0], "raw_products").collect())) == raw
    assert sorted(map(str, warehouse.read_mart(spark, built[0], "dim_products").collect())) == before


def test_staging_views(spark, built):
    warehouse.create_staging_views(warehouse.raw_tables(spark, built[0]))
    assert spark.sql("select sum(line_total) from stg_orders").first()[0] == Decimal("166.45")


def test_csv_round_trip(spark, tmp_path):
    row = ("P1", 'say "hi", ok', "B\nC", "", None, "1.50", "back\\slash", "b-a", "u", "true", "")
    df = spark.createDataFrame([row], RAW["products"])
    raw_files.write_csv(df, str(tmp_path / "out"), "products")
    (got,) = raw_files.read_csv(spark, str(tmp_path / "out"), "products", multi_line=True).collect()
    assert [x or None for x in got] == [x or None for x in row]


def test_pages_of_product_lists_hold_the_whole_bridge(spark):
    rows = [("C1", f"P{i % 70}") for i in range(200)] + [("C2", "B"), ("C2", None), ("C3", "x"), (None, "y")]
    bridge = marts.customer_products(spark.createDataFrame(rows, "customer_id string, product_id string").where("customer_id is not null"))
    pages = marts.product_pages(bridge, page_products=5).collect()
    got = {(r.customer_id, p) for r in pages for p in r.product_ids}
    assert got == {r for r in rows if r[0]} and sum(len(r.product_ids) for r in pages) == len(got)
    assert {r.n_pages for r in pages if r.customer_id == "C1"} == {14} and max(len(r.product_ids) for r in pages) < 20
    assert {(r.customer_id, r.page_no, tuple(r.product_ids)) for r in pages if r.customer_id != "C1"} == {("C2", 0, (None, "B")), ("C3", 0, ("x",))}


def base_items(spark, n):
    rows = [(i * 3, "B" if i % 2 else "Z", f"m{i}", "c", "s", Decimal("10.10") * i, "beginner", "practice", "d") for i in range(n)]
    return spark.createDataFrame(
        rows,
        "position bigint, brand string, model string, category string, subcategory string, price decimal(10,2),"
        " skill_level string, use_case string, description string",
    )


@pytest.mark.parametrize("n", [3, 7, 17, 1000])
def test_generator_cycles_to_size(spark, n):
    urls = spark.createDataFrame([("B", "https://b")], "brand string, url string")
    rows = generate_catalog(base_items(spark, 7), n, urls).orderBy("product_id").collect()
    assert [r.product_id for r in rows] == [f"P{i:04d}" for i in range(1, n + 1)]
    for i, r in enumerate(rows):
        base = Decimal("10.10") * (i % 7)
        bundle = i >= 7
        assert r.name == f"{'B' if i % 7 % 2 else 'Z'} m{i % 7}" + (" Bundle" if bundle else "")
        assert Decimal(r.price) == (round(base * Decimal("1.05") + Decimal("0.0000001"), 2) if bundle else base)
        assert r.manufacturer_url == ("https://b" if r.brand == "B" else "")
    kept = marts.dim_products(staging.stg_products(generate_catalog(base_items(spark, 7), n))).count()
    assert kept == min(n, 14)


def test_tiers_labels_and_money(spark):
    prices = ["0", "99.99", "100", "499.99", "500", "1499.99", "1500", None]
    df = spark.createDataFrame([(None if p is None else Decimal(p),) for p in prices], "p decimal(10,2)")
    tiers = [r[0] for r in df.select(price_tier(df.p)).collect()]
    assert tiers == ["budget", "budget", "entry", "entry", "mid-range", "mid-range", "premium", "premium"]
    assert [r[0] for r in df.select(money_text(df.p)).collect()][5:] == ["1,499.99", "1,500.00", "0.00"]
    stock = spark.createDataFrame([(q,) for q in [None, 0, 1, 9, 10]], "q int")
    labels = ["Out of Stock", "Out of Stock", "Last One!", "Only 9 left", "10 in stock"]
    assert [r[0] for r in stock.select(stock_label(stock.q)).collect()] == labels


def test_conversion_and_ownership(spark):
    recs = spark.sql(
        """select * from values ('C1', 'A', timestamp'2024-01-02 00:00:00'), ('C1', 'A', timestamp'2024-01-02 08:00:00'),
           ('C1', 'A', timestamp'2024-01-09 00:00:00'), ('C2', 'A', timestamp'2024-01-01 00:00:00') t(customer_id, product_id, created_at)"""
    )
    orders = spark.sql(
        """select * from values ('C1', 'A', date'2024-01-01'), ('C1', 'A', date'2024-01-02'), ('C1', 'A', date'2024-01-05'),
           ('C1', 'B', date'2024-01-09') t(customer_id, product_id, order_date)"""
    )
    got = {(r.customer_id, str(r.created_at)): r.converted_on and str(r.converted_on) for r in analytics.conversion(recs, orders).collect()}
    assert got == {
        ("C1", "2024-01-02 00:00:00"): "2024-01-02",
        ("C1", "2024-01-02 08:00:00"): "2024-01-05",
        ("C1", "2024-01-09 00:00:00"): None,
        ("C2", "2024-01-01 00:00:00"): None,
    }
    assert [r.customer_id for r in analytics.not_owned(recs, orders).collect()] == ["C2"]


def test_generator_has_no_upper_size(spark):
    rows = generate_catalog(base_items(spark, 2), 6_000_000_000).limit(3).collect()
    assert [r.product_id for r in rows] == ["P0001", "P0002", "P0003"] and rows[2].name.endswith(" Bundle")


def test_generator_numbers_a_base_in_bands(spark, monkeypatch):
    from fretwork.sources import catalog

    monkeypatch.setattr(catalog, "BAND_ROWS", 9)
    rows = generate_catalog(base_items(spark, 100).repartition(5), 150).orderBy(F.length("product_id"), "product_id").collect()
    assert [int(r.name.split()[1][1:]) for r in rows] == [i % 100 for i in range(150)]


def test_packed_files_are_short_and_hold_every_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw_files, "PACKED_ROWS", 10)
    rows = [(f"P{i}", None if i == 3 else f'{i} "x", y') for i in range(45)]
    path = str(tmp_path / "inventory.csv")
    raw_files.write_csv(spark.createDataFrame(rows, "product_id string, quantity string").coalesce(1), path, "inventory", packed=True)
    assert len(list((tmp_path / "inventory.csv").glob("*.csv.gz"))) == 5
    assert sorted(map(tuple, raw_files.read_csv(spark, path, "inventory").collect())) == sorted(rows)
