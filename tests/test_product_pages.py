"""The marts of a build hold every product of a customer, however many pages there are."""

from __future__ import annotations

from test_marts import FILES

from fretwork.plans import warehouse


def test_built_marts_hold_every_product_of_a_large_customer(spark, tmp_path):
    data, out = tmp_path / "raw", str(tmp_path / "warehouse")
    data.mkdir()
    lines = [f"O1{i},C1,L{i},1,1.00,2022-11-05,completed\n" for i in range(40)]
    lines += [f"O2{i},C2,S{i},1,1.00,2022-11-05,completed\n" for i in range(2)]
    for name, text in FILES.items():
        (data / f"{name}.csv").write_text(text + "".join(lines) if name == "orders" else text)
    warehouse.build(spark, str(data), out, page_products=1)
    pages = warehouse.read_mart(spark, out, "product_pages").where("customer_id in ('C1', 'C2')").collect()
    got = sorted((r.customer_id, p or "") for r in pages for p in r.product_ids)
    bought = [("C1", p) for p in ("", "K11", "K27", *(f"L{i}" for i in range(40)))] + [("C2", "S0"), ("C2", "S1")]
    assert got == sorted(bought)
    rows = {r.customer_id: r for r in warehouse.read_mart(spark, out, "dim_customers").collect()}
    assert (rows["C1"].n_product_pages, rows["C2"].n_product_pages) == (43, 2)
    first = {r.customer_id: r.product_ids for r in pages if r.page_no == 0}
    assert all(rows[c].purchased_product_ids == first.get(c, []) for c in ("C1", "C2"))
