
from cxlens.plans import VIEW_COLUMNS, order_analysis
from tests.helpers import D, T, make_tables, order, review

EST = T(2024, 1, 10, 23, 0)


def _view(spark):
    orders = [
        order("o1", T(2024, 1, 1), delivered=T(2024, 1, 11, 1, 0), estimated=EST),   # 2h over midnight
        order("o2", T(2024, 1, 1), delivered=T(2024, 1, 10, 23, 30), estimated=EST),  # same day late
        order("o3", T(2024, 1, 1), delivered=EST, estimated=EST),                     # exactly on time
        order("o4", T(2024, 1, 1), delivered=T(2024, 1, 13, 23), estimated=EST),      # 3 days
        order("o5", T(2024, 1, 1), delivered=T(2024, 1, 14, 23), estimated=EST),      # 4 days
        order("o6", T(2024, 1, 1), delivered=T(2024, 1, 17, 23), estimated=EST),      # 7 days
        order("o7", T(2024, 1, 1), delivered=T(2024, 1, 18, 23), estimated=EST),      # 8 days
        order("o8", T(2024, 1, 7, 12), delivered=T(2024, 1, 9), estimated=None),     # no estimate, Sunday
        order("o9", T(2024, 1, 2), delivered=None, estimated=EST, status="canceled"),  # undelivered
    ]
    items = [("o1", 1, "p1", "s1", D("10.00"), D("1.50")), ("o1", 2, "p2", "s2", D("5.00"), None),
             ("o2", 1, "p2", "s2", D("3.00"), D("0.25"))]
    products = [("p1", "cat1", 100), ("p2", "cat2", 200)]
    cats = [("cat1", "CAT ONE")]
    payments = [("o1", "card", 1, D("16.50")), ("o1", "voucher", 4, D("1.00")),
                ("o2", "card", 0, D("3.25")), ("o3", "card", 3, D("1.00"))]
    reviews = [review("r1", "o1", 1, "Damaged and late"), review("r2", "o2", 2, "Chocolate plate"),
               review("r3", "o3", 2, None), review("r4", "o4", 3, "broken", answered=T(2024, 2, 1)),
               review("r5", "o5", 2, "box was broken"), review("r5b", "o5", 5, "great")]
    customers = [(f"co{i}", f"u{i % 2}", "ST") for i in range(1, 10)]
    t = make_tables(spark, orders=orders, order_items=items, products=products,
                    product_categories=cats, payments=payments, reviews=reviews,
                    customers=customers)
    return {(r.order_id, r.review_id): r for r in order_analysis(t).collect()}, order_analysis(t)


def test_view_columns_and_rows(spark):
    rows, df = _view(spark)
    assert df.columns == VIEW_COLUMNS and len(VIEW_COLUMNS) == 44
    assert len(rows) == 10  # o5 has two reviews: rows fan out


def test_lateness_buckets(spark):
    rows, _ = _view(spark)
    by = {k[0]: r for k, r in rows.items()}
    assert (by["o1"].is_late, by["o1"].late_days, by["o1"].delivery_bucket) == (1, 1, "late_1_3_days")
    assert (by["o2"].is_late, by["o2"].late_days, by["o2"].delivery_bucket) == (1, 0, "late_1_3_days")
    assert (by["o3"].is_late, by["o3"].delivery_bucket) == (0, "on_time")
    assert [by[o].delivery_bucket for o in ("o4", "o5", "o6", "o7")] == [
        "late_1_3_days", "late_4_7_days", "late_4_7_days", "late_8_plus_days"]
    # Delivered without an estimate: not late, but bucketed 8+ days.
    assert (by["o8"].is_late, by["o8"].late_days, by["o8"].delivery_bucket) == (0, None, "late_8_plus_days")
    assert (by["o9"].is_late, by["o9"].late_days, by["o9"].delivery_bucket) == (None, None, "not_delivered")
    assert by["o9"].is_canceled_or_returned == 1 and by["o1"].is_canceled_or_returned == 0
    assert by["o8"].order_dow == 0 and by["o8"].order_year == 2024 and by["o8"].order_month_num == 1


def test_reviews_and_root_cause(spark):
    rows, _ = _view(spark)
    by = {k[0]: r for k, r in rows.items()}
    assert by["o1"].root_cause == "late_delivery"          # precedence
    assert by["o2"].root_cause == "late_delivery"          # "plate" contains "late"
    assert by["o3"].root_cause == "uncategorized_complaint"
    assert by["o4"].root_cause is None and by["o4"].is_passive == 1
    assert by["o4"].has_seller_response == 1
    unreviewed = by["o6"]
    assert (unreviewed.is_detractor, unreviewed.is_promoter, unreviewed.root_cause) == (0, 0, None)
    assert rows[("o5", "r5b")].is_promoter == 1 and rows[("o5", "r5")].is_detractor == 1


def test_items_and_payments(spark):
    rows, _ = _view(spark)
    by = {k[0]: r for k, r in rows.items()}
    o1 = by["o1"]
    assert (o1.seller_id, o1.category_name, o1.item_price, o1.weight_grams) == ("s1", "CAT ONE", D("10.00"), 100)
    # order_total skips the item whose freight is NULL; the two sums do not.
    assert (o1.order_gmv, o1.order_freight, o1.order_total, o1.item_count) == (
        D("15.00"), D("1.50"), D("11.50"), 2)
    assert (o1.max_installments, o1.total_paid, o1.installment_bucket) == (4, D("17.50"), "4_5_installments")
    assert by["o2"].installment_bucket == "2_3_installments"     # 0 installments
    assert by["o2"].category_name is None                        # category not in lookup
    assert by["o3"].installment_bucket == "2_3_installments"
    assert by["o4"].installment_bucket == "6_plus_installments"  # no payment row
    assert by["o4"].seller_id is None                            # no first item


def test_column_subset_drops_unneeded_joins(spark):
    t = make_tables(spark, orders=[order("o1", T(2024, 1, 1))], reviews=[review("r1", "o1", 2)])
    plan = order_analysis(t, ["review_score", "is_late"])._jdf.queryExecution() \
        .optimizedPlan().toString()
    for absent in ("payment_installments", "price", "customer_state", "category_name"):
        assert absent not in plan
    assert "review_score" in plan
    assert order_analysis(t, ["review_score", "delivery_bucket"]).count() == order_analysis(t).count()
