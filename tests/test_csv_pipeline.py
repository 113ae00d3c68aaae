"""End to end on a tiny hand-made CSV export with string ids (the real-data route)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ordermill.plans import analyses as A
from ordermill.plans import sql_suite as Q
from ordermill.plans.master import build_master
from ordermill.sources.readers import CSV_FILES, read_marketplace_csv

FILES = {
    "orders": ["order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
               "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date",
               "o1,c1,delivered,2017-10-02 10:56:33,,,2017-10-10 21:25:13,2017-10-18 00:00:00",
               "o2,c2,delivered,2017-11-05 08:00:00,,,2017-11-25 09:00:00,2017-11-20 00:00:00",
               "o2,c2,delivered,2017-11-05 08:00:00,,,2017-11-25 09:00:00,2017-11-20 00:00:00",
               "o3,c1,shipped,2017-12-01 12:00:00,,,,2017-12-20 00:00:00",
               "o4,c3,delivered,bad date,,,,2018-01-20 00:00:00"],
    "items": ["order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value",
              "o1,1,p1,s1,2017-10-06 11:07:15,58.90,13.29",
              "o1,2,p2,s2,2017-10-06 11:07:15,10.00,2.00",
              "o2,1,p2,s2,2017-11-09 00:00:00,199.00,17.87",
              "o2,1,p2,s2,2017-11-09 00:00:00,199.00,17.87",
              "o3,1,p3,s1,2017-12-05 00:00:00,5.50,1.00"],
    "payments": ["order_id,payment_sequential,payment_type,payment_installments,payment_value",
                 "o1,1,credit_card,3,72.19", "o1,2,voucher,1,12.00", "o2,1,boleto,1,216.87"],
    "reviews": ["review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp",
                "r1,o1,4,,,2017-10-11 00:00:00,2017-10-12 00:00:00",
                "r2,o2,1,,\"late, and \"\"broken\"\"\",2017-11-26 00:00:00,2017-11-27 00:00:00",
                "r3,o2,2,,,2017-11-28 00:00:00,2017-11-29 00:00:00"],
    "customers": ["customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state",
                  "c1,u1,01000,sao paulo,SP", "c2,u2,20000,rio,RJ", "c3,u1,01000,sao paulo,SP"],
    "sellers": ["seller_id,seller_zip_code_prefix,seller_city,seller_state", "s1,13000,campinas,SP", "s2,80000,curitiba,PR"],
    "products": ["product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,"
                 "product_weight_g,product_length_cm,product_height_cm,product_width_cm",
                 "p1,cama_mesa_banho,40,200,1,500,20,10,10", "p2,perfumaria,40,200,1,500,20,10,10", "p3,,,,,,,,"],
    "translation": ["product_category_name,product_category_name_english", "perfumaria,perfumery"],
}


@pytest.fixture(scope="module")
def tables(spark):
    d = tempfile.mkdtemp(prefix="om-export-")
    for role, lines in FILES.items():
        with open(os.path.join(d, CSV_FILES[role]), "w") as f:
            f.write("\n".join(lines) + "\n")
    return read_marketplace_csv(spark, d)


def test_master_from_csv(tables):
    m = {r.order_id: r for r in build_master(tables).collect()}
    assert set(m) == {"o1", "o2", "o4"}                      # delivered only, duplicate o2 removed
    assert m["o1"].main_category == "cama_mesa_banho"        # 1 item each: tie -> smallest name
    assert m["o1"].category_english == "Cama Mesa Banho"     # untranslated -> title case
    # de-duplicated prices 5.50, 10.00, 58.90, 199.00: p99 = 58.90 + 0.97 * 140.10 = 194.797 -> 194.80
    assert m["o2"].category_english == "perfumery" and float(m["o2"].total_price) == 194.80
    assert float(m["o1"].total_price) == 68.90
    assert m["o1"].payment_type == "credit_card" and m["o2"].review_score == 2   # latest review
    assert m["o2"].is_late and not m["o1"].is_late and m["o4"].order_purchase_timestamp is None
    assert m["o1"].seller_state == "SP" and m["o1"].customer_unique_id == "u1"
    assert m["o4"].total_price is None and m["o4"].category_english is None     # no items


def test_sql_queries_from_csv(tables):
    t = tables
    q3 = Q.late_by_state(t.orders, t.customers, min_orders=1).collect()
    assert {r.customer_state: (r.total_orders, r.late_orders) for r in q3} == {"SP": (1, 0), "RJ": (2, 2)}
    q2 = {r.category: r for r in Q.top_categories(t.items, t.products, t.translation, t.reviews).collect()}
    # o2's item appears twice (duplicate raw row) and fans out over 2 reviews: 4 rows of 199.00, plus o1's 10.00
    assert q2["perfumery"].revenue == 806.0 and q2["perfumery"].orders == 2


def test_analyses_from_csv(tables):
    m = build_master(tables)
    assert A.executive_kpis(m).first().total_orders == 3
    seg = A.rfm_segments(m, on_duplicate_edges="ignore")
    # a customer without a dated order has no recency score and so no segment
    undated = seg.where(F.col("recency").isNull())
    assert seg.count() == 3 and seg.where(F.col("segment").isNull()).count() == undated.count()
