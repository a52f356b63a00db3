"""A hand-made marketplace with hot keys: one customer, seller, state and product
each hold a third of the rows; one order has 40 items; NULLs everywhere allowed."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from cxlens.sources.schemas import SCHEMAS
from cxlens.sources.tables import TABLE_NAMES, Tables

MESSAGES = ["Arrived late", "box was BROKEN", "wrong size again", "seller never replied",
            "cheap and flimsy", "fine", "damaged and delayed", "chocolate plate", None, "meh",
            "not what I ordered", "Customer Service ignored me", "it fell apart", "ok"]
STATUSES = ["delivered"] * 8 + ["canceled", "returned", "unavailable", "shipped", "processing"]


def skewed_rows(n_orders: int = 3000, seed: int = 11) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    base = dt.datetime(2023, 1, 1)
    rows = {n: [] for n in TABLE_NAMES}
    states = [f"S{i}" for i in range(12)]
    for i in range(n_orders):
        oid, cid = f"o{i}", f"c{i}"
        hot = i % 3 == 0
        purchase = base + dt.timedelta(days=rng.randint(0, 729), seconds=rng.randint(0, 86399))
        est = None if rng.random() < 0.02 else purchase + dt.timedelta(days=10)
        state = "HOT" if i % 3 == 1 else rng.choice(states)
        r = rng.random()
        if state == "S5" and r > 0.1:  # a regional hotspot: mostly late
            delivered = purchase + dt.timedelta(days=10, hours=rng.randint(1, 300))
        elif r < 0.1:
            delivered = None
        elif r < 0.35:
            delivered = purchase + dt.timedelta(days=10, hours=rng.randint(1, 300))
        else:
            delivered = purchase + dt.timedelta(days=rng.randint(2, 10))
        status = "delivered" if delivered is not None and rng.random() < 0.9 else rng.choice(STATUSES)
        rows["orders"].append((oid, cid, status, purchase,
                               None if rng.random() < 0.01 else purchase + dt.timedelta(hours=1),
                               None if delivered is None else purchase + dt.timedelta(days=2),
                               delivered, est))
        unique = "u_hot" if hot else (None if rng.random() < 0.005 else f"u{rng.randint(0, 400)}")
        rows["customers"].append((cid, unique, state))
        n_items = 40 if i == 5 else rng.choice([0, 1, 1, 1, 2, 3])
        for j in range(1, n_items + 1):
            seller = "s_hot" if i % 3 == 2 else (None if rng.random() < 0.01 else f"s{rng.randint(0, 40)}")
            product = "p_hot" if i % 3 == 0 else f"p{rng.randint(0, 300)}"
            price = None if rng.random() < 0.003 else Decimal(rng.randint(100, 90000)) / 100
            freight = None if rng.random() < 0.01 else Decimal(rng.randint(0, 3000)) / 100
            rows["order_items"].append((oid, j, product, seller, price, freight))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            rows["payments"].append((oid, rng.choice(["card", "voucher", "wallet"]),
                                     rng.choice([0, 1, 1, 1, 2, 3, 4, 5, 6, 8, 10, 12]),
                                     Decimal(rng.randint(100, 50000)) / 100))
        for k in range(rng.choice([0, 1, 1, 1, 1, 2])):
            score = None if rng.random() < 0.01 else rng.choice([1, 1, 2, 2, 3, 4, 5, 5, 5])
            answered = purchase + dt.timedelta(days=20) if rng.random() < 0.3 else None
            rows["reviews"].append((f"r{i}_{k}", oid, score, None, rng.choice(MESSAGES),
                                    purchase + dt.timedelta(days=rng.randint(5, 40)), answered))
    for p in ["p_hot"] + [f"p{i}" for i in range(0, 300, 1) if i % 7]:
        cat = "c_hot" if p == "p_hot" else f"c{int(p[1:]) % 9}"
        rows["products"].append((p, cat, rng.randint(1, 50) * 100))
    rows["product_categories"] = [("c_hot", "HOT CATEGORY")] + [(f"c{i}", f"CAT {i}") for i in range(8)]
    rows["sellers"] = [("s_hot", "HOT", dt.date(2020, 1, 1))] + [
        (f"s{i}", "S1", dt.date(2021, 1, 1)) for i in range(0, 40)]
    rows["orders"].append(("o_dup", "c_missing", None, base, None, None, None, None))
    rows["reviews"].append(("r_orphan", "o_missing", 1, None, "late", base, None))
    rows["geolocation"] = [("z1", "HOT", 1.0, -1.0)]
    return rows


def skewed_tables(spark) -> Tables:
    rows = skewed_rows()
    return Tables({n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in TABLE_NAMES})
