"""Queries over whole tables, on small tables with the rows that subsets leave out."""

from datetime import date, datetime, timedelta

from corpusmill import catalogue


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def test_all_orders_have_a_next_day(spark, tmp_path):
    rows = [(k, 1, "O", 1.0, datetime(1996, 1, 1) + timedelta(days=k % 400), "1") for k in (1, 1999, 2000, 2001, 2002, 60_001)]
    written(spark, tmp_path, "orders", rows, ORDERS)
    want = {}
    for k, *_, at, _ in rows:
        days = [at.date() + timedelta(days=i) for i in range(1, 41)]
        fits = [lambda x: True, lambda x, k=k: x.weekday() == k % 7, lambda x, k=k: x.day == k % 28 + 1][k % 3]
        want[k] = min(filter(fits, days))
    got = {r.o_orderkey: r.next_due for r in catalogue.queries()["recurrence_next_due"](spark, str(tmp_path)).collect()}
    assert got == want and isinstance(got[2000], date)


def test_conflicts_of_unimportant_records(spark, tmp_path):
    rows = [(k, k // 10, s, 1.0, datetime(1996, 5, 1), t) for k, s, t in [(11, "O", "a"), (12, "O", "b"), (18, "O", "a"), (19, "F", "b"), (27, "O", "a"), (28, "O", "b")]]
    written(spark, tmp_path, "orders", rows, ORDERS)
    got = catalogue.queries()["subject_conflicts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(11, 12), (12, 18), (27, 28)]


def test_user_turns_are_told_by_role(spark, tmp_path):
    rows = [(1, 0, "system", "that"), (1, 1, "user", "THAT"), (1, 2, "assistant", "that"), (1, 3, "user", "no"), (1, 4, "user", None)]
    written(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = catalogue.queries()["trigger_capture"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, True), (1, 3, False), (1, 4, None)]


def test_two_hops_start_at_every_page(spark, tmp_path):
    pages = set(range(0, 130, 2))
    written(spark, tmp_path, "pages", [(p,) for p in pages], "page_id long")
    step = {p: {(p * 7 + k) % 129 if p % 3 == 0 else (p + k * k) % 129 for k in (1, 2, 5)} & pages if p % 4 != 1 else set() for p in pages}
    want = {}
    for p in pages:
        for q in step[p]:
            for other in step[q] - step[p] - {p}:
                want[p, other] = 2
            if q != p:
                want[p, q] = 1
    got = {(r.node, r.other): r.hops for r in catalogue.queries()["graph_two_hop_all"](spark, str(tmp_path)).collect()}
    assert got == want and max(p for p, _ in got) >= 20
