"""Record rules: reasons, coercions, days, lateness."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleanse as C


def reasons(frame):
    rows = C.inspect(frame).orderBy("source_key").collect()
    return [row["reason"] for row in rows]


FAULTS = [
    ({"event_id": ""}, "missing_event_id"),
    ({"event_id": "   "}, "missing_event_id"),
    ({"event_id": "  "}, "missing_event_id"),
    ({"event_id": None}, "missing_event_id"),
    ({"event_id": 0}, "missing_event_id"),
    ({"event_id": []}, "missing_event_id"),
    ({"event_id": 7}, "schema_invalid"),
    ({"event_type": "subscription"}, "unknown_event_type"),
    ({"event_type": None}, "unknown_event_type"),
    ({"event_type": ["purchase"]}, "unknown_event_type"),
    ({"event_type": " purchase "}, None),
    ({"quantity": "two"}, "non_numeric_measures"),
    ({"quantity": None}, "non_numeric_measures"),
    ({"quantity": [1]}, "non_numeric_measures"),
    ({"quantity": "2.5"}, "non_numeric_measures"),
    ({"quantity": "1e3"}, "non_numeric_measures"),
    ({"amount_usd": "free"}, "non_numeric_measures"),
    ({"amount_usd": "1.0d"}, "non_numeric_measures"),
    ({"amount_usd": "0x1p3"}, "non_numeric_measures"),
    ({"amount_usd": None}, "non_numeric_measures"),
    ({"quantity": 0}, "non_positive_quantity"),
    ({"quantity": -3}, "non_positive_quantity"),
    ({"quantity": 0.5}, "non_positive_quantity"),
    ({"quantity": 2.5}, "schema_invalid"),
    ({"quantity": 2.0}, None),
    ({"quantity": "2"}, None),
    ({"quantity": " 2 "}, None),
    ({"quantity": "1_000"}, None),
    ({"quantity": True}, None),
    ({"amount_usd": -9.99}, "negative_amount"),
    ({"amount_usd": "19.5"}, None),
    ({"amount_usd": "nan"}, "schema_invalid"),
    ({"amount_usd": "inf"}, None),
    ({"event_ts": "not-a-timestamp"}, "schema_invalid"),
    ({"event_ts": "2026-02-30T00:00:00Z"}, "schema_invalid"),
    ({"event_ts": "12:00"}, "schema_invalid"),
    ({"event_ts": "2026"}, None),  # digits alone are epoch seconds
    ({"event_ts": None}, "schema_invalid"),
    ({"event_ts": True}, "schema_invalid"),
    ({"event_ts": 1767355200}, None),
    ({"event_ts": "1767355200"}, None),
    ({"event_ts": "2026-01-02"}, None),
    ({"event_ts": "2026-01-02 12:00:00.25z"}, None),
    ({"event_ts": "2026-01-02T12:00+0530"}, None),
    ({"user_id": 5}, "schema_invalid"),
    ({"user_id": None}, "schema_invalid"),
    ({"sku": 5}, "schema_invalid"),
    ({"user_id": ""}, None),
    ({"country": None}, "schema_invalid"),
    ({"country": 5}, "schema_invalid"),
    ({"campaign": "x", "device": {"os": "y"}, "nested": [1]}, None),
]


def test_first_failing_reason(bronze, event):
    frame = bronze(*[event(**changes) for changes, _ in FAULTS])
    got = reasons(frame)
    assert got == [reason for _, reason in FAULTS]


@pytest.mark.parametrize(
    "missing,reason",
    [("quantity", "non_positive_quantity"), ("amount_usd", "schema_invalid"), ("sku", "schema_invalid"), ("country", None)],
)
def test_absent_is_not_null(bronze, event, missing, reason):
    record = event()
    del record[missing]
    assert reasons(bronze(record)) == [reason]


def test_unreadable_and_empty_texts(bronze):
    frame = bronze("", "   ", "{}", " { } ", "not-json at all", "[1, 2]", '"text"', "null", '{"event_id": ')
    assert reasons(frame) == ["empty_record"] * 4 + ["missing_event_id"] * 5


def test_padded_json_and_repeated_keys(bronze, event):
    import json

    good = json.dumps(event())
    twice = good[:-1] + ', "quantity": 0}'
    assert reasons(bronze(" \x0b" + good + "\x0b", twice)) == [None, "non_positive_quantity"]


def test_reason_order(bronze, event):
    everything = event(event_id="", event_type="x", quantity=0, amount_usd=-1, event_ts="bad")
    assert reasons(bronze(everything)) == ["missing_event_id"]
    assert reasons(bronze(event(event_type="x", quantity="two"))) == ["unknown_event_type"]
    assert reasons(bronze(event(quantity=0, amount_usd="free"))) == ["non_numeric_measures"]


def test_conformed_values(bronze, event):
    record = event(quantity="3", amount_usd="7.25", extra=1, event_type=" refund ")
    del record["country"]
    row = C.accepted(C.cleanse(bronze(record), "2026-01-03T00:00:00Z")).first()
    assert (row["quantity"], row["amount_usd"], row["country"]) == (3, 7.25, "US")
    assert row["event_type"] == " refund "
    assert "extra" not in row.asDict()


def test_day_follows_the_events_own_offset(bronze, event):
    record = event(event_ts="2026-01-10T23:30:00-05:00")
    row = C.inspect(bronze(record)).select(
        "dt", F.date_format("event_ts", "yyyy-MM-dd HH:mm").alias("utc")
    ).first()
    assert tuple(row) == ("2026-01-10", "2026-01-11 04:30")


def test_epoch_day_is_utc(bronze, event):
    row = C.inspect(bronze(event(event_ts=1767355200000))).first()
    assert row["dt"] == "2026-01-02"


def test_lateness_is_strict(bronze, event):
    stamps = ["2026-01-09T12:00:00Z", "2026-01-08T00:00:00Z", "2026-01-07T11:00:00Z"]
    frame = bronze(*[event(event_id=f"e{i}", event_ts=s) for i, s in enumerate(stamps)])
    rows = C.accepted(C.cleanse(frame, "2026-01-10T00:00:00Z", 2)).orderBy("event_id").collect()
    assert [row["_late"] for row in rows] == [False, False, True]


def test_split_is_complete(bronze, event):
    frame = bronze(event(), event(event_id=""), {}, event(quantity=0))
    rows = C.cleanse(frame, "2026-01-10T00:00:00Z")
    assert C.accepted(rows).count() == 1
    assert [r["reason"] for r in C.quarantined(rows).orderBy("source_key").collect()] == [
        "missing_event_id", "empty_record", "non_positive_quantity",
    ]


def test_empty_input(bronze, spark):
    empty = bronze(None).filter("raw IS NOT NULL")
    assert C.cleanse(empty, "2026-01-10T00:00:00Z").count() == 0


def test_record_is_parsed_once(bronze, event):
    plan = C.accepted(C.cleanse(bronze(event()), "2026-01-10T00:00:00Z"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("jsontostructs(") == 2  # the text, and its trimmed form when that fails


def test_text_after_the_record_is_an_error(bronze, event):
    import json

    good = json.dumps(event())
    tails = [" x", " {}", "}", "]", ",", ', "a": 1', ",{}", "][{}", " " + good]
    assert reasons(bronze(*[good + tail for tail in tails])) == ["missing_event_id"] * len(tails)
    assert reasons(bronze(good + " \n", good + "\u00a0")) == [None, None]


def test_loose_json_is_an_error(bronze):
    assert reasons(bronze("{'event_id': 'a'}", '{event_id: "a"}', '{"event_id": "a",}', '\ufeff{"event_id": "a"}')) == ["missing_event_id"] * 4


def test_json_nan_is_read_as_a_number(bronze, event):
    import json

    amount, quantity = (json.dumps(event(**{name: float("nan")})) for name in ("amount_usd", "quantity"))
    assert "NaN" in amount
    assert reasons(bronze(amount, quantity)) == ["schema_invalid", "non_numeric_measures"]
