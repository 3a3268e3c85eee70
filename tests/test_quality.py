from __future__ import annotations

from tidemark.operators import cleanse as C
from tidemark.operators import quality as Q


def gate(frame, **options):
    return Q.decide(Q.tally(C.inspect(frame)), **options).first()


def test_clean_batch_passes(bronze, event):
    row = gate(bronze(event(), event(event_id="evt-2")))
    assert (row["passed"], row["action"], row["rows_failed"], row["rows_scanned"]) == (True, "pass", 0, 2)


def test_empty_batch_passes(bronze):
    row = gate(bronze(None).filter("raw IS NOT NULL"))
    assert (row["passed"], row["rows_scanned"], row["fail_ratio"]) == (True, 0, 0.0)


def test_all_checks_are_collected(bronze, event):
    frame = bronze(
        event(event_id=""), event(event_type="click"), event(quantity=0, amount_usd=-1), event(user_id="", sku="")
    )
    row = gate(frame)
    assert (row["passed"], row["action"], row["rows_failed"]) == (False, "fail", 4)
    assert row["failed_checks"] == (
        "event_id_present, known_event_type, required_dimensions, quantity_and_amount_sane, schema_valid"
    )
    assert (row["event_id_present"], row["known_event_type"], row["required_dimensions"]) == (1, 1, 1)


def test_zero_quantity_is_schema_valid_but_not_sane(bronze, event):
    row = C.inspect(bronze(event(quantity=0))).first()
    assert row["checks"] == ["quantity_and_amount_sane"]


def test_nan_amount_fails_only_the_schema(bronze, event):
    assert C.inspect(bronze(event(amount_usd="nan"))).first()["checks"] == ["schema_valid"]


def test_quarantine_mode_still_fails_the_gate(bronze, event):
    row = gate(bronze(event(event_id="")), on_fail="quarantine")
    assert (row["passed"], row["action"]) == (False, "quarantine")


def test_tolerated_ratio(bronze, event):
    good = [event(event_id=f"e{i}") for i in range(9)]
    row = gate(bronze(*good, event(event_id="")), max_fail_ratio=0.2)
    assert (row["passed"], row["rows_failed"], row["fail_ratio"]) == (True, 1, 0.1)
    row = gate(bronze(*good, event(event_id="")), max_fail_ratio=0.1)
    assert row["passed"] is True


def test_typed_and_raw_checks_agree(bronze, event):
    frame = bronze(event(), event(user_id=" "), event(sku=""), event(event_type=" purchase"))
    typed = Q.with_checks(C.accepted(C.cleanse(frame, "2026-01-10T00:00:00Z")))
    raw = C.inspect(frame).filter("reason IS NULL")
    key = lambda row: (row["source_key"], row["checks"])
    assert sorted(map(key, typed.collect())) == sorted(map(key, raw.collect()))


def test_failing_and_passing_rows(bronze, event):
    checked = C.inspect(bronze(event(), event(user_id="", quantity="x")))
    assert Q.failing(checked).first()["reason"] == "required_dimensions+quantity_and_amount_sane+schema_valid"
    assert Q.passing(checked).count() == 1


def test_report_lists_every_check(bronze, event):
    row = Q.report(Q.tally(C.inspect(bronze(event(event_id="")))), "run-1").first()
    assert [c["check_name"] for c in row["checks"] if not c["passed"]] == ["event_id_present"]
    assert len(row["checks"]) == 5 and row["fail_ratio"] == 1.0


def test_unknown_mode_is_an_error(bronze, event):
    import pytest

    with pytest.raises(ValueError):
        gate(bronze(event()), on_fail="ignore")


def test_summary_lists_failing_ids(bronze, event):
    decision, reasons = Q.summary(C.inspect(bronze(event(), event(event_id="bad", quantity=0), event(event_id=5, sku=""))))
    assert decision.first()["rows_failed"] == 2
    assert {(r["event_id"], tuple(r["reasons"])) for r in reasons.collect()} == {
        ("bad", ("quantity_and_amount_sane",)), ("", ("required_dimensions", "schema_valid")),
    }
