from __future__ import annotations

from tidemark.operators import contracts as CT
from tidemark.schemas import BRONZE_CONTRACT, GOLD_CONTRACT


def codes(frame):
    return {(r["code"], r["field"]) for r in frame.collect()}


def test_conforming_row(bronze, event):
    assert CT.violations(bronze(event(extra=1)), BRONZE_CONTRACT).count() == 0


def test_row_violations(bronze, event):
    bad = event(event_type="click", quantity="2", amount_usd=True, sku=None, country=5, event_ts="2026-01-02")
    del bad["user_id"]
    assert codes(CT.violations(bronze(bad), BRONZE_CONTRACT)) == {
        ("enum_mismatch", "event_type"), ("type_mismatch", "quantity"), ("type_mismatch", "amount_usd"),
        ("missing_required", "sku"), ("type_mismatch", "country"), ("type_mismatch", "event_ts"), ("missing_required", "user_id"),
    }


def test_violation_counts(bronze, event):
    found = CT.violations(bronze(event(sku=None), event(sku=None), event(quantity=1.5)), BRONZE_CONTRACT)
    got = {tuple(r) for r in CT.violation_counts(found).collect()}
    assert got == {("missing_required", "sku", 2), ("type_mismatch", "quantity", 1)}


def test_gold_contract_date(bronze):
    row = {"dt": "2026-01-02", "event_type": "purchase", "events": 1, "amount_usd": 2}
    assert CT.violations(bronze(row, {**row, "dt": "2026-1-2"}), GOLD_CONTRACT).count() == 1


def contract(**fields):
    spec = {"fields": []}
    for name, (type_, required, enum) in fields.items():
        spec["fields"].append({"name": name, "type": type_, "required": required, "enum": enum})
    return spec


def changes(spark, old, new):
    found = CT.compare_profiles(CT.contract_profile(spark, old), CT.contract_profile(spark, new))
    return {(r["severity"], r["code"], r["field"], r["detail"]) for r in found.collect()}


def test_identical_contracts(spark):
    assert changes(spark, BRONZE_CONTRACT, BRONZE_CONTRACT) == set()


def test_all_drift_rules(spark):
    old = contract(
        gone=("string", True, None), gone_opt=("string", False, None), narrowed=("number", True, None),
        widened=("integer", True, None), date=("date", True, None), stricter=("string", False, None), looser=("string", True, None),
        enum=("string", True, ["a", "b"]), freed=("string", True, ["a"]), bound=("string", True, None),
    )
    new = contract(
        narrowed=("integer", True, None), widened=("number", True, None), date=("string", True, None),
        stricter=("string", True, None), looser=("string", False, None), enum=("string", True, ["b", "c", "d"]),
        freed=("string", True, None), bound=("string", True, ["a"]), extra=("string", True, None), extra_opt=("string", False, None),
    )
    assert changes(spark, old, new) == {
        ("breaking", "removed_field", "gone", ""), ("additive", "removed_optional_field", "gone_opt", ""),
        ("breaking", "type_change", "narrowed", "number -> integer"), ("additive", "widened_type", "widened", "integer -> number"),
        ("additive", "widened_type", "date", "date -> string"), ("breaking", "became_required", "stricter", ""),
        ("additive", "no_longer_required", "looser", ""), ("breaking", "enum_values_removed", "enum", "a"),
        ("additive", "enum_values_added", "enum", "c, d"), ("breaking", "enum_removed", "freed", ""),
        ("breaking", "enum_added_to_free_field", "bound", ""), ("breaking", "added_required_field", "extra", ""),
        ("additive", "added_optional_field", "extra_opt", ""),
    }


def test_name_lists(spark):
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "name STRING")
    got = CT.compare_names(names("a", "b"), names("b", "c"), "check_removed", "check_added").collect()
    assert {(r["field"], r["severity"], r["code"]) for r in got} == {("a", "breaking", "check_removed"), ("c", "additive", "check_added")}


def test_data_profile(bronze):
    rows = bronze({"a": 1, "b": "x", "c": True, "d": "2026-01-02", "e": "2026-01-02T00:00:00Z", "o": {}},
                  {"a": 2.5, "b": "y", "c": None, "d": "2026-01-03", "e": "2026-01-02T00:00:00Z"}, "junk")
    got = {r["field"]: (r["type"], r["required"], r["enum"]) for r in CT.data_profile(rows, enum_fields=("b", "a"), max_enum=2).collect()}
    assert got == {
        "a": ("number", True, ["1", "2.5"]), "b": ("string", True, ["x", "y"]), "c": ("boolean", False, None),
        "d": ("date", True, None), "e": ("datetime", True, None), "o": ("object", False, None),
    }
    free = CT.data_profile(rows, enum_fields=("b",), max_enum=1).filter("field = 'b'").first()
    assert free["enum"] is None


def test_thousands_of_enumerated_values(bronze):
    old = bronze(*({"k": f"v{i:05d}"} for i in range(5000)))
    new = bronze(*({"k": f"v{i:05d}"} for i in range(2, 5001)))
    assert CT.data_profile(old, enum_fields=("k",)).first()["enum"] == [f"v{i:05d}" for i in range(5000)]
    want = {("breaking", "enum_values_removed", "k", "v00000, v00001"), ("additive", "enum_values_added", "k", "v05000")}
    by_rows = CT.compare_observed(CT.observed(old, enum_fields=("k",)), CT.observed(new, enum_fields=("k",)))
    by_sets = CT.compare_profiles(CT.data_profile(old, enum_fields=("k",)), CT.data_profile(new, enum_fields=("k",)))
    for found in (by_rows, by_sets):
        assert {(r["severity"], r["code"], r["field"], r["detail"]) for r in found.collect()} == want


def test_data_tests(spark):
    frame = spark.createDataFrame([("a", 1), ("a", None), ("x", 2), (None, None)], "k STRING, v INT")
    got = {(r["test"], r["column_name"]): r["failures"] for r in CT.not_null(frame, "m", ("k", "v"))
           .unionByName(CT.unique(frame, "m", "k")).unionByName(CT.accepted_values(frame, "m", "k", ("a", "b"))).collect()}
    assert got == {("not_null", "k"): 1, ("not_null", "v"): 2, ("unique", "k"): 1, ("accepted_values", "k"): 1}
