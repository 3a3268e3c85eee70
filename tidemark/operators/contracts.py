"""Row conformance, field profiles, schema drift, data tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import payload as P
from tidemark.functions.once import evaluate_once
from tidemark.schemas import TYPE_WIDENS_TO
from tidemark.session import materialize


def _matches(value: Column, label: Column, type_: str) -> Column:
    number = label.startswith("DECIMAL") | label.isin("DOUBLE", "FLOAT")
    text = F.try_variant_get(value, "$", "string")
    rules = {
        "string": label == "STRING",
        "integer": label == "BIGINT",
        "number": (label == "BIGINT") | number,
        "boolean": label == "BOOLEAN",
        "datetime": (label == "STRING") & text.contains("T"),
        "date": (label == "STRING") & (F.length(text) == 10),
    }
    return rules.get(type_, F.lit(True))


def _issue(code: str, name: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), message.alias("message"))


def violations(rows: DataFrame, contract: dict, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per contract violation of each JSON record.

    A required field must be present and not null; a present one must have its
    type and, for text with an enumeration, one of its values.
    """
    parsed = P.with_document(rows.select(*{*keep, raw}), raw, "_doc")
    fields = contract["fields"]
    values = evaluate_once(
        parsed.select(*keep, *[P.field(F.col("_doc"), f["name"]).alias(f"_{f['name']}") for f in fields])
    )
    issues = []
    for spec in fields:
        name, value = spec["name"], F.col(f"_{spec['name']}")
        label = P.kind(value)
        present = value.isNotNull() & (label != "VOID")
        if spec["required"]:
            issues.append(F.when(~present, _issue("missing_required", name, F.lit(name))))
        issues.append(
            F.when(
                present & ~_matches(value, label, spec["type"]),
                _issue("type_mismatch", name, F.concat(F.lit(f"{name} expected {spec['type']} got "), F.lower(label))),
            )
        )
        if spec["enum"]:
            text = F.try_variant_get(value, "$", "string")
            issues.append(
                F.when(
                    (label == "STRING") & ~text.isin(*spec["enum"]),
                    _issue("enum_mismatch", name, F.concat(F.lit(f"{name}="), text)),
                )
            )
    found = F.filter(F.array(*issues), lambda issue: issue.isNotNull())
    return values.select(*keep, F.inline(found))


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "field").agg(F.count(F.lit(1)).alias("violations"))


def contract_profile(spark: SparkSession, contract: dict) -> DataFrame:
    """Field profile of a declared contract."""
    rows = [
        (f["name"], f["type"], bool(f["required"]), sorted(f["enum"]) if f["enum"] else None)
        for f in contract["fields"]
    ]
    return spark.createDataFrame(rows, "field STRING, type STRING, required BOOLEAN, enum ARRAY<STRING>")


def data_profile(
    rows: DataFrame, raw: str = "raw", enum_fields: tuple[str, ...] = (), max_enum: int | None = None
) -> DataFrame:
    """Field profile observed in JSON records.

    A field's type is the widest kind seen (mixed kinds read as string); it is
    required when present and not null in every record. ``enum_fields`` get the
    set of their values, all of them unless the caller sets ``max_enum``, beyond
    which a field is free.
    """
    profile, values = observed(rows, raw, enum_fields)
    if not enum_fields:
        return profile.withColumn("enum", F.lit(None).cast("array<string>"))
    sets = values.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("enum"))
    if max_enum is not None:
        sets = sets.filter(F.size("enum") <= max_enum)
    return profile.join(sets, "field", "left")


def observed(rows: DataFrame, raw: str = "raw", enum_fields: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(field, type, required) of JSON records as in data_profile, and the (field, value) rows of ``enum_fields``."""
    cells = materialize(_profile_cells(rows, raw, enum_fields), "profile")
    types = F.array_sort(F.collect_set("type"))
    by_field = cells.filter(F.col("field").isNotNull()).groupBy("field").agg(
        F.sum(F.when(F.col("type").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("present"), types.alias("types")
    )
    widest = (
        F.when(F.size("types") == 1, F.col("types")[0])
        .when(F.col("types") == F.array(F.lit("integer"), F.lit("number")), "number")
        .when(F.col("types") == F.array(F.lit("date"), F.lit("datetime")), "datetime")
        .otherwise("string")
    )
    records = cells.filter(F.col("field").isNull()).agg(F.sum("n").alias("n"))
    profile = by_field.select(
        "field", widest.alias("type"), (F.col("present") == records.scalar()).alias("required")
    )
    return profile, cells.filter(F.col("value").isNotNull()).select("field", "value").distinct()


def _profile_cells(rows: DataFrame, raw: str, enum_fields: tuple[str, ...]) -> DataFrame:
    """Records per (field, type, enumerated value), from one pass over the JSON.

    Each record adds one cell without a field, so the record count comes along.
    """
    docs = evaluate_once(P.with_document(rows.select(raw), raw, "doc"), "doc")
    docs = docs.filter(P.kind(F.col("doc")).startswith("OBJECT"))
    entries = F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))
    whole = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))
    items = docs.select(F.inline(F.concat(F.array(whole), entries))).select(
        F.col("key").alias("field"), "value", P.kind(F.col("value")).alias("label")
    )
    label, text = F.col("label"), F.try_variant_get("value", "$", "string")
    type_ = (
        F.when(label == "BIGINT", "integer")
        .when(label.startswith("DECIMAL") | label.isin("DOUBLE", "FLOAT"), "number")
        .when(label == "BOOLEAN", "boolean")
        .when((label == "STRING") & text.rlike(P.ISO_TEXT) & text.contains("T"), "datetime")
        .when((label == "STRING") & text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(label == "STRING", "string")
        .when(label != "VOID", "object")
    )
    listed = F.col("field").isin(*enum_fields) if enum_fields else F.lit(False)
    return items.groupBy("field", type_.alias("type"), F.when(listed, text).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _enum_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, had, has, gone, added) of (field, value) rows: only values of one side are gathered."""
    sides = old.select("field", "value", F.lit(True).alias("was"), F.lit(False).alias("now")).unionByName(
        new.select("field", "value", F.lit(False).alias("was"), F.lit(True).alias("now"))
    )
    values = sides.groupBy("field", "value").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now"))
    only = lambda here, there: F.collect_list(F.when(F.col(here) & ~F.col(there), F.col("value")))
    return values.groupBy("field").agg(
        F.bool_or("was").alias("had"),
        F.bool_or("now").alias("has"),
        only("was", "now").alias("gone"),
        only("now", "was").alias("added"),
    )


def compare_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking and additive changes between two field profiles with their value sets in ``enum``."""
    listed = lambda profile: profile.select("field", F.explode("enum").alias("value"))
    return compare_observed((old, listed(old)), (new, listed(new)))


def compare_observed(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Breaking and additive changes between two field profiles and their (field, value) rows."""
    enums = _enum_changes(old[1], new[1])
    o, n = old[0].alias("o"), new[0].alias("n")
    both = o.join(n, F.col("o.field") == F.col("n.field"), "full_outer")
    field = F.coalesce(F.col("o.field"), F.col("n.field"))
    both = both.join(enums.alias("e"), field == F.col("e.field"), "left")
    in_old, in_new = F.col("o.field").isNotNull(), F.col("n.field").isNotNull()
    kept = in_old & in_new
    was, now = F.col("o.type"), F.col("n.type")
    widened = F.lit(False)
    for source, targets in TYPE_WIDENS_TO.items():
        widened = widened | ((was == source) & now.isin(*targets))
    must_old, must_new = F.col("o.required"), F.col("n.required")
    gone, added = F.col("e.gone"), F.col("e.added")
    had, has = F.coalesce("e.had", F.lit(False)), F.coalesce("e.has", F.lit(False))

    def change(severity: str, code: str, detail: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))

    arrow = F.concat(was, F.lit(" -> "), now)
    nothing = F.lit("")
    listed = lambda items: F.array_join(F.array_sort(items), ", ")
    rules = [
        (in_old & ~in_new & must_old, change("breaking", "removed_field", nothing)),
        (in_old & ~in_new & ~must_old, change("additive", "removed_optional_field", nothing)),
        (kept & (was != now) & ~widened, change("breaking", "type_change", arrow)),
        (kept & (was != now) & widened, change("additive", "widened_type", arrow)),
        (kept & ~must_old & must_new, change("breaking", "became_required", nothing)),
        (kept & must_old & ~must_new, change("additive", "no_longer_required", nothing)),
        (kept & had & has & (F.size(gone) > 0), change("breaking", "enum_values_removed", listed(gone))),
        (kept & had & has & (F.size(added) > 0), change("additive", "enum_values_added", listed(added))),
        (kept & had & ~has, change("breaking", "enum_removed", nothing)),
        (kept & ~had & has, change("breaking", "enum_added_to_free_field", nothing)),
        (~in_old & must_new, change("breaking", "added_required_field", nothing)),
        (~in_old & ~must_new, change("additive", "added_optional_field", nothing)),
    ]
    found = F.filter(F.array(*[F.when(test, row) for test, row in rules]), lambda row: row.isNotNull())
    return both.select(field.alias("field"), F.inline(found))


def compare_names(old: DataFrame, new: DataFrame, removed: str, added: str) -> DataFrame:
    """Set differences of two one-column name lists, as breaking and additive rows.

    Serves Hive keys and gate checks: a name that goes is breaking, one that
    comes is additive.
    """
    name = old.columns[0]
    gone = old.exceptAll(new).select(F.col(name).alias("field"), F.lit("breaking").alias("severity"), F.lit(removed).alias("code"))
    came = new.exceptAll(old).select(F.col(name).alias("field"), F.lit("additive").alias("severity"), F.lit(added).alias("code"))
    return gone.unionByName(came)


def not_null(df: DataFrame, model: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with a NULL in each column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns]
    return counts.select(F.lit(model).alias("model"), F.lit("not_null").alias("test"), F.inline(F.array(*rows)))


def unique(df: DataFrame, model: str, column: str) -> DataFrame:
    """Values of a column that occur more than once."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter(F.col("count") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(model).alias("model"), F.lit("unique").alias("test"), F.lit(column).alias("column_name"), "failures"
    )


def accepted_values(df: DataFrame, model: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Distinct values of a column outside the accepted list."""
    outside = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).select(column).distinct()
    return outside.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(model).alias("model"), F.lit("accepted_values").alias("test"), F.lit(column).alias("column_name"), "failures"
    )
