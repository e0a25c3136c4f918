"""Quality and readiness of layers, comparison of sources, contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of validation results.
SPELLINGS = {"passed": ("pass", "ok", "success", "valid"), "warning": ("warn", "warning"), "failed": ("fail", "failed", "error", "invalid")}
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}
OUTCOMES = ("matched", "source_only", "conflicting", "ambiguous", "not_comparable")
#: Degrees within which two features of one type are the same.
SAME_PLACE = 0.0001
#: Width of the cells in which places meet, in SAME_PLACE.
CELL = 4


def quality_status(raw: Column) -> Column:
    s = F.translate(F.lower(F.trim(raw)), "- ", "__")
    out = F.when(s.isin(*SPELLINGS["passed"]), "passed")
    for k in ("warning", "failed"):
        out = out.when(s.isin(*SPELLINGS[k]), k)
    return out.otherwise("unknown")


def readiness(quality: Column, count: Column, source_type: Column, severity: Column, comparison: Column) -> Column:
    """First match: an overlay needs a source; what is empty, failed or has a grave issue cannot be used; and so on down to ready."""
    odd = F.coalesce(severity.isin("low", "medium"), F.lit(False)) | F.coalesce(comparison.isin("conflicting", "source_only", "ambiguous"), F.lit(False))
    return (F.when(~F.coalesce(source_type.isin("analytical_vector", "manual_seed"), F.lit(False)), "needs_source")
            .when(F.coalesce(severity == "high", F.lit(False)) | (count == 0) | (quality == "failed"), "not_usable").when(~quality.isin("passed", "warning"), "needs_source")
            .when((source_type == "manual_seed") | (quality == "warning") | odd, "usable_with_limitations").otherwise("ready"))


VECTORS = ("analytical_vector", "manual_seed")


class Rule:
    """A rule over one layer summary row: for which source types, how grave, when it fires."""

    def __init__(self, name: str, code: str, severity: str, types: tuple[str, ...], fires):
        self.name, self.code, self.severity, self.types, self.fires = name, code, severity, types, fires


RULES = [
    Rule("layer.empty", "EMPTY", "high", VECTORS, lambda: F.col("feature_count") == 0),
    Rule("geometry.invalid", "INVALID-GEOMETRY", "high", VECTORS, lambda: F.col("invalid_geometry_count") > 0),
    Rule("attributes.missing_required", "MISSING-ATTRIBUTES", "medium", VECTORS[:1], lambda: F.col("missing_attribute").isNotNull()),
    Rule("features.duplicates", "DUPLICATES", "medium", VECTORS[:1], lambda: F.col("duplicate_count") > 0),
    Rule("geometry.unsupported", "UNSUPPORTED-GEOMETRY", "medium", VECTORS, lambda: F.col("unsupported_geometry").isNotNull()),
    Rule("source.inconsistent", "SOURCE-METADATA", "high", (), lambda: ~F.col("source_metadata_valid")),
    Rule("validation.status", "QUALITY", "medium", VECTORS, lambda: F.col("quality") != "passed"),
    Rule("manual.non_authoritative", "NON-AUTHORITATIVE", "medium", VECTORS[1:], lambda: F.col("feature_count") > 0),
    Rule("reference.overlay", "REFERENCE-ONLY", "medium", ("reference_overlay",), lambda: F.lit(True)),
]
#: Layers whose issues keep names from before.
OLD_IDS = {("manual.power.seeds", "manual.non_authoritative"): "DQ-MANUAL-SEEDS-NON-AUTHORITATIVE", ("external.kiut_wms", "reference.overlay"): "DQ-KIUT-WMS-REFERENCE-ONLY"}


def evaluate_rules(layers: DataFrame) -> DataFrame:
    """A row for each layer and rule with its outcome: not_applicable, passed or triggered. One pass, no join: rules are conditions of the row."""
    rows = []
    for r in RULES:
        outcome = F.when(F.coalesce(r.fires(), F.lit(False)), "triggered").otherwise("passed")
        if r.types:
            outcome = F.when(~F.coalesce(F.col("source_type").isin(*r.types), F.lit(False)), "not_applicable").otherwise(outcome)
        rows.append(F.struct(F.lit(r.name).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), outcome.alias("outcome")))
    return layers.withColumn("_r", F.explode(F.array(*rows))).select("*", "_r.*").drop("_r")


def issue_id(layer: Column, rule: Column, code: Column) -> Column:
    out = None
    for (a, b), name in OLD_IDS.items():
        test = (layer == a) & (rule == b)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.concat(F.lit("DQ-"), F.upper(F.translate(layer, ".", "-")), F.lit("-"), code))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for k, v in SEVERITY_RANK.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left feature with its candidate: the one of equal stable id, else the nearest one within SAME_PLACE, else none.

    Places meet by grid cell: the right side is in each cell that has places within SAME_PLACE of it, mostly one, since cells are wider than that."""
    by_id = left.where("stable_id is not null").join(right.where("stable_id is not null").groupBy("stable_id").agg(F.min("id").alias("right_id")), "stable_id").select("id", "right_id", F.lit("stable_id").alias("how"))
    rest = left.join(by_id.select("id"), "id", "left_anti")
    cell = lambda c: F.floor(F.col(c) / SAME_PLACE).cast("long")
    wide = lambda c, d=0.0: F.floor((F.col(c) + d) / (CELL * SAME_PLACE)).cast("long")
    room = SAME_PLACE * (1 + 1e-6)
    near = right.select(F.col("id").alias("right_id"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.explode(F.sequence(wide("lon", -room), wide("lon", room))).alias("ci"))
    near = near.withColumn("cj", F.explode(F.sequence(wide("rlat", -room), wide("rlat", room))))
    met = rest.withColumn("ci", wide("lon")).withColumn("cj", wide("lat")).join(near, ["ci", "cj"])
    met = met.where((F.abs(cell("lon") - cell("rlon")) <= 1) & (F.abs(cell("lat") - cell("rlat")) <= 1))
    d = F.hypot(F.col("lon") - F.col("rlon"), F.col("lat") - F.col("rlat"))
    by_place = met.where(d <= SAME_PLACE).groupBy("id").agg(F.min(F.struct(F.round(d, 8).alias("d"), "right_id")).alias("m")).select("id", F.col("m.right_id").alias("right_id"), F.lit("place").alias("how"))
    return by_id.unionByName(by_place)


def compare(pairs_: DataFrame) -> DataFrame:
    """The outcome of each pair: columns l_* and r_* of both features, l_fit and r_fit for sources that may be compared."""
    d = F.hypot(F.col("l_lon") - F.col("r_lon"), F.col("l_lat") - F.col("r_lat"))
    return pairs_.withColumn("distance", F.round(d, 8)).withColumn("outcome",
        F.when(F.col("r_source").isNull(), "source_only").when(~(F.col("l_fit") & F.col("r_fit")), "not_comparable").when(F.coalesce(F.col("l_stable") == F.col("r_stable"), F.lit(False)), "matched")
        .when(F.col("l_type").isNull() | F.col("r_type").isNull() | F.col("l_lon").isNull() | F.col("r_lon").isNull(), "ambiguous").when(F.col("l_type") != F.col("r_type"), "conflicting")
        .when(d <= SAME_PLACE, "matched").otherwise("source_only"))


def latest(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The row of each group that is greatest by the columns of ``order``. A maximum combines before the shuffle, so a group that holds most rows is one row a partition."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


CONTRACT = "provider_geojson/v1"
READINESS = ("ready", "usable_with_limitations", "needs_source", "not_usable")
CONFIDENCE = ("high", "medium", "low", "not_applicable")


def contract_violations(meta: DataFrame) -> Column:
    """Stable codes of what is wrong with a metadata row."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    zone = F.coalesce(F.col("snapshot_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), F.lit(False))
    tests = [("aoi_id", blank("aoi_id")), ("contract_version", ~F.coalesce(F.col("contract_version") == CONTRACT, F.lit(False))), ("readiness", ~F.coalesce(F.col("readiness").isin(*READINESS), F.lit(False))),
             ("confidence", ~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False))), ("feature_count", ~F.coalesce(F.col("feature_count") >= 0, F.lit(False))), ("snapshot_at", ~zone)]
    return F.array_compact(F.array(*[F.when(t, f"metadata.{n}") for n, t in tests]))


def feature_violations() -> Column:
    """Stable codes of what is wrong with a feature row; what is missing of its frame ends the check."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    code = lambda test, name: F.when(test, F.lit(name))
    fields = []
    for f in ("source", "source_id", "domain", "asset_type"):
        fields += [code(F.col(f).isNull(), f"properties.missing:{f}"), code(F.col(f).isNotNull() & ~said(F.col(f)), f"properties.{f}")]
    fields += [code(F.col("confidence").isNull(), "properties.missing:confidence"), code(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "properties.confidence"), code(~F.col("missing_is_list"), "properties.missing_fields"),
               code(~F.col("limits_is_list"), "properties.limitations"), code(F.col("eligible_for_analysis").isNull(), "properties.eligible_for_analysis")]
    return (F.when(F.col("type") != "Feature", F.array(F.lit("type"))).when(~said(F.col("geometry_type")) | F.col("coordinates").isNull(), F.array(F.lit("geometry")))
            .when(~F.col("has_properties"), F.array(F.lit("properties"))).otherwise(F.array_compact(F.array(*fields))))


def validate_layers(features: DataFrame, expected: DataFrame) -> DataFrame:
    """A report for each expected layer (layer, expected: the geometry types it may hold): counts, types, what is unexpected, empty, invalid or outside, and the status. ``features``
    has layer, gtype, n_points, self_crossing and outside. One pass; types are counted first, so a layer's histogram is a row for each type."""
    empty, gtype = F.col("n_points") == 0, F.coalesce("gtype", F.lit("None"))
    by = features.groupBy("layer", gtype.alias("gtype")).agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.count_if(F.col("self_crossing")).alias("invalid"), F.count_if(F.col("outside")).alias("outside"))
    g = by.groupBy("layer").agg(F.sum("n").alias("feature_count"), F.array_sort(F.collect_list(F.struct("gtype", "n"))).alias("types"), F.sum("empty").alias("empty"), F.sum("invalid").alias("invalid"), F.sum("outside").alias("outside"))
    d = expected.join(g, "layer", "left").fillna(0, ["feature_count", "empty", "invalid", "outside"])
    odd = F.array_except(F.transform(F.coalesce("types", F.array().cast("array<struct<gtype:string,n:bigint>>")), lambda x: x["gtype"]), F.col("expected"))
    d = d.withColumn("unexpected", F.array_join(odd, ",")).withColumn("types", F.array_join(F.transform("types", lambda x: F.concat_ws(":", x["gtype"], x["n"].cast("string"))), ","))
    status = F.when(F.col("feature_count") == 0, "warn").when((F.col("unexpected") != "") | (F.col("empty") > 0), "fail").when((F.col("invalid") > 0) | (F.col("outside") > 0), "warn").otherwise("pass")
    return d.withColumn("status", status)


BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def validation_report(features: DataFrame, expected: DataFrame, landed: DataFrame) -> DataFrame:
    """A report for each expected layer (layer, expected: the geometry types it may hold) of the layers that have ``landed``: counts, types, box, codes of errors and warnings, and the status.

    A layer that has not landed is an error, one that has landed without features a warning; so are features that are invalid or outside, while geometries that are empty or of a type not expected are errors. A feature without
    geometry has type None and counts as empty and invalid. ``features`` has layer, gtype, n_points, self_crossing, outside and the box of each; rows of layers that are not expected play no part, those of a layer that has not
    landed neither. Boxes are of what has one, null otherwise. One pass with partial sums for each layer and type."""
    gone = F.col("gtype").isNull()
    flag = lambda c: F.coalesce(c, F.lit(False))
    each = {"n": F.count("*"), "empty": F.count_if(gone | (F.coalesce("n_points", F.lit(0)) == 0)), "invalid": F.count_if(gone | flag(F.col("self_crossing"))), "outside": F.count_if(flag(F.col("outside")))}
    box = {c: (F.min if c.startswith("min") else F.max)(c) for c in BOX}
    by = features.groupBy("layer", F.coalesce("gtype", F.lit("None")).alias("gtype")).agg(*[v.alias(k) for k, v in (each | box).items()])
    g = by.groupBy("layer").agg(F.sum("n").alias("feature_count"), F.array_sort(F.collect_list(F.struct("gtype", "n"))).alias("by_type"), *[F.sum(c).alias(c) for c in ("empty", "invalid", "outside")], *[v.alias(k) for k, v in box.items()])
    d = expected.join(landed.select("layer", F.lit(True).alias("landed")).distinct(), "layer", "left").withColumn("landed", flag(F.col("landed")))
    d = d.join(g.withColumnRenamed("layer", "of"), (F.col("layer") == F.col("of")) & F.col("landed"), "left").fillna(0, ["feature_count", "empty", "invalid", "outside"])
    types = F.coalesce("by_type", F.array().cast("array<struct<gtype:string,n:bigint>>"))
    d = d.withColumn("types", F.array_join(F.transform(types, lambda x: F.concat_ws(":", x["gtype"], x["n"].cast("string"))), ",")).withColumn("unexpected", F.array_join(F.array_except(F.transform(types, lambda x: x["gtype"]), F.col("expected")), ","))
    codes = lambda *cs: F.array_join(F.array_compact(F.array(*[F.when(c, code) for c, code in cs])), ",")
    errors = codes((~F.col("landed"), "file_missing"), (F.col("unexpected") != "", "unexpected_geometry_types"), (F.col("empty") > 0, "empty_geometries"))
    warnings = codes((F.col("landed") & (F.col("feature_count") == 0), "empty_layer"), (F.col("invalid") > 0, "invalid_geometries"), (F.col("outside") > 0, "features_outside_aoi"))
    d = d.withColumns({"errors": errors, "warnings": warnings})
    status = F.when(F.col("errors") != "", "fail").when(F.col("warnings") != "", "warn").otherwise("pass")
    return d.select("layer", "landed", "feature_count", "types", "unexpected", "empty", "invalid", "outside", *BOX, "errors", "warnings", status.alias("status"))
