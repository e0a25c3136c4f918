"""Layers: assignment, normalisation to the feature contract, presentation, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tags import voltage_label, voltage_style

LINES = ("LineString", "MultiLineString")
#: Domains whose layers all exist as soon as one of them has a feature.
WHOLE = {"telecom": ("towers", "facilities", "lines"), "district_heating": ("plants", "facilities", "lines")}
POWER_GROUPS = {
    "power_major_lines": ("line",), "power_minor_lines": ("minor_line",), "power_cables": ("cable",), "power_busbars": ("busbar", "bay"), "power_substations": ("substation",),
    "power_transformers": ("transformer",), "power_plants": ("plant",), "power_generators": ("generator",), "power_supports": ("tower", "pole", "portal", "utility_pole"),
    "power_switchgear": ("switch", "terminal", "converter", "compensator"),
}
DISPLAYED = ("substation", "transformer", "plant", "switch", "terminal", "converter", "compensator")


def layer_id(domain: Column, category: Column, gtype: Column) -> Column:
    """power by geometry, emergency as one layer, the others by category."""
    return (F.when(domain == "power", F.when(gtype.isin(*LINES), "power.lines").otherwise("power.assets"))
            .when(domain == "emergency", "emergency.facilities").otherwise(F.concat_ws(".", domain, category)))


def layer_counts(features: DataFrame) -> DataFrame:
    """``features`` (domain, category, gtype) counted by layer; empty layers of telecom and heating stay visible next to filled ones."""
    n = features.withColumn("layer_id", layer_id(F.col("domain"), F.col("category"), F.col("gtype"))).groupBy("domain", "layer_id").agg(F.count("*").alias("n"))
    rows = [(d, f"{d}.{c}") for d, cs in WHOLE.items() for c in cs]
    dim = features.sparkSession.createDataFrame(rows, "domain string, layer_id string")
    empty = dim.join(n.select("domain").distinct(), "domain", "left_semi").join(n, ["domain", "layer_id"], "left_anti")
    return n.unionByName(empty.withColumn("n", F.lit(0).cast("long")))


def power_sublayer(category: Column) -> Column:
    m = F.create_map(*[F.lit(x) for layer, cs in POWER_GROUPS.items() for c in cs for x in (c, layer)])
    return m[category]


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize(features: DataFrame) -> DataFrame:
    """The contract's identity columns: ``source_id`` from element and id, ``asset_type`` from the first of provider category, power category and power tag that is not blank.

    Rows without an id have a null ``source_id`` and ``id_error`` true."""
    asset = F.coalesce(_said(F.col("provider_category")), _said(F.col("power_category")), _said(F.col("tags")["power"]), F.lit("unknown"))
    key = _said(F.col("id").cast("string"))
    return (features.withColumn("source_id", F.when(key.isNotNull(), F.concat_ws("/", F.coalesce(_said(F.col("element")), F.lit("feature")), key)))
            .withColumn("asset_type", asset).withColumn("id_error", key.isNull()).withColumn("missing_fields", missing_fields(asset, F.col("tags"))))


def missing_fields(asset: Column, tags: Column) -> Column:
    """Lines and cables need a voltage."""
    return F.when(asset.isin("line", "minor_line", "cable") & _said(tags["voltage"]).isNull(), F.array(F.lit("voltage"))).otherwise(F.array().cast("array<string>"))


def attribute_containers(features: DataFrame, official: Column) -> DataFrame:
    """Tags of official sources move to ``source_attributes``, all others to ``osm_tags``."""
    return features.withColumn("source_attributes", F.when(official, F.col("tags"))).withColumn("osm_tags", F.when(~official, F.col("tags")))


# The fields of a presentation row.
PRESENTATION = ("source", "source_id", "domain", "asset_type", "road_class", "voltage_state", "voltage_bucket", "voltage_label", "name", "ref", "operator", "confidence", "missing_fields", "limitations")


def presentation(features: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the fields of PRESENTATION as text, for features (source, source_id, domain, asset_type, road_class, confidence, name, ref, operator, missing_fields, limitations, tags; arrays and map may be null).

    Source, domain, confidence and limitations that a feature does not state come from the ``metadata`` of its layer (layer_id, and these four); name, ref and operator of the tags come before those of the feature; the voltage fields follow from the tags. Texts of lists are joined by ``; `` and ``, ``."""
    m = metadata.select(F.col("layer_id").alias("_l"), *[F.col(k).alias(f"_{k}") for k in ("source", "domain", "confidence", "limitations")])
    d = features.join(m, F.col("layer_id") == F.col("_l"))
    volts = d.withColumn("_v", voltage_style(F.col("tags")["voltage"]))
    said = lambda k: F.coalesce(F.col(k).cast("string"), F.col(f"_{k}").cast("string"))
    own = {"source": said("source"), "domain": said("domain"), "confidence": said("confidence"), "limitations": F.array_join(F.coalesce("limitations", "_limitations"), "; "), "missing_fields": F.coalesce(F.array_join("missing_fields", ", "), F.lit("")),
           "voltage_state": F.col("_v.state"), "voltage_bucket": F.col("_v.bucket"), "voltage_label": voltage_label(F.col("tags")["voltage"])}
    own |= {k: F.coalesce(F.col("tags")[k], F.col(k).cast("string")) for k in ("name", "ref", "operator")}
    return volts.select(*keys, *[own.get(k, F.col(k).cast("string")).alias(k) for k in PRESENTATION if k not in keys])


def min_zoom(asset: Column) -> Column:
    return F.when(asset.isin("tower", "portal", "utility_pole"), 12).when(asset == "pole", 14).otherwise(7)


def public_artifacts(artifacts: DataFrame) -> DataFrame:
    """Files that the public may see: exported GeoJSON vectors with a path, a checksum and a count."""
    return artifacts.where(F.col("public_export") & (F.col("format") == "geojson") & F.col("kind").isin("processed_vector", "derived_vector", "representative_points")
                           & F.col("path").isNotNull() & F.col("sha256").isNotNull() & F.col("feature_count").isNotNull())


def layer_digest(features: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """A digest that does not depend on row order, and a count, for each layer: the sums of row hashes in 128 bits.

    The sum combines before the shuffle, so a large layer is never gathered in one place."""
    text = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in row]), 256)
    part = [F.conv(F.substring(text, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(3)]
    sums = features.groupBy(*by).agg(F.count("*").alias("feature_count"), *[F.sum(p).alias(f"_{i}") for i, p in enumerate(part)])
    return sums.select(*by, "feature_count", F.sha2(F.concat_ws(":", F.col("feature_count").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(3)]), 256).alias("digest"))


# What a seed record may say.
SEED_VALUES = {"kind": ("substation", "line", "plant", "transformer", "generator"), "confidence": ("low", "medium", "high"), "review_status": ("needs_review", "reviewed", "rejected"), "geometry_type": ("Point", "LineString")}
SEED_FIELDS = ("name", "domain", "operator", "source_note", "created_at", "lon", "lat")


def seed_problems(seeds: DataFrame) -> DataFrame:
    """``seed_id, code``: fields that are missing or blank, values outside of the closed lists, a voltage that is none, a seed that claims authority, ids that several seeds share."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    tests = [(c, blank(c)) for c in SEED_FIELDS] + [(c, ~F.coalesce(F.col(c).isin(*v), F.lit(False))) for c, v in SEED_VALUES.items()]
    tests += [("voltage_estimate", F.coalesce(F.col("voltage_estimate") <= 0, F.lit(True))), ("not_authoritative", ~F.coalesce("not_authoritative", F.lit(False)))]
    own = seeds.select("seed_id", F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))).alias("code"))
    twice = seeds.groupBy("seed_id").count().where("count > 1").select("seed_id", F.lit("duplicate").alias("code"))
    return own.unionByName(twice)


# Classes of the topographic database (role, geometry family, label), and types of the register of borders (class, role, is it a boundary).
TOPOGRAPHIC_CLASSES = [
    ("OT_SKDR_L", "transport", "line", "road"),
    ("OT_BUIN_L", "bridge_context", "line", "engineering_structure"),
    ("OT_SWRS_L", "water_context", "line", "river_or_stream"),
    ("OT_BUBD_A", "building_context", "polygon", "building"),
    ("OT_KUPG_A", "industrial_context", "polygon", "industrial_economic_complex"),
    ("OT_KUPG_P", "industrial_context", "point", "industrial_economic_complex"),
    ("OT_PTKM_A", "military_context", "polygon", "military_complex"),
]
REGISTER_TYPES = [
    ("ms:A01_Granice_wojewodztw", "wojewodztwo", "administrative_boundary", True),
    ("ms:A02_Granice_powiatow", "powiat", "administrative_boundary", True),
    ("ms:A03_Granice_gmin", "gmina", "administrative_boundary", True),
    ("ms:K01_Komenda_wojewodzka_policji", "police_command_voivodeship", "official_public_service", False),
    ("ms:K02_Komenda_powiatowa_policji", "police_command_county", "official_public_service", False),
    ("ms:K03_Komenda_stoleczna_policji", "police_command_capital", "official_public_service", False),
    ("ms:K04_Komenda_rejonowa_policji", "police_command_district", "official_public_service", False),
    ("ms:K05_Komisariat_policji", "police_station", "official_public_service", False),
    ("ms:K06_Komenda_wojewodzka_strazy_pozarnej", "fire_command_voivodeship", "official_public_service", False),
    ("ms:K07_Komenda_powiatowa_strazy_pozarnej", "fire_command_county", "official_public_service", False),
]


def named_classes(spark) -> DataFrame:
    """``class, role, family, label, boundary`` of all classes and types on the allow lists; a type's label is its class, and boundaries are polygons."""
    rows = [(c, role, family, label, False) for c, role, family, label in TOPOGRAPHIC_CLASSES] + [(t, role, "polygon" if b else "point", c, b) for t, c, role, b in REGISTER_TYPES]
    return spark.createDataFrame(rows, "class string, role string, family string, label string, boundary boolean")
