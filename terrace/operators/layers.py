"""The layer and type of a table from a scored candidate, priors and fixed boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layers, those that are boundaries, those a candidate may choose, and types of tables.
LAYERS = ("ODS", "DWD", "DWS", "ADS", "DIM")
BOUNDARIES = ("ODS", "ADS")
CANDIDATES = ("DWD", "DWS", "DIM")
TYPES = ("dimension", "fact", "bridge", "other")
LEAST_CONFIDENCE = 0.5


def _one_of(value: Column, allowed: tuple[str, ...], fold=F.upper) -> Column:
    """``value`` without outer blanks and in one case, null unless it is allowed."""
    plain = fold(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""))
    return F.when(plain.isin(*allowed), plain)


def resolve(tables: DataFrame, prior: str = "declared", refresh: bool = True, candidate_layers: tuple[str, ...] = CANDIDATES, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """name, inferred_layer, applied_layer, table_type, source, strength (of the prior), confidence and warnings of each row.

    tables: name, declared_layer, declared_type, fallback_layer, fallback_type, fixed_layer, candidate (a struct of layer,
    table_type and confidence; null without a candidate). A fixed boundary stands against any candidate. Else a candidate
    of an allowed layer and enough confidence is taken, and one of type dimension is put into DIM whatever its layer. Else
    the prior is: declared before fallback, or the other way round where ``prior`` is ``direct_rule``. Values that aren't
    layers, types or confidences from 0 to 1 count as missing; what is missing everywhere is OTHER and other. Without
    ``candidate_layers`` any layer is allowed. Warnings: candidate_unusable, outside_candidates. One scan, no shuffle.
    """
    allowed = tuple(x.strip().upper() for x in candidate_layers if x.strip().upper() in LAYERS)
    order = ("fallback", "declared") if prior == "direct_rule" else ("declared", "fallback")
    given, confidence = F.col("candidate").isNotNull(), F.col("candidate.confidence").cast("double")
    seen = tables.select(
        "name",
        _one_of(F.col("fixed_layer"), BOUNDARIES).alias("fixed"),
        F.coalesce(*[_one_of(F.col(f"{x}_layer"), LAYERS) for x in order], F.lit("OTHER")).alias("prior_layer"),
        F.coalesce(*[_one_of(F.col(f"{x}_type"), TYPES, F.lower) for x in order], F.lit("other")).alias("prior_type"),
        given.alias("given"),
        _one_of(F.col("candidate.layer"), (*LAYERS, "OTHER")).alias("layer"),
        _one_of(F.col("candidate.table_type"), TYPES, F.lower).alias("kind"),
        F.when(confidence.between(0.0, 1.0), confidence).alias("confidence"),
    )
    usable = F.coalesce(F.col("layer").isin(*(allowed or LAYERS)) & (F.col("confidence") >= least), F.lit(False))
    fixed = F.col("fixed").isNotNull()
    seen = seen.withColumn("source", F.when(fixed, "fixed_boundary").when(usable, "candidate").otherwise(prior))
    taken = F.col("source") == "candidate"
    applied = F.coalesce("fixed", F.when(taken, F.when(F.col("kind") == "dimension", "DIM").otherwise(F.col("layer"))), "prior_layer")
    inferred = F.when(fixed, F.coalesce("layer", "fixed")).when(F.col("given"), F.coalesce("layer", F.lit("OTHER"))).otherwise(F.col("prior_layer"))
    strong = prior == "declared" and refresh
    seen = seen.withColumn("applied_layer", applied)
    outside = F.lit(bool(allowed)) & ~fixed & ~F.col("applied_layer").isin(*allowed, "OTHER")
    warnings = F.array(F.when(F.col("given") & ~fixed & ~taken, "candidate_unusable"), F.when(outside, "outside_candidates"))
    return seen.select(
        "name",
        inferred.alias("inferred_layer"),
        "applied_layer",
        F.when(taken, F.coalesce("kind", "prior_type")).otherwise(F.col("prior_type")).alias("table_type"),
        "source",
        F.when(fixed, "fixed").otherwise("strong" if strong else "weak").alias("strength"),
        "confidence",
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )
