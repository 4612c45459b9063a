"""Both pathways side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.functions.angles import ratio

CLASSES = ("flux_and_directional", "directional_only", "flux_only", "neither")


def comparison(cells: DataFrame, flux: DataFrame, directional: DataFrame, min_support: int) -> DataFrame:
    """Supported cells with their flux and directional component (number and id) and class."""
    out = cells.filter(F.col("N_out_move") >= min_support).select("cell_id", "x_bin", "y_bin", "x", "y", "N_out_move", "U_out_all_magnitude_rate", "D_out_all_magnitude")
    for kind, cores in (("flux", flux), ("directional", directional)):
        out = out.join(cores.select("cell_id", F.col("component_number").alias(f"{kind}_component"), F.col("component_id").alias(f"{kind}_component_id")), "cell_id", "left")
    f, d = F.col("flux_component").isNotNull(), F.col("directional_component").isNotNull()
    return out.withColumn("class", F.when(f & d, CLASSES[0]).when(d, CLASSES[1]).when(f, CLASSES[2]).otherwise(CLASSES[3]))


def component_overlap(compared: DataFrame) -> DataFrame:
    """Per component of each kind: its cells, those that the other pathway has too, and their share."""

    def one(kind: str, other: str) -> DataFrame:
        own = f"{kind}_component"
        g = compared.filter(F.col(own).isNotNull()).groupBy(F.col(own).alias("component"), F.col(f"{own}_id").alias("component_id")).agg(F.count("*").alias("cells"), F.count(f"{other}_component").alias("shared"))
        return g.select(F.lit(kind).alias("kind"), "component", "component_id", "cells", "shared", (F.col("shared") / F.col("cells")).alias("fraction"))

    return one("flux", "directional").unionByName(one("directional", "flux"))


def summary(compared: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    out = compared.agg(F.count("*").alias("supported_cells"), *counts)
    return out.withColumns({f"{c}_fraction": ratio(F.col(c), F.col("supported_cells")) for c in CLASSES})
