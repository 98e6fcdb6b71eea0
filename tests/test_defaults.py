"""Registered queries use the operators' whole default work."""

from cuesta.plans import catalog

SF = "/root/testdata/sf0.001"


def test_attitudes_have_uncertainties(spark):
    out = catalog.queries()["m4_attitudes"](spark, SF)
    assert {"dip_uncertainty", "dip_direction_uncertainty"} <= set(out.columns)
    assert out.where("dip_uncertainty is null or isnan(dip_uncertainty) or reliable and dip_uncertainty <= 0").count() == 0 < out.count()


def test_great_circles_have_181_points(spark):
    out = catalog.queries()["x7_great_circles"](spark, SF)
    assert out.count() == 181 * spark.read.parquet(f"{SF}/orders.parquet").count()
