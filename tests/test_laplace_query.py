"""The query of the detail enhancement runs the operator's whole search cube."""

import inspect

from voxelarium.operators import stencils
from voxelarium.plans import catalogue


def test_laplace_enhance_searches_the_default_radius(spark, sf_dir, monkeypatch):
    searched, real = [], stencils.laplace_enhance

    def seen(*args, **options):
        searched.append(inspect.signature(real).bind(*args, **options).arguments.get("search", 2))
        return args[0]

    monkeypatch.setattr(stencils, "laplace_enhance", seen)
    catalogue.QUERIES["laplace_enhance"](spark, sf_dir)
    assert searched == [2] and inspect.signature(real).parameters["search"].default == 2
