"""Fabrication of look-alike tables from seeded draws over ``spark.range``."""

from twintable.plans.fabricate import (  # noqa: F401
    categorical, lookups, numeric, people, temporal, text,
)
