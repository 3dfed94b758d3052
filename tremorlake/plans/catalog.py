"""Import every query module, so that the registry is complete."""

from tremorlake.plans import q_catalog, q_dataset, q_eval, q_events, q_geo, q_models, q_serving, q_stream  # noqa: F401
from tremorlake.plans.registry import ORACLES, QUERIES

FLAGSHIP = "k1_top_forecasts"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
