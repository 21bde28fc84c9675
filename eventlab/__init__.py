"""eventlab: event segmentation, interval alignment and design-based summaries
of keyed time series, expressed as Spark DataFrame plans.

Every public operator takes DataFrames and returns DataFrames. Only p x p
systems (model fits) and factor-level lists reach the driver.
"""

from eventlab.session import build_session, checkpoint_root, stage_path  # noqa: F401

__all__ = ["build_session", "checkpoint_root", "stage_path"]
