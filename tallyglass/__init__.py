"""tallyglass: whole-table profiling, quality, features and evaluation on Spark."""

from tallyglass.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
