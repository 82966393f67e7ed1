"""Business-table analysis as Spark DataFrame operators."""

from tallyspark.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
