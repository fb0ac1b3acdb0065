"""tillscope: receipt-audit analytics as composable Spark DataFrame operators."""

from tillscope.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
