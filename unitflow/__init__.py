"""Translation of document corpora as Spark DataFrame operators."""

from unitflow.options import Options
from unitflow.session import get_session

__all__ = ["Options", "get_session"]
