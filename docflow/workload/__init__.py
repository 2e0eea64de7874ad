"""Every operator as a query over the given tables."""

from docflow.workload import chunks, pages, replies, summaries, texts  # noqa: F401
from docflow.workload.registry import ORACLES, QUERIES  # noqa: F401
