"""Every registered query; importing the topic modules fills the registry."""

from trailgraph.plans import code_queries, graph_queries, history_queries, ledger_queries, note_queries, pack_queries, stream_queries, trust_queries, work_queries  # noqa: F401
from trailgraph.plans.registry import QUERIES, SQL  # noqa: F401
