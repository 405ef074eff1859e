"""Every query of the library over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from weftgraph.plans.file_queries import QUERIES as FILE
from weftgraph.plans.graph_queries import QUERIES as GRAPH
from weftgraph.plans.query import Query
from weftgraph.plans.report_queries import QUERIES as REPORT
from weftgraph.plans.score_queries import QUERIES as SCORE
from weftgraph.plans.table_queries import QUERIES as TABLE

QUERIES: list[Query] = [*TABLE, *GRAPH, *SCORE, *REPORT, *FILE]
