from korrel.operators.aggregate import average, average_runs, distinct, distinct_runs
from korrel.operators.join import hash_join, hybrid_join
from korrel.operators.order import limit, merge, sort, top_k
from korrel.operators.rows import materialise, project, select

__all__ = ["average", "average_runs", "distinct", "distinct_runs", "hash_join", "hybrid_join", "limit", "materialise", "merge", "project", "select", "sort", "top_k"]
