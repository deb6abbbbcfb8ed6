from korrel.plans.catalogue import entry, oracle_sql, queries

__all__ = ["entry", "oracle_sql", "queries"]
