"""The registered queries: importing this module fills the registry."""

from graphloom.plans import catalog_analytics, catalog_code, catalog_explore, catalog_flow, catalog_project, catalog_similarity, catalog_structural, catalog_time  # noqa: F401
