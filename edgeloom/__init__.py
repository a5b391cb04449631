"""Join-graph analytics on PySpark."""

from edgeloom.functions.canonical import join_type, make_join
from edgeloom.functions.naming import table_key
from edgeloom.operators.extract import analyse, extract
from edgeloom.operators.scan import scan
from edgeloom.plans.store import Store
from edgeloom.sources.config import Config, ConfigError, Source

__all__ = ["Config", "ConfigError", "Source", "Store", "analyse", "extract", "join_type", "make_join", "scan", "table_key"]
