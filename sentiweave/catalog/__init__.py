"""Registered queries over the driver tables, each with the SQL that must agree with it."""

from sentiweave.catalog import models, posts, profiles, statistics, subwords, tables, texts
from sentiweave.catalog.registry import Query

CATALOG: dict[str, Query] = {
    name: query
    for module in (texts, posts, profiles, statistics, models, tables, subwords)
    for name, query in module.CATALOG.items()
}
