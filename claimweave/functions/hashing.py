"""Stable hashes and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(**parts: Column) -> Column:
    """SHA-256 of the parts as JSON with sorted names; nulls are kept."""
    ordered = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def source_key(canonical: Column) -> Column:
    """Key of a page's cached contents."""
    return stable_hash(url=canonical)


def research_key(question: Column, intent: Column, version: Column, readers: Column, mode: Column) -> Column:
    """Key of a run: the normalised question and all that changes what a run would say. The order of readers does not count."""
    return stable_hash(q=question, intent=intent, v=version, p=F.array_sort(readers), m=F.coalesce(mode, F.lit("default")))


def search_key(provider: Column, query: Column, limit: Column, recency_days: Column) -> Column:
    """Key of a query's cached results."""
    return stable_hash(provider=provider, q=F.lower(F.trim(query)), l=limit, r=recency_days)


def image_key(content: Column) -> Column:
    """Key of an image: the hash of its bytes."""
    return F.sha2(content, 256)
