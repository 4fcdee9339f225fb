"""Job options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from pressgraph import constants as K


@dataclass(frozen=True)
class JobOptions:
    memoize: bool = True
    stub_domains: bool = False
    max_depth: int = K.MAX_CRAWL_DEPTH
    #: Limits per site of a site build; None sets none.
    max_feeds: int | None = None
    max_candidates: int | None = None
    max_memo: int | None = None
    extra_columns: tuple[Callable[[DataFrame], DataFrame], ...] = ()


def extend(options: JobOptions, **given) -> JobOptions:
    """Options with some values replaced; unknown names are ignored."""
    known = {f.name for f in fields(options)}
    return replace(options, **{k: v for k, v in given.items() if k in known})
