"""Named queries over the driver's tables, with the same results in SQL."""

from __future__ import annotations

from marlstone.plans import artifacts, features, logs, words

FLAGSHIP = "dup_collapse_15m"
QUERIES: dict = logs.QUERIES | words.QUERIES | features.QUERIES | artifacts.QUERIES
ORACLE: dict = logs.ORACLE | words.ORACLE | features.ORACLE | artifacts.ORACLE
