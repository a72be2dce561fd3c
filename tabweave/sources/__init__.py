from tabweave.sources.corpora import read_corpus, write_corpus
from tabweave.sources.tables import (
    read_roles,
    read_table,
    target_column,
    write_generated,
    write_scores,
)

__all__ = [
    "read_corpus",
    "read_roles",
    "read_table",
    "target_column",
    "write_corpus",
    "write_generated",
    "write_scores",
]
