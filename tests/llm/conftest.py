"""Frames of the small corpus, with columns whose names operators use inside."""

import pytest

from corpora import corpus
from debtatlas.llm.common import reach_workers

#: Names that operators use inside, to be found among the columns of a table as well.
CLASHES = ("bucket", "n", "component", "rank", "text_key", "id", "words", "lines", "hash", "chunk",
           "slot", "shard", "member", "n_words", "kept", "url_length", "label", "digest", "n_lines",
           "n_removed_lines", "lines_gone", "set_key", "slice", "part", "role", "turn", "step", "failed", "least",
           "serial", "group", "kind", "place", "positives", "found", "marks", "key", "lang", "quality", "toxic")


@pytest.fixture(scope="session")
def frame(spark):
    reach_workers(spark)

    def make(rows, columns="doc_id long, text string", clashes=CLASHES):
        names = [part.split()[0] for part in columns.split(",")]
        extra = [name for name in clashes if name not in names]
        schema = ", ".join([columns] + [f"{name} string" for name in extra])
        return spark.createDataFrame([(*row, *("x" for _ in extra)) for row in rows], schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def docs(frame):
    return frame(corpus())
