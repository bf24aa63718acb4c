import pytest

from clubsieve.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, DATA, "documents").collect()]


@pytest.fixture(scope="session")
def run(spark):
    """The rows of a registered query over the smallest data, run once."""
    done = {}

    def rows(name):
        if name not in done:
            done[name] = queries.QUERIES[name](spark, DATA).collect()
        return done[name]

    return rows
